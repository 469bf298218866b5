"""Further queries: chats and tokens, splicing with padding, layers, norms, losses, schedules and drops."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import plugins
from corpusloom.operators import frames as W
from corpusloom.operators import masking, stats, vq
from corpusloom.plans.corpus import h60, items, train
from corpusloom.plans.frames import _BOOK, _EV, _book, framed, r
from corpusloom.session import table


def chat_render(s, d):
    t = train(s, d).where("messages is not null").select("row_idx", plugins.render_chat(F.col("messages")).alias("text"))
    return t.select("row_idx", F.md5("text").alias("digest"), F.size(plugins.tokenize(F.col("text"), "bytes")).cast("bigint").alias("n_tokens"))


def json_fields(s, d):
    j = F.try_parse_json("props")
    e = table(s, d, "events").select("event_id", F.try_variant_get(j, "$.k", "bigint").alias("k"))
    return e.select("event_id", "k", F.to_json(F.struct("event_id", "k")).alias("j"))


def splice_padded(s, d):
    """Spliced rows as arrays: labels padded at the end with -100 (training), attention padded in front with 0."""
    e = framed(s, d).withColumn("ins", F.when(F.col("event_type") == "view", 2).otherwise(0))
    sp = W.splice(e, "user_id", "t", "ins").join(e.select("user_id", "t", "event_id"), ["user_id", "t"])
    lab = F.when(F.col("inserted_frame").isNull(), F.col("event_id")).otherwise(-100)
    rows = sp.groupBy("user_id").agg(A.ordered(F.collect_list(F.struct("pos", lab.alias("v")))).alias("labels"), F.count(F.lit(1)).alias("n"))
    width = rows.agg(F.max("n").alias("w"))
    both = rows.crossJoin(F.broadcast(width))
    attention = A.pad_left(F.array_repeat(F.lit(1), F.col("n").cast("int")), F.col("w"), F.lit(0))
    return both.select("user_id", F.array_join(A.pad_right(F.col("labels"), F.col("w"), F.lit(-100).cast("bigint")), ",").alias("labels"), F.array_join(attention, ",").alias("attention"))


def layer_concat(s, d):
    """Vectors of the layers of an id side by side."""
    v = table(s, d, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 2).alias("e"))
    g = v.groupBy("label").agg(F.flatten(A.ordered(F.collect_list(F.struct("vec_id", F.col("e").alias("v"))))).alias("c"))
    return g.select("label", F.size("c").cast("bigint").alias("width"), r(F.aggregate(F.transform("c", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), "checksum"))


def vector_norms(s, d):
    v = table(s, d, "embeddings")
    e = F.col("embedding")
    one = lambda a: F.get(a, F.lit(0))
    return v.select("vec_id", r(A.norm(e), "norm"), r(one(A.l2_normalised(e)), "unit"), r(one(A.layer_norm(e)), "layer"), r(one(A.bias_norm(e, 0.1, 0.5)), "bias"), r(one(A.convex(e, A.l2_normalised(e), 0.25)), "bypass"))


def commitment_loss(s, d):
    a = vq.assign(table(s, d, "embeddings"), "vec_id", "embedding", _book(s, d))
    return a.agg(r(F.avg(F.col("distance") / 64), "loss"), F.count(F.lit(1)).alias("n"))


def cross_entropy(s, d):
    v = table(s, d, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 10)).alias("cls", "x")).withColumn("x", F.col("x").cast("double"))
    return stats.cross_entropy(v, "vec_id", "x", F.col("cls") == F.col("label"), F.col("label") == 3).select(r(F.col("loss"), "loss"), "n")


def schedule_value(s, d):
    e = table(s, d, "orders").select("o_orderkey")
    step = F.col("o_orderkey")
    pts = [(0.0, 0.5), (4000.0, 0.1), (8000.0, 0.05)]
    return e.select("o_orderkey", F.round(stats.schedule(step, pts, 0.0), 9).alias("training"), stats.schedule(step, pts, 0.0, training=False).alias("otherwise"))


def row_drop(s, d):
    return train(s, d).select("row_idx", masking.drop_row(F.col("row_idx"), 0.1, 3).alias("dropped"))


def apply_block_mask(s, d):
    e = framed(s, d)
    sized = W.join_per_key(e, W.lengths(e, "user_id", "t"), "user_id")
    m = masking.block_mask(F.col("user_id"), F.col("t"), F.col("length"), 5, 0.4, 42)
    out = sized.withColumn("m", m).withColumn("y", masking.apply_mask(F.col("value"), F.col("m"), F.lit(-1.0)))
    return out.groupBy("user_id").agg(r(F.sum("y"), "total"), F.count_if("m").alias("masked"), r(F.avg(F.col("m").cast("double")), "ratio"), F.min(masking.additive(F.col("m"))).alias("lowest"))


def sorted_distinct(s, d):
    t = items(s, d).where("expand_wav is not null")
    u = F.array_sort(F.array_distinct(F.array_union(F.filter("expand_wav", lambda x: x.isNotNull()), F.array("path"))))
    return t.select("item_id", F.array_join(u, "|").alias("paths"), F.element_at(u, -1).alias("last"), F.array_join(F.reverse(F.array_sort(F.transform(u, lambda x: F.length(x)))), ",").alias("lengths"))


def set_operations(s, d):
    i = items(s, d).select("path").where("path is not null")
    a = table(s, d, "audio_inventory").select("path").where("path is not null")
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n")
    return n(i.intersect(a), "intersect").unionAll(n(i.subtract(a), "except")).unionAll(n(i.exceptAll(a), "except all")).unionAll(n(i.union(a).distinct(), "union"))


QUERIES = {f.__name__: f for f in (chat_render, json_fields, splice_padded, layer_concat, vector_norms, commitment_loss, cross_entropy, schedule_value, row_drop, apply_block_mask, sorted_distinct, set_operations)}

ORACLE = {
    "chat_render": "WITH t AS (SELECT row_idx, coalesce(array_to_string(list_transform(messages, lambda m: '<|turn|>' || coalesce(m.role, '') || chr(10) || coalesce(m.content, '') || '<|/turn|>'), chr(10)), '') AS text FROM train_samples WHERE messages IS NOT NULL) SELECT row_idx, md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS n_tokens FROM t",
    "json_fields": "SELECT event_id, CAST(props::JSON->>'$.k' AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"k\":' || (props::JSON->>'$.k') || '}' AS j FROM events",
    "splice_padded": _EV + """, e AS (SELECT *, CASE WHEN event_type = 'view' THEN 2 ELSE 0 END AS ins FROM ev),
      x AS (SELECT user_id, t, 0 AS k, event_id AS v FROM e UNION ALL SELECT user_id, t, unnest(range(1, ins + 1)), -100 FROM e),
      g AS (SELECT user_id, list(v ORDER BY t, k) AS v, count(*) AS n FROM x GROUP BY 1), w AS (SELECT max(n) AS w FROM g)
      SELECT user_id, array_to_string(list_concat(v, list_transform(range(w - n), lambda i: CAST(-100 AS BIGINT))), ',') AS labels, array_to_string(list_concat(list_transform(range(w - n), lambda i: 0), list_transform(range(n), lambda i: 1)), ',') AS attention FROM g, w""",
    "layer_concat": "WITH g AS (SELECT label, flatten(list(CAST(embedding[1:2] AS DOUBLE[]) ORDER BY vec_id)) AS c FROM embeddings GROUP BY 1) SELECT label, CAST(len(c) AS BIGINT) AS width, round(list_sum(list_transform(c, lambda x, i: x * i)), 6) AS checksum FROM g",
    "vector_norms": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT *, list_sum(v) / len(v) AS mean, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e) SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS unit, round((v[1] - mean) / sqrt(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / len(v) + 1e-5), 6) AS layer, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: (x - 0.1::DOUBLE) * (x - 0.1::DOUBLE))) / len(v)) * exp(0.5), 6) AS bias, round(v[1] + (v[1] / n - v[1]) * 0.25, 6) AS bypass FROM m",
    "commitment_loss": _BOOK + " SELECT round(avg(distance / 64), 6) AS loss, count(*) AS n FROM asg",
    "cross_entropy": "WITH e AS (SELECT label, CAST(embedding[1:10] AS DOUBLE[]) AS v FROM embeddings WHERE label <> 3) SELECT round(avg(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[label + 1]), 6) AS loss, count(*) AS n FROM e",
    "schedule_value": "SELECT o_orderkey, round(CASE WHEN o_orderkey <= 0 THEN 0.5 WHEN o_orderkey <= 4000 THEN 0.5::DOUBLE + (0.1::DOUBLE - 0.5) * o_orderkey / 4000 WHEN o_orderkey <= 8000 THEN 0.1::DOUBLE + (0.05::DOUBLE - 0.1::DOUBLE) * (o_orderkey - 4000) / 4000 ELSE 0.05 END, 9) AS training, 0.0::DOUBLE AS otherwise FROM orders",
    "row_drop": f"SELECT row_idx, {h60('3', chr(39) + 'drop' + chr(39), 'row_idx')} % 1000000 < 100000 AS dropped FROM train_samples",
    "apply_block_mask": _EV + f", len AS (SELECT user_id, max(t) + 1 AS n FROM ev GROUP BY 1), m AS (SELECT ev.user_id, value, {h60('42', 'ev.user_id', 't // 5')} % 1000000 < 400000 AND t // 5 < n // 5 AS m FROM ev JOIN len USING (user_id)) SELECT user_id, round(sum(CASE WHEN m THEN -1.0 ELSE value END), 6) AS total, count(*) FILTER (WHERE m) AS masked, round(avg(CAST(m AS DOUBLE)), 6) AS ratio, min(CASE WHEN m THEN -1000.0::DOUBLE ELSE 0.0 END) AS lowest FROM m GROUP BY 1",
    "sorted_distinct": "WITH u AS (SELECT item_id, list_sort(list_distinct(list_concat(list_filter(expand_wav, lambda x: x IS NOT NULL), [path]))) AS u FROM test_items WHERE expand_wav IS NOT NULL) SELECT item_id, array_to_string(u, '|') AS paths, u[-1] AS last, array_to_string(list_reverse_sort(list_transform(u, lambda x: length(x))), ',') AS lengths FROM u",
    "set_operations": "WITH i AS (SELECT path FROM test_items WHERE path IS NOT NULL), a AS (SELECT path FROM audio_inventory WHERE path IS NOT NULL) SELECT 'intersect' AS op, count(*) AS n FROM (FROM i INTERSECT FROM a) UNION ALL SELECT 'except', count(*) FROM (FROM i EXCEPT FROM a) UNION ALL SELECT 'except all', count(*) FROM (FROM i EXCEPT ALL FROM a) UNION ALL SELECT 'union', count(*) FROM (FROM i UNION FROM a)",
}

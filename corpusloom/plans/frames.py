"""Queries on framed sequences: ``events`` as streams (user = sequence, place by (ts, event_id)), ``embeddings`` as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import mathx as M
from corpusloom.operators import frames as W
from corpusloom.operators import masking, stats, vq
from corpusloom.operators import piecewise as PW
from corpusloom.plans.corpus import h60
from corpusloom.session import table, written

#: Rounding that absorbs the order of summation.
R = 6


def ev(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return W.frame_index(e, "user_id", "ts", "event_id")


def framed(s: SparkSession, d: str) -> DataFrame:
    """The same, written once, for queries that read the frames several times."""
    return written(ev(s, d), "frames")


def r(c, alias):
    return F.round(c, R).alias(alias)


def frame_places(s, d):
    return ev(s, d).select("user_id", "event_id", "t")


def label_mask(s, d):
    e = framed(s, d)
    pairs = W.pair_markers(e, "user_id", "t", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return W.label_mask(e, "user_id", "t", "event_id", pairs, 1).select("user_id", "t", F.col("label").cast("bigint").alias("label"))


def marker_pairs(s, d):
    return W.pair_markers(framed(s, d), "user_id", "t", F.col("event_type") == "signup", F.col("event_type") == "purchase").select("user_id", F.col("k").cast("bigint").alias("k"), "start_t", "end_t")


def splice_offsets(s, d):
    e = framed(s, d).withColumn("ins", F.when(F.col("event_type") == "view", F.pmod("event_id", F.lit(4))).otherwise(0))
    return W.splice(e, "user_id", "t", "ins").select("user_id", F.col("pos").cast("bigint").alias("pos"), "t", "inserted_frame")


def chunk_pad(s, d):
    return W.chunk_counts(ev(s, d), "user_id", "t", 16)


def frame_stack(s, d):
    st = W.stack(ev(s, d), "user_id", "t", "value", 5)
    return st.select("user_id", F.col("s"), F.posexplode("frame").alias("k", "value")).select("user_id", "s", F.col("k").cast("bigint").alias("k"), "value")


def downsample_weighted(s, d):
    return W.downsample(ev(s, d), "user_id", "t", "value", [0.2, 0.3, 0.5]).select("user_id", "s", r(F.col("value"), "value"))


def upsample_repeat(s, d):
    e = framed(s, d).select("user_id", "t", "value")
    cut = W.lengths(e, "user_id", "t").select("user_id", (F.col("length") * 2 - 1).alias("length"))
    return W.upsample(e, "user_id", "t", 2, cut)


def every_second(s, d):
    return W.every(ev(s, d), "t", 2).select("user_id", "t", "event_id")


def shift_right(s, d):
    e = ev(s, d).withColumn("label", F.when(F.col("event_type") == "error", F.lit(-100)).otherwise(F.col("event_id")))
    return W.shift_right(e, "user_id", "t", "label", 1, -100, 0).select("user_id", "t", F.col("shifted").cast("bigint").alias("shifted"))


def chunk_causal_agg(s, d):
    return W.chunk_causal(framed(s, d), "user_id", "t", "value", 4, 2).select("user_id", "t", r(F.col("seen_sum"), "seen_sum"), "seen")


def causal_agg(s, d):
    return W.running_sum(framed(s, d), "user_id", "t", "value", "upto").select("user_id", "t", r(F.col("upto"), "upto"))


def softmax_partition(s, d):
    return W.softmax(framed(s, d).withColumn("x", F.col("value") / 100), "user_id", "x").select("user_id", "t", r(F.col("p"), "p"))


def fir_centered(s, d):
    return W.fir(ev(s, d), "user_id", "t", "value", [0.25, 0.5, 0.25], 1, "y").select("user_id", "t", r(F.col("y"), "y"))


LEFT_EDGE, RIGHT_EDGE, CHUNK = [0.3, 0.2, 0.1], [0.1, 0.2, 0.3], 8


def fir_causal_chunk(s, d):
    causal = W.fir(ev(s, d), "user_id", "t", "value", [0.5, 0.3, 0.2], 2, "causal")
    both = W.fir(causal, "user_id", "t", "value", [0.25, 0.5, 0.25], 1, "local", within=CHUNK)
    return both.select("user_id", "t", r(F.col("causal") + F.col("local") * W.chunk_scale(F.col("t"), CHUNK, LEFT_EDGE, RIGHT_EDGE), "y"))


def left_context(s, d):
    c = W.left_context(ev(s, d), "user_id", "t", "event_id", 4)
    return c.select("user_id", "t", F.array_join("context", ",").alias("context"))


def delay_align(s, d):
    e = framed(s, d).select("user_id", "t", "event_id")
    out = W.delay_align(e.withColumnRenamed("event_id", "value"), e.select("user_id", "t", F.when(F.pmod("event_id", F.lit(5)) > 0, F.col("event_id")).alias("value")), "user_id", "t", 3)
    return out.select("user_id", "t", "a", F.col("b").cast("bigint").alias("b"))


def mask_downsample(s, d):
    return W.mask_downsample(ev(s, d).withColumn("mask", F.col("value") > 20), "user_id", "t", "mask", 4)


def _two(s, d):
    e = framed(s, d).select("user_id", "t", "value")
    return e, e.withColumn("user_id", F.col("user_id") + 1)


def align_pad_outer(s, d):
    a, b = _two(s, d)
    return W.align_outer(a, b, "user_id", "t")


def align_ratio_fold(s, d):
    fast = framed(s, d).select("user_id", "t", F.col("event_id").alias("value"))
    slow = W.lengths(fast, "user_id", "t").select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("length") / 2) - 1)).alias("t"))
    out = W.ratio_fold(slow, fast, "user_id", "t", 2, -100, most_short=5)
    return out.select("user_id", "t", F.get("folded", F.lit(0)).cast("bigint").alias("first"), F.get("folded", F.lit(1)).cast("bigint").alias("second"))


def interp_nearest(s, d):
    e = framed(s, d).select("user_id", "t", "event_id")
    want = W.lengths(e, "user_id", "t").select("user_id", F.floor(F.col("length") * 3 / 2).alias("want"))
    return W.nearest(e, "user_id", "t", "event_id", want)


def backfill_dims(s, d):
    v = table(s, d, "embeddings").select("label", "vec_id", *[F.when(F.pmod(F.col("vec_id"), F.lit(i + 2)) == 0, F.get("embedding", F.lit(i))).cast("double").alias(f"d{i}") for i in range(4)])
    return W.backfill(v, "label", "vec_id", [f"d{i}" for i in range(4)])


POINTS, OTHER = [(0.0, 10.0), (20.0, 2.0), (100.0, 0.5)], [(0.0, 0.0), (50.0, 6.0)]


def piecewise_eval(s, d):
    values = table(s, d, "events").select("event_id", "value")
    return PW.evaluate(values, "value", PW.breakpoints(s, f=POINTS), "f", "y").select("event_id", F.round("y", 9).alias("y"))


def piecewise_max(s, d):
    p = PW.breakpoints(s, f=POINTS, g=OTHER)
    made = PW.combined(p, "f", "g", "max", "top").unionByName(PW.scaled(PW.combined(p, "f", "g", "sum", "sum"), "sum", 2.0))
    values = table(s, d, "events").select("event_id", "value")
    return PW.evaluate(PW.evaluate(values, "value", made, "top", "y"), "value", made, "sum", "z").select("event_id", r(F.col("y"), "y"), r(F.col("z"), "z"))


def pad_mask(s, d):
    n = table(s, d, "train_samples").select("row_idx", F.coalesce(F.size(F.filter("audios", lambda a: a.isNotNull())), F.lit(0)).alias("n"))
    return n.select("row_idx", F.array_join(F.transform(A.padding_mask(F.greatest(F.col("n"), F.lit(0)), F.lit(4)), lambda b: b.cast("string")), ",").alias("mask"))


def pad_to_max(s, d):
    t = table(s, d, "train_samples").where("audios is not null").select("row_idx", F.transform("audios", lambda a: F.coalesce(F.length(a), F.lit(0))).alias("a"))
    widest = t.agg(F.max(F.size("a")).alias("w"))
    both = t.crossJoin(F.broadcast(widest))
    return both.select("row_idx", F.array_join(A.pad_right(F.col("a"), F.col("w"), F.lit(-100)), ",").alias("right"), F.array_join(A.pad_left(F.col("a"), F.col("w"), F.lit(0)), ",").alias("left"))


def block_mask_md5(s, d):
    e = framed(s, d)
    sized = W.join_per_key(e, W.lengths(e, "user_id", "t"), "user_id")
    return sized.select("user_id", "t", masking.block_mask(F.col("user_id"), F.col("t"), F.col("length"), 5, 0.4, 42).alias("masked"))


def feature_mask_md5(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return v.select("vec_id", F.col("dim").cast("bigint").alias("dim"), masking.feature_mask(F.col("vec_id"), F.col("dim"), 16, 48, 0.875, 7).alias("keep"))


def span_mask(s, d):
    return masking.span_mask(W.lengths(ev(s, d), "user_id", "t"), "user_id", "length")


def masked_mean(s, d):
    e = framed(s, d)
    sized = W.join_per_key(e, W.lengths(e, "user_id", "t").withColumn("length", F.floor(F.col("length") * 0.8)), "user_id")
    return stats.masked_mean(sized, "user_id", "value", F.col("t") < F.col("length")).select("user_id", r(F.col("mean"), "mean"))


def layer_weighted_sum(s, d):
    e = table(s, d, "events").withColumn("layer", F.pmod("event_id", F.lit(6))).groupBy("user_id", "layer").agg(F.avg("value").alias("v"))
    return stats.weighted_layers(e.withColumn("w", F.col("layer") / 10), "user_id", "w", "v").select("user_id", r(F.col("mixed"), "mixed"))


def entropy(s, d):
    p = W.softmax(framed(s, d).withColumn("x", F.col("value") / 100), "user_id", "x")
    return stats.entropy(p, "user_id", "p").select("user_id", r(F.col("entropy"), "entropy"))


def channel_balance_stats(s, d):
    v = table(s, d, "embeddings").select(F.posexplode("embedding").alias("channel", "x"))
    c = stats.channel_stats(v, "channel", "x", -0.05, 0.05)
    return c.select(F.col("channel").cast("bigint").alias("channel"), *[r(F.col(k), k) for k in ("mean", "rms", "std", "ratio", "off_band")])


def whiteness(s, d):
    return stats.whiteness(table(s, d, "embeddings"), "embedding", 4, 64).select(F.round("whiteness", 4).alias("whiteness"))


def direction_share(s, d):
    return stats.explained(table(s, d, "embeddings"), "embedding", [1.0, -1.0] * 32).select(r(F.col("share"), "share"))


def _book(s, d):
    return vq.code_book(table(s, d, "embeddings").where("vec_id < 12").select("vec_id", F.col("embedding")), "vec_id", "embedding")


def vq_assign(s, d):
    a = vq.assign(table(s, d, "embeddings"), "vec_id", "embedding", _book(s, d))
    return a.select("vec_id", "code", F.round("distance", 4).alias("distance"))


def _codes(s, d):
    return table(s, d, "embeddings").where("vec_id < 12").select(F.col("vec_id").alias("code"))


def vq_histogram(s, d):
    return vq.histogram(vq.assign(table(s, d, "embeddings"), "vec_id", "embedding", _book(s, d)), _codes(s, d))


def vq_smooth(s, d):
    return vq.smoothed(vq_histogram(s, d), 1e-5).select("code", r(F.col("smooth"), "smooth"))


def kmeans_step(s, d):
    v = table(s, d, "embeddings")
    m = vq.means(vq.assign(v, "vec_id", "embedding", _book(s, d)), v, "vec_id", "embedding")
    return m.select("code", F.col("dim").cast("bigint").alias("dim"), r(F.col("mean"), "mean"), "n")


def kmeans(s, d):
    (codes, e), n = vq.kmeans(table(s, d, "embeddings"), "vec_id", "embedding", _book(s, d), rounds=3)
    return s.createDataFrame([(int(c), int(k), float(round((x**2).sum(), 4))) for c, k, x in zip(codes, n, e)], "code long, n long, squared_norm double")


def codebook_ema(s, d):
    e = framed(s, d)
    return stats.ema_per_key(W.join_per_key(e, W.lengths(e, "user_id", "t"), "user_id"), "user_id", "t", "value", "length", 0.9).select("user_id", r(F.col("ema"), "ema"))


def code_gather(s, d):
    a = vq.assign(table(s, d, "embeddings"), "vec_id", "embedding", _book(s, d))
    book = table(s, d, "embeddings").where("vec_id < 12").select(F.col("vec_id").alias("code"), F.get("embedding", F.lit(0)).cast("double").alias("first"))
    return a.join(F.broadcast(book), "code").select("vec_id", "code", r(F.col("first"), "first"))


def cosine_topk(s, d):
    from pyspark.sql import Window

    v = table(s, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    if q.count() > 10000:
        raise ValueError("at most 10,000 query vectors at once; pass more in blocks")
    scored = v.join(F.broadcast(q), F.col("vec_id") != F.col("query")).select("query", "vec_id", F.round(A.cosine(F.col("q"), F.col("embedding")), 9).alias("c"))
    # The best of each block first, so that no task sees all rows of a query.
    w = Window.partitionBy("query", F.pmod("vec_id", F.lit(16))).orderBy(F.desc("c"), "vec_id")
    few = scored.withColumn("k", F.row_number().over(w)).where("k <= 5")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("c"), "vec_id"))
    return few.withColumn("rank", rank).where("rank <= 5").select("query", F.col("rank").cast("bigint").alias("rank"), "vec_id", r(F.col("c"), "cosine"))


def distance_bucket(s, d):
    n = s.range(-300, 301).withColumnRenamed("id", "d")
    bias = F.round(F.sin(F.col("bucket").cast("double")), 6).alias("bias")
    return n.select("d", M.distance_bucket(F.col("d"), 32, 128).alias("bucket")).select("d", "bucket", bias)


def position_code(s, d):
    g = s.range(-40, 41).withColumnRenamed("id", "x").withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return g.select("x", F.col("dim").cast("bigint").alias("dim"), r(M.position_code(F.col("x").cast("double"), F.col("dim"), 16), "code"))


def activations(s, d):
    x = F.col("x")
    e = table(s, d, "events").select("event_id", ((F.col("value") - 20) / 10).alias("x"))
    return e.select("event_id", *[r(M.activation(n)(x), n) for n in ("relu", "sigmoid", "tanh", "swish", "gelu_accurate", "double_swish", "swoosh_l", "swoosh_r")], r(M.glu(x, x / 2), "glu"), r(M.log_add_exp(x, -x), "logaddexp"), r(M.inverse_erf(F.tanh(x) * 0.9), "inverse_erf"), r(F.ln(F.greatest(x, F.lit(1e-7))), "log_clipped"), r((x - 3) / (2 * 1.5), "affine"))


def length_formulas(s, d):
    n = F.col("n")
    fs = {"subsampled": M.subsampled(n), "streaming": M.subsampled_streaming(n), "stride_two": M.stride_two(n), "halved": M.halved_up(n), "down": M.downsampled(n, 4), "windowed": M.windowed_three_strides(n), "tokens": M.connector_tokens(n, 5), "tokens_4": M.connector_tokens(n, 5, 4), "tokens_640": M.connector_tokens(n, 5, 640), "last_chunk": M.last_chunk_frames(n * 160, 30 * 16000)}
    return s.range(0, 1200).withColumnRenamed("id", "n").select("n", *[c.cast("bigint").alias(k) for k, c in fs.items()])


def bce_eval(s, d):
    e = table(s, d, "events").select("event_type", ((F.col("value") - 20) / 10).alias("x"), F.pmod("event_id", F.lit(2)).cast("double").alias("y"))
    return e.groupBy("event_type").agg(r(F.avg(stats.bce_with_logits(F.col("x"), F.col("y"))), "loss"), F.count(F.lit(1)).alias("n"))


def online_cutoff(s, d):
    a = ev(s, d).groupBy("user_id").agg(A.ordered(F.collect_list(F.struct("t", F.col("value").alias("v")))).alias("a"))
    return a.select("user_id", stats.online_cutoff(F.col("a"), 0.3).alias("o")).select("user_id", r(F.col("o.cutoff"), "cutoff"), "o.n", "o.above")


def stop_suffix(s, d):
    e = framed(s, d)
    tail = W.join_per_key(e, W.lengths(e, "user_id", "t"), "user_id").where("t >= length - 2")
    last = tail.groupBy("user_id").agg(A.ordered(F.array_sort(F.collect_list(F.struct("t", F.col("event_type").alias("v"))))).alias("a"))
    stops = [F.array(F.lit("view"), F.lit("click")), F.array(F.lit("error"))]
    return last.select("user_id", A.stopped(F.col("a"), stops).alias("stopped"))


def array_ops(s, d):
    t = table(s, d, "test_items").where("options is not null and size(options) > 0").select("item_id", F.transform("options", lambda o: F.length(o)).alias("a"))
    a = F.col("a")
    j = lambda c: F.array_join(c, ",")
    return t.select("item_id", j(A.fit_width(a, 3, F.lit(0))).alias("fit"), j(A.repeat_each(a, 2)).alias("repeated"), j(A.gather(a, F.array(F.lit(1), F.lit(0)))).alias("gathered"), j(A.splice_after(a, F.lit(0), F.array(F.lit(-1), F.lit(-2)))).alias("spliced"), j(F.transform(A.chunks(a, 2, F.lit(0)), lambda c: F.array_join(c, "+"))).alias("chunks"))


QUERIES = {f.__name__: f for f in (
    frame_places, label_mask, marker_pairs, splice_offsets, chunk_pad, frame_stack, downsample_weighted, upsample_repeat, every_second, shift_right, chunk_causal_agg, causal_agg,
    softmax_partition, fir_centered, fir_causal_chunk, left_context, delay_align, mask_downsample, align_pad_outer, align_ratio_fold, interp_nearest, backfill_dims, piecewise_eval, piecewise_max,
    pad_mask, pad_to_max, block_mask_md5, feature_mask_md5, span_mask, masked_mean, layer_weighted_sum, entropy, channel_balance_stats, whiteness, direction_share, vq_assign,
    vq_histogram, vq_smooth, kmeans_step, kmeans, codebook_ema, code_gather, cosine_topk, distance_bucket, position_code, activations, length_formulas, bce_eval, online_cutoff, stop_suffix, array_ops,
)}


# --- SQL ---------------------------------------------------------------------------------------------------------
_EV = "WITH ev AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"
_LEN = ", len AS (SELECT user_id, max(t) + 1 AS n FROM ev GROUP BY 1)"
_PAIRS = ", pr AS (SELECT a.user_id, a.k, a.t AS start_t, b.t AS end_t FROM (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM ev WHERE event_type = 'signup') a JOIN (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM ev WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.k = b.k)"
_BOOK = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS code, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS dist FROM e a, e b WHERE b.vec_id < 12), asg AS (SELECT vec_id, arg_min(code, (dist, code)) AS code, min(dist) AS distance FROM d GROUP BY 1)"
_HIST = _BOOK + ", h AS (SELECT c.vec_id AS code, count(asg.vec_id) AS n FROM (SELECT vec_id FROM e WHERE vec_id < 12) c LEFT JOIN asg ON asg.code = c.vec_id GROUP BY 1)"
_SCALE = "1 + CASE t % 8 " + " ".join(f"WHEN {i} THEN {([*LEFT_EDGE, 0, 0, 0, 0, 0][i] + [0, 0, 0, 0, 0, *RIGHT_EDGE][i])!r}" for i in range(CHUNK)) + " END"


def _piece_sql(points, x="value") -> str:
    out = f"CASE WHEN {x} <= {points[0][0]!r} THEN {points[0][1]!r}"
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out += f" WHEN {x} <= {x1!r} THEN {y0!r}::DOUBLE + ({y1 - y0!r}::DOUBLE) * ({x} - {x0!r}::DOUBLE) / {x1 - x0!r}::DOUBLE"
    return out + f" ELSE {points[-1][1]!r} END"


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _lae(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs({a} - ({b})))))"


_SOFT = _EV + ", m AS (SELECT user_id, max(value / 100) AS m FROM ev GROUP BY 1), x AS (SELECT ev.user_id, t, exp(value / 100 - m) AS e FROM ev JOIN m USING (user_id)), sm AS (SELECT user_id, t, e / sum(e) OVER (PARTITION BY user_id) AS p FROM x)"

ORACLE = {
    "frame_places": _EV + " SELECT user_id, event_id, t FROM ev",
    "label_mask": _EV + _PAIRS + " SELECT user_id, t, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.user_id = ev.user_id AND ev.t BETWEEN pr.start_t + 1 AND pr.end_t) THEN event_id ELSE -100 END AS label FROM ev",
    "marker_pairs": _EV + _PAIRS + " SELECT user_id, k, start_t, end_t FROM pr",
    "splice_offsets": _EV + """, i AS (SELECT *, CASE WHEN event_type = 'view' THEN event_id % 4 ELSE 0 END AS ins FROM ev),
      o AS (SELECT *, t + coalesce(sum(ins) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM i)
      SELECT user_id, CAST(p AS BIGINT) AS pos, t, CAST(NULL AS BIGINT) AS inserted_frame FROM o UNION ALL SELECT user_id, CAST(p + 1 + k AS BIGINT), t, k FROM (SELECT *, unnest(range(ins)) AS k FROM o)""",
    "chunk_pad": _EV + _LEN + " SELECT user_id, n AS length, CAST(ceil(n / 16) AS BIGINT) AS n_chunks, (16 - n % 16) % 16 AS pad FROM len",
    "frame_stack": _EV + _LEN + ", g AS (SELECT user_id, n, unnest(range(CAST(ceil(n / 5) * 5 AS BIGINT))) AS i FROM len) SELECT g.user_id, i // 5 AS s, i % 5 AS k, coalesce(value, 0.0) AS value FROM g LEFT JOIN ev ON ev.user_id = g.user_id AND ev.t = g.i",
    "downsample_weighted": _EV + _LEN + ", g AS (SELECT user_id, n, unnest(range(CAST(ceil(n / 3) * 3 AS BIGINT))) AS i FROM len) SELECT g.user_id, i // 3 AS s, round(sum(value * [0.2, 0.3, 0.5][i % 3 + 1]), 6) AS value FROM g JOIN ev ON ev.user_id = g.user_id AND ev.t = least(g.i, n - 1) GROUP BY 1, 2",
    "upsample_repeat": _EV + _LEN + " SELECT ev.user_id, t * 2 + k AS t, value FROM ev JOIN len USING (user_id), (VALUES (0), (1)) v(k) WHERE t * 2 + k < n * 2 - 1",
    "every_second": _EV + " SELECT user_id, t, event_id FROM ev WHERE t % 2 = 0",
    "shift_right": _EV + ", l AS (SELECT user_id, t, CASE WHEN event_type = 'error' THEN -100 ELSE event_id END AS l FROM ev), s AS (SELECT user_id, t, lag(l, 1, 1) OVER (PARTITION BY user_id ORDER BY t) AS x FROM l) SELECT user_id, t, CASE WHEN x = -100 THEN 0 ELSE x END AS shifted FROM s",
    "chunk_causal_agg": _EV + " SELECT user_id, t, round(sum(value) OVER w, 6) AS seen_sum, count(*) OVER w AS seen FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t // 4 RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "causal_agg": _EV + " SELECT user_id, t, round(sum(value) OVER (PARTITION BY user_id ORDER BY t), 6) AS upto FROM ev",
    "softmax_partition": _SOFT + " SELECT user_id, t, round(p, 6) AS p FROM sm",
    "fir_centered": _EV + " SELECT user_id, t, round(0.25 * coalesce(lag(value) OVER w, 0) + 0.5 * value + 0.25 * coalesce(lead(value) OVER w, 0), 6) AS y FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)",
    "fir_causal_chunk": _EV + f""" SELECT user_id, t, round(0.5 * coalesce(lag(value, 2) OVER w, 0) + 0.3 * coalesce(lag(value) OVER w, 0) + 0.2 * value
      + (0.25 * coalesce(lag(value) OVER c, 0) + 0.5 * value + 0.25 * coalesce(lead(value) OVER c, 0)) * ({_SCALE}), 6) AS y FROM ev
      WINDOW w AS (PARTITION BY user_id ORDER BY t), c AS (PARTITION BY user_id, t // 8 ORDER BY t)""",
    "left_context": _EV + " SELECT user_id, t, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS context FROM ev",
    "delay_align": _EV + " SELECT a.user_id, b.t, a.event_id AS a, CASE WHEN b.event_id % 5 > 0 THEN b.event_id ELSE -100 END AS b FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.t = b.t + 3",
    "mask_downsample": _EV + " SELECT user_id, t // 4 AS s, avg(CAST(value > 20 AS DOUBLE)) >= 0.5 AS any_half, bool_and(value > 20) AS all_masked FROM ev GROUP BY 1, 2 HAVING count(*) = 4",
    "align_pad_outer": _EV + ", a AS (SELECT user_id, t, value FROM ev), b AS (SELECT user_id + 1 AS user_id, t, value FROM ev) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.t, b.t) AS t, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM a FULL JOIN b ON a.user_id = b.user_id AND a.t = b.t",
    "align_ratio_fold": _EV + " SELECT user_id, t // 2 AS t, coalesce(max(event_id) FILTER (WHERE t % 2 = 0), -100) AS first, coalesce(max(event_id) FILTER (WHERE t % 2 = 1), -100) AS second FROM ev GROUP BY 1, 2",
    "interp_nearest": _EV + _LEN + ", g AS (SELECT user_id, n, unnest(range(n * 3 // 2)) AS o FROM len) SELECT g.user_id, o AS t, event_id FROM g JOIN ev ON ev.user_id = g.user_id AND ev.t = o * n // (n * 3 // 2)",
    "backfill_dims": "SELECT label, " + ", ".join(f"arg_max(CAST(embedding[{i + 1}] AS DOUBLE), vec_id) FILTER (WHERE vec_id % {i + 2} = 0) AS d{i}" for i in range(4)) + " FROM embeddings GROUP BY 1",
    "piecewise_eval": f"SELECT event_id, round({_piece_sql(POINTS)}, 9) AS y FROM events",
    "piecewise_max": f"SELECT event_id, round(greatest({_piece_sql(POINTS)}, {_piece_sql(OTHER)}), 6) AS y, round(2 * ({_piece_sql(POINTS)} + {_piece_sql(OTHER)}), 6) AS z FROM events",
    "pad_mask": "SELECT row_idx, array_to_string(list_transform([0, 1, 2, 3], lambda i: CASE WHEN i >= coalesce(len(list_filter(audios, lambda a: a IS NOT NULL)), 0) THEN 'true' ELSE 'false' END), ',') AS mask FROM train_samples",
    "pad_to_max": "WITH a AS (SELECT row_idx, list_transform(audios, lambda x: coalesce(length(x), 0)) AS a, (SELECT max(len(audios)) FROM train_samples) AS w FROM train_samples WHERE audios IS NOT NULL) SELECT row_idx, array_to_string(list_concat(a, list_transform(range(CAST(w - len(a) AS BIGINT)), lambda i: CAST(-100 AS BIGINT))), ',') AS right, array_to_string(list_concat(list_transform(range(CAST(w - len(a) AS BIGINT)), lambda i: CAST(0 AS BIGINT)), a), ',') AS left FROM a",
    "block_mask_md5": _EV + _LEN + f" SELECT ev.user_id, t, {h60('42', 'ev.user_id', 't // 5')} % 1000000 < 400000 AND t // 5 < n // 5 AS masked FROM ev JOIN len USING (user_id)",
    "feature_mask_md5": f"""WITH v AS (SELECT vec_id, unnest(range(64)) AS dim, {h60('7', "'a'", 'vec_id')} % 1000000 < 875000 AS a, {h60('7', "'b'", 'vec_id')} % 1000000 < 875000 AS b FROM embeddings) SELECT vec_id, CAST(dim AS BIGINT) AS dim, CASE WHEN dim < 16 THEN 1 WHEN dim < 48 THEN CAST(a AS INT) ELSE CAST(a AND b AS INT) END AS keep FROM v""",
    "masked_mean": _EV + _LEN + " SELECT ev.user_id, round(avg(value) FILTER (WHERE t < floor(n * 0.8)), 6) AS mean FROM ev JOIN len USING (user_id) GROUP BY 1",
    "layer_weighted_sum": "WITH l AS (SELECT user_id, event_id % 6 AS layer, avg(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, round(sum(exp(layer / 10) * v) / sum(exp(layer / 10)), 6) AS mixed FROM l GROUP BY 1",
    "entropy": _SOFT + " SELECT user_id, round(sum(-p * ln(p + 1e-20)), 6) AS entropy FROM sm GROUP BY 1",
    "channel_balance_stats": "WITH v AS (SELECT generate_subscripts(embedding, 1) - 1 AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), g AS (SELECT channel, avg(x) AS mean, sqrt(avg(x * x)) AS rms, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-20)) AS std FROM v GROUP BY 1) SELECT channel, round(mean, 6) AS mean, round(rms, 6) AS rms, round(std, 6) AS std, round(mean / std, 6) AS ratio, round(greatest(-0.05 - mean / std, 0) + greatest(mean / std - 0.05, 0), 6) AS off_band FROM g",
    "whiteness": "WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT a.i AS i, b.i AS j, covar_pop(a.x, b.x) * count(*) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i // 16 = b.i // 16 GROUP BY 1, 2) SELECT round(sum(cov * cov) / 64 / (pow(avg(cov) FILTER (WHERE i = j), 2) + 1e-20), 4) AS whiteness FROM c",
    "direction_share": "WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), p AS (SELECT vec_id, sum(CASE WHEN i % 2 = 0 THEN x ELSE -x END) AS a FROM v GROUP BY 1) SELECT round((SELECT var_pop(a) / 64 FROM p) / (SELECT sum(s) FROM (SELECT var_pop(x) AS s FROM v GROUP BY i)), 6) AS share",
    "vq_assign": _BOOK + " SELECT vec_id, code, round(distance, 4) AS distance FROM asg",
    "vq_histogram": _HIST + " SELECT code, n FROM h",
    "vq_smooth": _HIST + " SELECT code, round((n + 1e-5) / (sum(n) OVER () + count(*) OVER () * 1e-5) * sum(n) OVER (), 6) AS smooth FROM h",
    "kmeans_step": _BOOK + ", l AS (SELECT code, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM asg JOIN e USING (vec_id)) SELECT code, dim, round(avg(x), 6) AS mean, count(*) AS n FROM l GROUP BY 1, 2",
    "codebook_ema": _EV + ", a AS (SELECT user_id, list(value ORDER BY t) AS a FROM ev GROUP BY 1) SELECT user_id, round(list_reduce(a, lambda s, x: s * 0.9 + x * (1 - 0.9)), 6) AS ema FROM a",
    "code_gather": _BOOK + " SELECT asg.vec_id, code, round(e.v[1], 6) AS first FROM asg JOIN e ON e.vec_id = code",
    "cosine_topk": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query, rank, vec_id, round(c, 6) AS cosine FROM k WHERE rank <= 5",
    "distance_bucket": "WITH n AS (SELECT unnest(range(-300, 301)) AS d), b AS (SELECT d, CASE WHEN d > 0 THEN 16 ELSE 0 END + CASE WHEN abs(d) < 8 THEN abs(d) ELSE least(8 + CAST(floor(ln(abs(d) / 8.0) / ln(128 / 8.0) * 8) AS BIGINT), 15) END AS bucket FROM n) SELECT d, bucket, round(sin(bucket), 6) AS bias FROM b",
    "position_code": "WITH g AS (SELECT x, dim FROM (SELECT unnest(range(-40, 41)) AS x), (SELECT unnest(range(16)) AS dim)), a AS (SELECT x, dim, atan(4 * sign(x) * (ln(abs(x) + 4) - ln(4)) / (16 / (2 * pi()))) AS a, dim // 2 + 1 AS f FROM g) SELECT x, dim, round(CASE WHEN dim = 15 THEN 1 WHEN dim % 2 = 0 THEN cos(a * f) ELSE sin(a * f) END, 6) AS code FROM a",
    "activations": f"""WITH e AS (SELECT event_id, (value - 20) / 10 AS x FROM events) SELECT event_id, round(greatest(x, 0), 6) AS relu, round({_sig('x')}, 6) AS sigmoid, round(tanh(x), 6) AS tanh, round(x * {_sig('x')}, 6) AS swish,
      round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) AS gelu_accurate, round(x * {_sig('x - 1')}, 6) AS double_swish, round({_lae('x - 4', '0')} - 0.08 * x - 0.035, 6) AS swoosh_l,
      round({_lae('x - 1', '0')} - 0.08 * x - 0.313261687, 6) AS swoosh_r, round(x * {_sig('x / 2')}, 6) AS glu, round({_lae('x', '-x')}, 6) AS logaddexp,
      round(0.8139535143 * 0.5 * (ln(1 + tanh(x) * 0.9) - ln(1 - tanh(x) * 0.9)), 6) AS inverse_erf, round(ln(greatest(x, 1e-7)), 6) AS log_clipped, round((x - 3) / 3, 6) AS affine FROM e""",
    "length_formulas": """WITH n AS (SELECT unnest(range(1200)) AS n), r AS (SELECT n, CAST(floor((floor((floor((n % 100 - 1) / 2) + 1 - 1) / 2) + 1 - 1) / 2) + 1 AS BIGINT) AS w FROM n) SELECT n, CAST(floor((n - 7) / 2) AS BIGINT) AS subsampled, CAST(floor((n - 7) / 2) - 3 AS BIGINT) AS streaming,
      CAST(floor((n - 1) / 2) + 1 AS BIGINT) AS stride_two, CAST(floor((n + 1) / 2) AS BIGINT) AS halved, CAST(floor((n + 3) / 4) AS BIGINT) AS down, w + n // 100 * 13 AS windowed, CAST(ceil(n / 5) AS BIGINT) AS tokens, CAST(ceil(n / 20) AS BIGINT) AS tokens_4, CAST(ceil(n / 3200) AS BIGINT) AS tokens_640,
      greatest(CAST(ceil((480000 - (480000 - (n * 160) % 480000) % 480000) / 160) AS BIGINT), 50) AS last_chunk FROM r""",
    "bce_eval": "WITH e AS (SELECT event_type, (value - 20) / 10 AS x, event_id % 2 AS y FROM events) SELECT event_type, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS loss, count(*) AS n FROM e GROUP BY 1",
    "online_cutoff": """WITH RECURSIVE ev AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
      f(user_id, t, cutoff, n, above) AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT), 0.0::DOUBLE, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ev UNION ALL
        SELECT f.user_id, f.t + 1, CASE WHEN ((above + CAST(value > cutoff AS INT)) / (n + 1) - 0.3::DOUBLE > 0) = (value > cutoff) THEN value * abs((above + CAST(value > cutoff AS INT)) / (n + 1) - 0.3::DOUBLE) + cutoff * (1 - abs((above + CAST(value > cutoff AS INT)) / (n + 1) - 0.3::DOUBLE)) ELSE cutoff END, n + 1, above + CAST(value > cutoff AS INT)
        FROM f JOIN ev ON ev.user_id = f.user_id AND ev.t = f.t + 1)
      SELECT user_id, round(cutoff, 6) AS cutoff, n, above FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS k FROM f) WHERE k = 1""",
    "stop_suffix": _EV + ", a AS (SELECT user_id, list(event_type ORDER BY t) AS a FROM ev GROUP BY 1) SELECT user_id, coalesce(a[-2:] = ['view', 'click'], false) OR a[-1] = 'error' AS stopped FROM a",
    "array_ops": "WITH a AS (SELECT item_id, list_transform(options, lambda o: length(o)) AS a FROM test_items WHERE len(options) > 0) SELECT item_id, array_to_string(list_transform([1, 2, 3], lambda i: coalesce(a[i], 0)), ',') AS fit, array_to_string(flatten(list_transform(a, lambda x: [x, x])), ',') AS repeated, CASE WHEN len(a) > 1 THEN CAST(a[2] AS VARCHAR) || ',' ELSE '' END || CAST(a[1] AS VARCHAR) AS gathered, array_to_string(list_concat(a[1:1], [-1, -2], a[2:]), ',') AS spliced, array_to_string(list_transform(range(CAST(ceil(len(a) / 2) AS BIGINT)), lambda i: CAST(a[i * 2 + 1] AS VARCHAR) || '+' || CAST(coalesce(a[i * 2 + 2], 0) AS VARCHAR)), ',') AS chunks FROM a",
}

"""Queries of the corpus data plane, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import seeded
from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import rules as R
from corpusloom.operators import samples as S
from corpusloom.operators.rules import Rule
from corpusloom.session import lookup_join, table

# Parameters of the queries.
WANTED = ["pairmix", "talehall", "gigavoice", "capnook", "moodbox", "facevoice", "fieldclips", "opentongue", "wavtrove", "tunecards", "chartsong"]
RULES = [
    Rule("talehall", "swap", "/data/legacy/wav/", "/vault/speech/"),
    Rule("talehall", "extension", ".wav", ".flac"),
    Rule("gigavoice", "swap", "/mnt/vol3/corpora/", "/vault/speech/"),
    Rule("gigavoice", "swap", "/scratch/team5/sets/", "/vault/speech/"),
    Rule("facevoice", "swap", "/store/a1/audio/", "/vault/speech/"),
    Rule("capnook", "letter", "", "Y"),
    Rule("opentongue", "extension", ".wav", ".mp3"),
    Rule("wavtrove", "rebuild", ".flac", "/vault/speech/wavtrove/"),
]
PASSING, SLOTS, DEFAULT = ("gender_QA", "QA", "MC_QA"), {"slot_filling": "Which {} does the speaker name?"}, "Process the recording."
TASKS = ["asr", "QA", "qa_mc"]
DISPATCH = [(("gigavoice", "s_files"), "giga_small"), (("gigavoice",), "giga"), (("talehall", "360"), "tale_large"), (("talehall",), "tale"), (("mp3",), "lossy")]


def train(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train_samples")


def items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "test_items")


def inventory(s: SparkSession, d: str) -> DataFrame:
    """One row per path that was ever there: whether its last added entry has a valid length."""
    a = table(s, d, "audio_inventory").where("path is not null")
    return a.groupBy("path").agg(F.max_by(F.coalesce(F.col("duration_s") > 0, F.lit(False)), F.struct("added_at", "entry_id")).alias("valid"))


def extracted(s: SparkSession, d: str) -> DataFrame:
    return C.extract(train(s, d).select("row_idx", "audios"), inventory(s, d), WANTED, RULES)


def corpus_extract(s, d):
    return C.keep_rows(extracted(s, d))


def corpus_stats(s, d):
    it = extracted(s, d)
    both = C.kept_counts(C.keep_rows(it)).join(C.first_failures(it), "dataset", "full")
    return both.select("dataset", F.coalesce("n_kept", F.lit(0)).cast("bigint").alias("n_kept"), F.coalesce("n_failed", F.lit(0)).cast("bigint").alias("n_failed"))


def corpus_totals(s, d):
    kept = C.keep_rows(extracted(s, d)).agg(F.count(F.lit(1)).alias("n_kept"), F.coalesce(F.sum(F.size("datasets")), F.lit(0)).cast("bigint").alias("n_by_dataset"))
    return train(s, d).agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(kept)


def provenance_detect(s, d):
    return items(s, d).select("item_id", T.detect(F.col("path"), WANTED).alias("dataset"))


def path_rewrite_rules(s, d):
    named = items(s, d).select("item_id", "path", T.detect(F.col("path"), WANTED).alias("dataset"))
    return named.select("item_id", R.rewrite(F.col("path"), F.col("dataset"), RULES).alias("path"))


def lookup_left_default(s, d):
    known = table(s, d, "audio_inventory").where("path is not null").groupBy("path").agg(F.max("entry_id").cast("string").alias("entry"))
    return R.lookup(items(s, d).select("item_id", "path"), "path", known, "entry").select("item_id", "entry")


def prompt_select(s, d):
    t = table(s, d, "task_prompts").groupBy("task").agg(F.min("prompt").alias("prompt"))
    joined = lookup_join(items(s, d).select("item_id", "task", "q"), t, "task", "left")
    return joined.select("item_id", S.prompt_for(F.col("task"), F.col("q"), F.col("prompt"), DEFAULT, PASSING, SLOTS).alias("prompt"))


def path_semi(s, d):
    return items(s, d).select("item_id", "path").join(inventory(s, d), "path", "left_semi")


def path_anti(s, d):
    return items(s, d).select("item_id", "path").join(inventory(s, d), "path", "left_anti")


def first_existing_candidate(s, d):
    p = F.col("path")
    cand = F.array(T.swap_extension(p, ".wav", ".flac"), T.prefix_basename(p, "Y"), T.replace_all(p, "/data/legacy/wav/", "/vault/speech/"))
    return R.first_existing(items(s, d).select("item_id", "path"), "item_id", cand, inventory(s, d), p).select("item_id", "chosen")


def task_filter(s, d):
    return train(s, d).where(C.in_tasks(F.col("task_type"), TASKS)).select("row_idx", "task_type")


def route_by_type(s, d):
    t = F.col("task_type")
    mc = (t == "qa_mc") & F.col("mc_options").isNotNull() & F.col("mc_question").isNotNull()
    return train(s, d).select("row_idx", F.when(mc, "mc").when(t == "audio_caption", "caption").otherwise("plain").alias("route"))


def dispatch_substring(s, d):
    return items(s, d).select("item_id", T.dispatch(F.col("path"), DISPATCH, "other").alias("config"))


def bool_parse(s, d):
    values = ["Yes", "TRUE", "t", "y", "1", "no", "False", "F", "n", "0", None]
    return s.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", T.parse_bool(F.col("v")).alias("b"))


def resume_offset(s, d):
    return table(s, d, "orders").where(F.col("o_orderkey") >= 7000).select("o_orderkey", "o_totalprice")


def batch_assign(s, d):
    first = F.col("row_idx") - 1_000_000_000
    kept = train(s, d).select("row_idx", "task_type", C.batches(first, 16).alias("batch")).where(C.in_tasks(F.col("task_type"), TASKS))
    return kept.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


def stride_partition(s, d):
    return table(s, d, "orders").groupBy(C.stride(F.col("o_orderkey"), 4).alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _parts(s, d):
    """Orders as four workers would have written them, every seventh line lost."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey"))
    parts = o.select(C.stride(F.col("o_orderkey"), 4).alias("worker"), F.floor(F.col("o_orderkey") / 4).alias("line"), "o_custkey")
    return parts.where("line % 7 <> 3")


def stride_merge(s, d):
    return C.stride_merge(_parts(s, d), 4).select("row_idx", "o_custkey").orderBy("row_idx")


def gap_report(s, d):
    total = table(s, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return C.gaps(C.stride_merge(_parts(s, d), 4), (total or 0) + 1)


def _run(s, d, run_id):
    r = table(s, d, "result_rows").where((F.col("run_id") == run_id) & F.col("item_id").isNotNull())
    return r.groupBy("item_id").agg(F.max_by("response", F.struct("finished_at", "response")).alias("response"))


def response_diff(s, d):
    return C.differing(_run(s, d, "base_a"), _run(s, d, "tuned_b"), ["item_id"], "response")


def response_diff_count(s, d):
    a, b = _run(s, d, "base_a"), _run(s, d, "tuned_b")
    both = a.select("item_id", F.col("response").alias("a")).join(b.select("item_id", F.col("response").alias("b")), "item_id")
    return both.agg(F.count(F.lit(1)).alias("n_both"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differ"))


def response_clean(s, d):
    return table(s, d, "result_rows").select("run_id", "item_id", "finished_at", T.after_reasoning(F.col("response")).alias("response"))


def messages_collect(s, d):
    turns = train(s, d).select("row_idx", F.posexplode("messages").alias("pos", "m"))
    return turns.groupBy("row_idx").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m.role"))), lambda x: x.role), ">").alias("roles"))


def chat_verify(s, d):
    return train(s, d).groupBy(S.is_valid_chat(F.col("messages")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def punctuate(s, d):
    turns = train(s, d).select("row_idx", F.posexplode(S.punctuated(F.col("messages"))).alias("pos", "m"))
    return turns.select("row_idx", "pos", "m.content")


def _options(df: DataFrame) -> DataFrame:
    mc = df.where((F.col("task_type") == "qa_mc") & F.col("mc_options").isNotNull() & F.col("mc_question").isNotNull())
    return mc.select("row_idx", "mc_question", S.options(F.col("mc_options"), F.col("mc_answer_index"), F.col("mc_answer_label")).alias("opts"))


def mc_build(s, d):
    o = _options(train(s, d)).withColumn("label", S.right_label(F.col("opts")))
    return o.select("row_idx", S.mc_prompt(F.col("mc_question"), F.col("opts")).alias("prompt"), S.mc_answer(F.col("label")).alias("answer"))


def mc_shuffle_md5(s, d):
    o = _options(train(s, d)).withColumn("opts", seeded.shuffled(F.col("opts"), 42, F.col("row_idx")))
    return o.select("row_idx", F.array_join(F.transform("opts", lambda x: F.coalesce(x.content, F.lit(""))), "|").alias("shown"), S.right_label(F.col("opts")).alias("label"))


def mc_line(s, d):
    return items(s, d).where("options is not null").select("item_id", S.mc_line(F.col("q"), F.col("options")).alias("line"))


def caption_pick_md5(s, d):
    t = train(s, d).where("task_type = 'audio_caption'").where("long_caption is not null or short_caption is not null")
    picks = [S.caption(F.col("long_caption"), F.col("short_caption"), k, 42, F.col("row_idx")).alias(k) for k in ("long", "short", "both")]
    return t.select("row_idx", *picks).select("row_idx", F.col("long.caption").alias("long_pick"), F.col("short.caption").alias("short_pick"), F.col("both.prompt").alias("both_prompt"), F.col("both.caption").alias("both_pick"))


def placeholder_expand(s, d):
    t = train(s, d).where(F.size("messages") > 0)
    chunks = F.transform(F.coalesce("audios", F.array().cast("array<string>")), lambda a, i: (F.pmod(F.coalesce(F.length(a), F.lit(0)), F.lit(3)) + 1))
    return t.select("row_idx", S.expand(F.get("messages", F.lit(0)).content, chunks).alias("text"))


def path_list_concat(s, d):
    lists = items(s, d).select("item_id", C.path_list(F.col("path"), F.col("expand_wav")).alias("paths"))
    return lists.select("item_id", F.size("paths").cast("bigint").alias("n"), F.array_join("paths", "|", "NULL").alias("paths"), S.prompt_prefix(F.size("paths"), F.lit("Go.")).alias("prompt"))


def multi_insert(s, d):
    kept = C.keep_rows(extracted(s, d))
    to = F.explode(F.concat(F.array(F.lit("combined")), "datasets"))
    return kept.select(to.alias("target"), "row_idx").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"))


def broken_replacement(s, d):
    o = table(s, d, "orders").select((F.col("o_orderkey") - 1).alias("row_idx"))
    return C.replacement(o, "row_idx", o.where(F.pmod(F.col("row_idx"), F.lit(3)) == 1), 4)


def path_parts(s, d):
    p = F.col("path")
    return items(s, d).select("item_id", T.basename(p).alias("base"), T.dirname(p).alias("dir"), T.stem(p).alias("stem"), T.suffix(p).alias("suffix"), T.part(p, "/", 3).alias("third"), F.concat_ws("/", T.dirname(p), T.basename(p)).alias("again"))


QUERIES = {f.__name__: f for f in (
    corpus_extract, corpus_stats, corpus_totals, provenance_detect, path_rewrite_rules, lookup_left_default, prompt_select, path_semi, path_anti, first_existing_candidate,
    task_filter, route_by_type, dispatch_substring, bool_parse, resume_offset, batch_assign, stride_partition, stride_merge, gap_report, response_diff, response_diff_count,
    response_clean, messages_collect, chat_verify, punctuate, mc_build, mc_shuffle_md5, mc_line, caption_pick_md5, placeholder_expand, path_list_concat, multi_insert,
    broken_replacement, path_parts,
)}

# --- SQL ---------------------------------------------------------------------------------------------------------
_W = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def detect_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), {q(w)}) THEN {q(w)}" for w in WANTED) + " END"


def h60(*keys: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(keys) + ")), 1, 15) AS BIGINT)"


def base_sql(c: str) -> str:
    return f"regexp_extract({c}, '([^/]*)$', 1)"


def dir_sql(c: str) -> str:
    return f"regexp_extract({c}, '^(.*)/[^/]*$', 1)"


def stem_sql(c: str) -> str:
    return f"regexp_replace({base_sql(c)}, '(.)\\.[^.]*$', '\\1')"


def ext_sql(c: str, a: str, b: str) -> str:
    return f"CASE WHEN {c} LIKE '%{a}' THEN left({c}, length({c}) - {len(a)}) || '{b}' ELSE {c} END"


def letter_sql(c: str, x: str) -> str:
    return f"CASE WHEN contains({c}, '/') THEN {dir_sql(c)} || '/{x}' || {base_sql(c)} ELSE '{x}' || {c} END"


REWRITE_SQL = "CASE dataset " + " ".join([
    "WHEN 'talehall' THEN " + ext_sql("replace({c}, '/data/legacy/wav/', '/vault/speech/')", ".wav", ".flac"),
    "WHEN 'gigavoice' THEN replace(replace({c}, '/mnt/vol3/corpora/', '/vault/speech/'), '/scratch/team5/sets/', '/vault/speech/')",
    "WHEN 'facevoice' THEN replace({c}, '/store/a1/audio/', '/vault/speech/')",
    "WHEN 'capnook' THEN " + letter_sql("{c}", "Y"),
    "WHEN 'opentongue' THEN " + ext_sql("{c}", ".wav", ".mp3"),
    "WHEN 'wavtrove' THEN '/vault/speech/wavtrove/' || " + base_sql(dir_sql("{c}")) + " || '/' || " + stem_sql("{c}") + " || '.flac'",
]) + " ELSE {c} END"

_INV = "inv AS (SELECT path, arg_max(coalesce(duration_s > 0, false), (added_at, entry_id)) AS valid FROM audio_inventory WHERE path IS NOT NULL GROUP BY path)"
_ITEMS = f"""WITH {_INV},
it0 AS (SELECT row_idx, generate_subscripts(audios, 1) - 1 AS pos, unnest(audios) AS item FROM train_samples),
it1 AS (SELECT *, {detect_sql('item')} AS dataset FROM it0),
it2 AS (SELECT *, CASE WHEN dataset IS NOT NULL THEN {REWRITE_SQL.format(c='item')} END AS target FROM it1),
it AS (SELECT row_idx, pos, item, dataset, coalesce(target, item) AS path,
  CASE WHEN dataset IS NULL THEN NULL WHEN valid IS NULL THEN 'absent' WHEN target LIKE '%.mp3' AND NOT valid THEN 'broken' END AS failure
  FROM it2 LEFT JOIN inv ON it2.target = inv.path),
kept AS (SELECT row_idx, list(path ORDER BY pos) AS audios, list_sort(list_distinct(list(dataset))) AS datasets FROM it GROUP BY row_idx HAVING count(dataset) > 0 AND count(failure) = 0),
failed AS (SELECT dataset, count(*) AS n_failed FROM (SELECT row_idx, arg_min(dataset, pos) AS dataset FROM it WHERE failure IS NOT NULL GROUP BY row_idx) GROUP BY dataset)
"""


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def punct_sql(c: str) -> str:
    r = f"regexp_replace({c}, '{_W}+$', '')"
    return f"CASE WHEN length({r}) > 0 AND NOT regexp_matches({r}, '[.?!,]$') THEN {r} || '.' ELSE {c} END"


def caps_sql(c: str) -> str:
    return f"list_filter(list_transform({c}, lambda x: {strip_sql('x')}), lambda x: x IS NOT NULL AND x <> '')"


_OPTS = """opts AS (SELECT row_idx, mc_question, mc_answer_label, mc_answer_index, CAST(mc_options AS JSON) AS j FROM train_samples
  WHERE task_type = 'qa_mc' AND mc_options IS NOT NULL AND mc_question IS NOT NULL),
o1 AS (SELECT *, json_type(j, '$[0]') = 'OBJECT' AS objects, json_array_length(j) AS n FROM opts),
o2 AS (SELECT row_idx, i, CASE WHEN objects THEN j->(i::INT)->>'$.content' ELSE j->>(i::INT) END AS content,
    j->(i::INT)->>'$.is_correct' AS flag, j->(i::INT)->>'$.label' AS label, objects, mc_question, mc_answer_label, mc_answer_index
  FROM o1, unnest(range(CAST(n AS BIGINT))) AS u(i)),
o3 AS (SELECT *, max(flag) OVER (PARTITION BY row_idx) IS NOT NULL AS flagged FROM o2),
o AS (SELECT row_idx, i, content, mc_question, coalesce(CASE WHEN objects AND flagged THEN flag = 'true' WHEN objects THEN coalesce(label, '') = coalesce(mc_answer_label, '') ELSE mc_answer_index = i END, false) AS ok FROM o3)"""
_LABEL = "CASE WHEN {i} < 26 THEN chr(65 + {i}::INT) ELSE CAST({i} + 1 AS VARCHAR) END"
_PICK = "CASE WHEN len({a}) > 0 THEN {a}[1 + {h} % len({a})] END"
_PARTS = "parts AS (SELECT o_orderkey % 4 AS worker, o_orderkey // 4 AS line, o_custkey FROM orders WHERE (o_orderkey // 4) % 7 <> 3)"


def _lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"



_RUNS = """a AS (SELECT item_id, response FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY finished_at DESC, response DESC NULLS LAST) AS k FROM result_rows WHERE run_id = 'base_a' AND item_id IS NOT NULL) WHERE k = 1),
b AS (SELECT item_id, response FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY finished_at DESC, response DESC NULLS LAST) AS k FROM result_rows WHERE run_id = 'tuned_b' AND item_id IS NOT NULL) WHERE k = 1)"""

ORACLE = {
    "corpus_extract": _ITEMS + "SELECT row_idx, audios, datasets FROM kept",
    "corpus_stats": _ITEMS + "SELECT coalesce(k.dataset, f.dataset) AS dataset, coalesce(n_kept, 0) AS n_kept, coalesce(n_failed, 0) AS n_failed FROM (SELECT dataset, count(*) AS n_kept FROM (SELECT unnest(datasets) AS dataset FROM kept) GROUP BY dataset) k FULL JOIN failed f ON k.dataset = f.dataset",
    "corpus_totals": _ITEMS + "SELECT (SELECT count(*) FROM train_samples) AS n_rows, count(*) AS n_kept, CAST(coalesce(sum(len(datasets)), 0) AS BIGINT) AS n_by_dataset FROM kept",
    "provenance_detect": f"SELECT item_id, {detect_sql('path')} AS dataset FROM test_items",
    "path_rewrite_rules": f"SELECT item_id, {REWRITE_SQL.format(c='path')} AS path FROM (SELECT item_id, path, {detect_sql('path')} AS dataset FROM test_items)",
    "lookup_left_default": "SELECT item_id, coalesce(CAST(e AS VARCHAR), '') AS entry FROM test_items t LEFT JOIN (SELECT path, max(entry_id) AS e FROM audio_inventory GROUP BY path) i ON t.path = i.path",
    "prompt_select": f"SELECT item_id, CASE WHEN t.task IN ('gender_QA', 'QA', 'MC_QA') THEN coalesce(q, '') WHEN t.task = 'slot_filling' THEN 'Which ' || coalesce(q, '') || ' does the speaker name?' ELSE coalesce(p.prompt, {q(DEFAULT)}) END AS prompt FROM test_items t LEFT JOIN task_prompts p ON t.task = p.task",
    "path_semi": "SELECT item_id, path FROM test_items WHERE path IN (SELECT path FROM audio_inventory WHERE path IS NOT NULL)",
    "path_anti": "SELECT item_id, path FROM test_items t WHERE NOT EXISTS (SELECT 1 FROM audio_inventory i WHERE i.path = t.path)",
    "first_existing_candidate": f"WITH c AS (SELECT item_id, path AS own, unnest([1, 2, 3]) AS prio, unnest([{ext_sql('path', '.wav', '.flac')}, {letter_sql('path', 'Y')}, replace(path, '/data/legacy/wav/', '/vault/speech/')]) AS cand FROM test_items) SELECT t.item_id, coalesce(b.best, t.path) AS chosen FROM test_items t LEFT JOIN (SELECT item_id, arg_min(cand, prio) AS best FROM c WHERE cand IN (SELECT path FROM audio_inventory WHERE path IS NOT NULL) GROUP BY item_id) b ON t.item_id = b.item_id",
    "task_filter": "SELECT row_idx, task_type FROM train_samples WHERE task_type IN ('asr', 'QA', 'qa_mc')",
    "route_by_type": "SELECT row_idx, CASE WHEN task_type = 'qa_mc' AND mc_options IS NOT NULL AND mc_question IS NOT NULL THEN 'mc' WHEN task_type = 'audio_caption' THEN 'caption' ELSE 'plain' END AS route FROM train_samples",
    "dispatch_substring": "SELECT item_id, CASE WHEN contains(path, 'gigavoice') AND contains(path, 's_files') THEN 'giga_small' WHEN contains(path, 'gigavoice') THEN 'giga' WHEN contains(path, 'talehall') AND contains(path, '360') THEN 'tale_large' WHEN contains(path, 'talehall') THEN 'tale' WHEN contains(path, 'mp3') THEN 'lossy' ELSE 'other' END AS config FROM test_items",
    "bool_parse": "SELECT CAST(i AS INT) AS i, CASE WHEN lower(v) IN ('yes', 'true', 't', 'y', '1') THEN true WHEN lower(v) IN ('no', 'false', 'f', 'n', '0') THEN false END AS b FROM (VALUES (0, 'Yes'), (1, 'TRUE'), (2, 't'), (3, 'y'), (4, '1'), (5, 'no'), (6, 'False'), (7, 'F'), (8, 'n'), (9, '0'), (10, NULL)) t(i, v)",
    "resume_offset": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 7000",
    "batch_assign": "SELECT (row_idx - 1000000000) // 16 AS batch, count(*) AS n, min(row_idx) AS first_row, max(row_idx) AS last_row FROM train_samples WHERE task_type IN ('asr', 'QA', 'qa_mc') GROUP BY 1",
    "stride_partition": "SELECT o_orderkey % 4 AS worker, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "stride_merge": f"WITH {_PARTS} SELECT worker + line * 4 AS row_idx, o_custkey FROM parts ORDER BY 1",
    "gap_report": f"WITH {_PARTS} SELECT i AS row_idx FROM (SELECT unnest(range((SELECT max(o_orderkey) + 1 FROM orders))) AS i) WHERE i NOT IN (SELECT worker + line * 4 FROM parts)",
    "response_diff": f"WITH {_RUNS} SELECT a.item_id, a.response AS a, b.response AS b FROM a JOIN b USING (item_id) WHERE a.response IS DISTINCT FROM b.response",
    "response_diff_count": f"WITH {_RUNS} SELECT count(*) AS n_both, count(*) FILTER (WHERE a.response IS DISTINCT FROM b.response) AS n_differ FROM a JOIN b USING (item_id)",
    "response_clean": "SELECT run_id, item_id, finished_at, " + strip_sql("string_split(response, '</think>')[-1]") + " AS response FROM result_rows",
    "messages_collect": "SELECT row_idx, len(messages) AS n_turns, array_to_string(list_transform(messages, lambda m: m.role), '>') AS roles FROM train_samples WHERE len(messages) > 0",
    "chat_verify": "SELECT coalesce(len(messages) = 2 AND coalesce(contains(messages[1].content, '<audio>'), false), false) AS valid, count(*) AS n FROM train_samples GROUP BY 1",
    "punctuate": "SELECT row_idx, CAST(pos AS INT) AS pos, " + punct_sql("content") + " AS content FROM (SELECT row_idx, generate_subscripts(messages, 1) - 1 AS pos, unnest(messages).content AS content FROM train_samples)",
    "mc_build": f"WITH {_OPTS} SELECT row_idx, {q(S.MC_HEAD)} || chr(10) || 'Question: ' || {strip_sql('any_value(mc_question)')} || chr(10) || 'Choices:' || chr(10) || string_agg('Option ' || {_LABEL.format(i='i')} || ': ' || coalesce(content, ''), chr(10) ORDER BY i) || chr(10) || chr(10) || {q(S.MC_TAIL)} AS prompt, '{{\"answer\": \"' || arg_max({_LABEL.format(i='i')}, i) FILTER (WHERE ok) || '\"}}' AS answer FROM o GROUP BY row_idx",
    "mc_shuffle_md5": f"WITH {_OPTS}, h AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY {h60('42', 'row_idx', 'i')}, i) - 1 AS k FROM o) SELECT row_idx, string_agg(coalesce(content, ''), '|' ORDER BY k) AS shown, arg_max({_LABEL.format(i='k')}, k) FILTER (WHERE ok) AS label FROM h GROUP BY row_idx",
    "mc_line": "SELECT item_id, coalesce(q, '') || ' ' || coalesce(array_to_string(list_transform(options, lambda x, i: chr(64 + i::INT) || '. ' || x), ' '), '') AS line FROM test_items WHERE options IS NOT NULL",
    "caption_pick_md5": f"""WITH c AS (SELECT row_idx, long_caption AS l0, short_caption AS s0, {caps_sql('long_caption')} AS l, {caps_sql('short_caption')} AS s,
      {h60('42', 'row_idx')} AS h, {h60('42', 'row_idx', "'kind'")} % 1000000 < 500000 AS short, {h60('42', 'row_idx', "'prompt'")} AS hp FROM train_samples WHERE task_type = 'audio_caption' AND (long_caption IS NOT NULL OR short_caption IS NOT NULL))
      SELECT row_idx, {_PICK.format(a='l', h='h')} AS long_pick, {_PICK.format(a='s', h='h')} AS short_pick,
      CASE WHEN l0 IS NOT NULL AND s0 IS NOT NULL THEN '<audio>' || CASE WHEN short THEN {_lst(S.SHORT_PROMPTS)}[1 + hp % 2] ELSE {_lst(S.LONG_PROMPTS)}[1 + hp % 3] END END AS both_prompt,
      CASE WHEN l0 IS NOT NULL AND s0 IS NOT NULL THEN CASE WHEN short THEN {_PICK.format(a='s', h='h')} ELSE {_PICK.format(a='l', h='h')} END END AS both_pick FROM c""",
    "placeholder_expand": f"""SELECT row_idx, array_to_string(list_transform(string_split(messages[1].content, '<audio>'), lambda p, i: CASE WHEN i = 1 THEN p
      WHEN i - 1 <= coalesce(len(audios), 0) THEN repeat('{S.BEGIN}', (coalesce(length(audios[(i - 1)::INT]), 0) % 3 + 1)::INT) || '{S.END}' || p ELSE '<audio>' || p END), '') AS text FROM train_samples WHERE len(messages) > 0""",
    "path_list_concat": "SELECT item_id, 1 + coalesce(len(expand_wav), 0) AS n, array_to_string(list_transform(list_concat([path], coalesce(expand_wav, [])), lambda x: coalesce(x, 'NULL')), '|') AS paths, repeat('<audio>', (1 + coalesce(len(expand_wav), 0))::INT) || 'Go.' AS prompt FROM test_items",
    "multi_insert": _ITEMS + "SELECT target, count(*) AS n, min(row_idx) AS first_row FROM (SELECT row_idx, unnest(list_concat(['combined'], datasets)) AS target FROM kept) GROUP BY 1",
    "broken_replacement": f"WITH n AS (SELECT count(*) AS n FROM orders), b AS (SELECT o_orderkey - 1 AS r FROM orders WHERE (o_orderkey - 1) % 3 = 1), t AS (SELECT r, a, {h60('42', 'r', 'a')} % n AS taken FROM b, n, (VALUES (1), (2), (3), (4)) v(a)), g AS (SELECT r, min((a, taken)) AS g FROM (SELECT r, CAST(a AS INT) AS a, taken FROM t WHERE taken % 3 <> 1 OR taken NOT IN (SELECT r FROM b)) GROUP BY r) SELECT b.r AS row, g.g[2] AS taken, g.g[1] AS attempt FROM b LEFT JOIN g ON b.r = g.r",
    "path_parts": f"SELECT item_id, {base_sql('path')} AS base, {dir_sql('path')} AS dir, {stem_sql('path')} AS stem, regexp_extract({base_sql('path')}, '.(\\.[^.]*)$', 1) AS suffix, split_part(path, '/', 3) AS third, {dir_sql('path')} || '/' || {base_sql('path')} AS again FROM test_items",
}

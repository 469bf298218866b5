"""Queries that write files of each kind to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.corpus import items
from corpusloom.session import table
from corpusloom.sources import manifests as M

ITEM = ("path", "task", "q", "options", "expand_wav", "text", "question", "answer")


def document_scan(s, d):
    """Test items as JSON documents of up to 500 items under one root, then scanned item by item."""
    t = items(s, d).select(F.floor(F.col("item_id") / 500).alias("doc"), "item_id", F.struct(*[F.col(c).alias("Q" if c == "q" else c) for c in ITEM]).alias("v"))
    docs = t.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("item_id", F.to_json("v").alias("j")))).alias("a"))
    text = docs.select(F.concat(F.lit('{"annotation": ['), F.array_join(F.transform("a", lambda x: x.j), ", "), F.lit("]}")).alias("value"))
    folder = M.staging(s, "documents")
    text.repartition(max(1, docs.count())).write.option("lineSep", "\n").text(folder)
    back = M.read_test_manifest(s, folder)
    return back.groupBy("path", "task", "Q", "text", "question").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("options"), F.lit(0))).alias("n_options")).withColumnRenamed("Q", "q")


def jsonl_scan(s, d):
    folder = M.staging(s, "lines")
    M.append_jsonl(table(s, d, "result_rows").select("run_id", "item_id", "response"), folder)
    back = M.read_jsonl(s, folder, "run_id string, item_id bigint, response string")
    return back.select("run_id", "item_id", "response")


def lookup_scan(s, d):
    """A table of two columns as text; of repeated keys the last line wins."""
    folder = M.staging(s, "map")
    t = table(s, d, "orders").select(F.format_string("%d\t %d ", F.col("o_orderkey"), F.col("o_custkey")).alias("value"), "o_orderkey")
    t.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(folder)
    return M.read_lookup(s, folder).select(F.col("key").cast("bigint").alias("k"), F.col("value").cast("bigint").alias("v"))


def part_merge(s, d):
    folder = M.staging(s, "parts")
    M.write_parts(table(s, d, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_totalprice"), folder, 4)
    return M.merge_parts(s, folder, "row_idx bigint, o_totalprice double").select("row_idx", F.col("worker").cast("bigint").alias("worker"), "o_totalprice").orderBy("row_idx")


def ascii_escape(s, d):
    t = table(s, d, "train_samples").select("row_idx", M.ascii_json(F.to_json(F.struct(F.col("messages")))).alias("j"))
    back = F.from_json("j", f"messages {M.MESSAGE}").messages
    return t.select("row_idx", (F.octet_length("j") == F.length("j")).alias("is_ascii"), F.octet_length(F.array_join(F.transform(back, lambda m: F.coalesce(m.content, F.lit(""))), "")).cast("bigint").alias("n_text"))


QUERIES = {f.__name__: f for f in (document_scan, jsonl_scan, lookup_scan, part_merge, ascii_escape)}
ORACLE = {
    "ascii_escape": "SELECT row_idx, true AS is_ascii, CAST(strlen(coalesce(array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ''), '')) AS BIGINT) AS n_text FROM train_samples",
    "document_scan": "SELECT path, task, q, text, question, count(*) AS n, CAST(sum(coalesce(len(options), 0)) AS BIGINT) AS n_options FROM test_items GROUP BY ALL",
    "jsonl_scan": "SELECT run_id, item_id, response FROM result_rows",
    "lookup_scan": "SELECT o_orderkey AS k, o_custkey AS v FROM orders",
    "part_merge": "SELECT o_orderkey AS row_idx, o_orderkey % 4 AS worker, o_totalprice FROM orders ORDER BY 1",
}

"""Readers and writers of manifests, results and lookup tables.

Row order is the identity of rows in these files, so every reader attaches it as ``row_idx``. For a document that holds
a root list it is the place in the list; for line files it is (file, line), kept by ``line_numbers`` through per-file
counts.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import shared_dir, written

MESSAGE = "array<struct<role:string,content:string>>"
TRAIN_FIELDS = f"messages {MESSAGE}, audios array<variant>, task_type string, mc_question string, mc_options variant, mc_answer_label string, mc_answer_index bigint, long_caption array<string>, short_caption array<string>"
TEST_FIELDS = "path string, task string, Q string, options array<string>, expand_wav array<string>, text string, question string, answer array<string>"


def read_documents(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Items of the root list of JSON documents as (doc, row_idx, item VARIANT).

    One document per file. Items that are no objects are skipped but keep their place; a document without the root or
    with a root that is no list gives no rows, as does one that is no JSON.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.try_parse_json("value").alias("v"))
    items = F.try_variant_get("v", f"$.{root}", "array<variant>")
    rows = text.select("doc", F.posexplode(items).alias("row_idx", "item"))
    return rows.where(F.schema_of_variant("item").startswith("OBJECT")).withColumn("row_idx", F.col("row_idx").cast("bigint"))


def fields(df: DataFrame, ddl: str) -> DataFrame:
    """(doc, row_idx, item) to typed columns; fields that are absent or of another type become null."""
    schema = T.StructType.fromDDL(ddl)
    return df.select("doc", "row_idx", *[F.try_variant_get("item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def read_train_manifest(spark: SparkSession, path: str) -> DataFrame:
    return fields(read_documents(spark, path, "data"), TRAIN_FIELDS)


def read_test_manifest(spark: SparkSession, path: str) -> DataFrame:
    return fields(read_documents(spark, path, "annotation"), TEST_FIELDS)


def text_items(items: Column) -> Column:
    """Texts of a list of variants; items of other types are null, so that they pass as unmatched."""
    return F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (file, line, value), lines counted from 0 within each file.

    Files are split at will; each split numbers its lines by their order and offsets come from counts of the splits
    before it in the same file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), "value")
    kept = written(raw, "lines")
    per = kept.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = per.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = kept.join(before.select("file", "start", "offset", "first"), ["file", "start"])
    return joined.select(F.element_at(F.split("file", "/"), -1).alias("file"), (F.col("seq") - F.col("first") + F.col("offset")).cast("bigint").alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines with (file, line); a line that is no JSON, also a blank one, is an error."""
    lines = line_numbers(spark, path)
    ok = F.assert_true(F.trim(F.col("value")) != "", "blank line")
    return lines.where(ok.isNull()).select("file", "line", F.from_json("value", ddl, {"mode": "FAILFAST"}).alias("r")).select("file", "line", "r.*")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Two columns of text between white space as (key, value): the last line of a key wins, a line that doesn't hold
    exactly two pieces is an error."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    lines = line_numbers(spark, path).withColumn("p", parts)
    ok = F.assert_true(F.size("p") == 2, F.concat(F.lit("not two pieces: "), F.col("value")))
    return lines.where(ok.isNull()).groupBy(F.get("p", F.lit(0)).alias("key")).agg(F.max_by(F.get("p", F.lit(1)), F.struct("file", "line")).alias("value"))


def ascii_json(c: Column) -> Column:
    """JSON text with everything beyond ASCII as \\uXXXX, surrogate pairs included."""

    def escaped(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return F.when(ch.rlike(r"^[\x00-\x7F]$"), ch).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    return F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(c, ""), escaped), "")).otherwise(c)


def write_document(df: DataFrame, path: str, root: str = "data", order: str = "row_idx", indent: int | None = 2) -> None:
    """One JSON document with a root list, in order, beyond ASCII escaped.

    Lines are made and sorted by Spark and streamed to the file one partition at a time, so that the driver never holds
    the whole list. The folder is made; an existing file is replaced.
    """
    lines = df.orderBy(order).select(F.to_json(F.struct(*[c for c in df.columns if c != order])).alias("j"))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="ascii") as out:
        out.write("{" + json.dumps(root) + ": [")
        for i, r in enumerate(lines.toLocalIterator()):
            body = json.dumps(json.loads(r["j"]), ensure_ascii=True, indent=indent)
            out.write(("," if i else "") + "\n" + body)
        out.write("\n]}\n")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends part files of JSON lines, UTF-8 unescaped, null fields kept."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_config(config: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config, indent=2, sort_keys=True))


def read_config(path: str, defaults: dict, section: str = "model_args") -> dict:
    """Defaults overridden by what the section of the ``config.json`` beside a checkpoint says; absent files change
    nothing, keys that aren't among the defaults are ignored."""
    file = Path(path).parent / "config.json"
    found = json.loads(file.read_text()).get(section, {}) if file.exists() else {}
    return {k: found[k] if found.get(k) is not None else v for k, v in defaults.items()}


def write_parts(df: DataFrame, path: str, n: int, index: str = "row_idx") -> None:
    """Rows dealt to n workers, one folder each, in the order of the index. The staging folder has a name of its own."""
    dealt = df.withColumn("worker", F.pmod(index, F.lit(n)))
    dealt.repartition(n, "worker").sortWithinPartitions("worker", index).write.partitionBy("worker").mode("error").json(path)


def merge_parts(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """All parts, to be ordered by the index they carry."""
    return spark.read.schema(ddl + ", worker int").json(path)


def staging(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder as (path, length, modified) without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))

"""The corpus data plane: extraction, batching, striding, merging and comparison of manifests and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.rules import Rule, rewrite
from corpusloom.session import lookup_join


def extract(samples: DataFrame, inventory: DataFrame, wanted: list[str], rules: list[Rule], probed: tuple[str, ...] = (".mp3",)) -> DataFrame:
    """Items of all samples with the data set they belong to, the rewritten path and the way they fail, if they do.

    ``samples``: (row_idx, audios); ``inventory``: (path, valid), one row per path. Items without a data set pass
    unchecked. A matched item fails as ``absent`` if the rewritten path isn't in the inventory, as ``broken`` if it has
    a probed ending and isn't valid. Null items are no text and pass; null and empty lists have no items.
    """
    item = samples.select("row_idx", F.posexplode("audios").alias("pos", "item"))
    named = item.withColumn("dataset", T.detect(F.col("item"), wanted))
    target = named.withColumn("path", F.when(F.col("dataset").isNotNull(), rewrite(F.col("item"), F.col("dataset"), rules)))
    there = inventory.select("path", F.coalesce("valid", F.lit(False)).alias("valid")).where("path is not null")
    seen = lookup_join(target, there, "path", "left")
    broken = T.ends_with_any(F.col("path"), probed) & ~F.col("valid") if probed else F.lit(False)
    failure = F.when(F.col("dataset").isNull(), None).when(F.col("valid").isNull(), "absent").when(broken, "broken")
    return seen.select("row_idx", "pos", "item", "dataset", F.coalesce("path", "item").alias("path"), failure.alias("failure"))


def keep_rows(items: DataFrame) -> DataFrame:
    """Rows with at least one matched item and no failed one: (row_idx, audios, datasets)."""
    rows = items.groupBy("row_idx").agg(
        F.count("dataset").alias("matched"), F.count("failure").alias("failed"), F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("list"), F.array_sort(F.collect_set("dataset")).alias("datasets")
    )
    return rows.where("matched > 0 and failed = 0").select("row_idx", F.col("list.path").alias("audios"), "datasets")


def first_failures(items: DataFrame) -> DataFrame:
    """Failures per data set; a row counts once, for the data set of its first failing item."""
    first = items.where("failure is not null").groupBy("row_idx").agg(F.min_by(F.struct("dataset", "failure"), "pos").alias("f"))
    return first.groupBy(F.col("f.dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n_failed"))


def kept_counts(kept: DataFrame) -> DataFrame:
    """Kept rows per data set; a row counts for each data set it holds."""
    return kept.select(F.explode("datasets").alias("dataset")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_kept"))


def in_tasks(task: Column, tasks: list[str]) -> Column:
    """Whether the task is one of those named; no names keep all rows, null tasks go otherwise."""
    return F.coalesce(task.isin(tasks), F.lit(False)) if tasks else F.lit(True)


def batches(row_idx: Column, size: int) -> Column:
    """Number of the fixed-size batch of a row."""
    return F.floor(row_idx / size).cast("bigint")


def stride(row_idx: Column, n: int) -> Column:
    """Worker of a row when rows are dealt in turn."""
    return F.pmod(row_idx, F.lit(n)).cast("bigint")


def stride_merge(parts: DataFrame, n: int) -> DataFrame:
    """Global index of line ``line`` of worker ``worker``: worker + line * n."""
    return parts.withColumn("row_idx", (F.col("worker") + F.col("line") * n).cast("bigint"))


def gaps(found: DataFrame, total: int) -> DataFrame:
    """Indexes below ``total`` that are missing in ``found`` (row_idx)."""
    spark = found.sparkSession
    return spark.range(total).withColumnRenamed("id", "row_idx").join(found.select("row_idx").distinct(), "row_idx", "left_anti")


def differing(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows in both whose values differ; two nulls are equal, a null and a text differ."""
    left = a.select(*keys, F.col(value).alias("a"))
    right = b.select(*keys, F.col(value).alias("b"))
    return left.join(right, keys).where(~F.col("a").eqNullSafe(F.col("b")))


def path_list(path: Column, extra: Column) -> Column:
    """The main path, then the extra ones; a null list adds none."""
    return F.concat(F.array(path), F.coalesce(extra, F.array().cast("array<string>")))


def replacement(ids: DataFrame, id_col: str, broken: DataFrame, tries: int, seed: int = 42) -> DataFrame:
    """For each broken row the first good row among ``tries`` pseudo-random ones: (row, taken, attempt).

    ``ids`` holds the dense indexes 0 to n - 1, ``broken`` a subset. Rows for which all tries are broken come with a
    null ``taken``.
    """
    from corpusloom.functions.seeded import hash60

    n = ids.agg(F.count(F.lit(1)).alias("n"))
    attempt = F.explode(F.sequence(F.lit(1), F.lit(tries)))
    b = broken.select(F.col(id_col).alias("row")).distinct()
    tried = b.crossJoin(F.broadcast(n)).withColumn("attempt", attempt).withColumn("taken", F.pmod(hash60(seed, F.col("row"), F.col("attempt")), F.col("n")))
    good = tried.join(b.select(F.col("row").alias("taken")), "taken", "left_anti")
    best = good.groupBy("row").agg(F.min(F.struct("attempt", "taken")).alias("g"))
    return b.join(best, "row", "left").select("row", F.col("g.taken").alias("taken"), F.col("g.attempt").alias("attempt"))

"""Session helpers: shared scratch space, written intermediates and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key holding at least one row in so many counts as hot; there can be no more hot keys than this.
HOT_ONE_IN = 1000
#: Tables that ``written`` has made in this process.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master is a plain
    local one (as in tests) a temporary folder is used, since driver and executors are then the same process.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes an intermediate to the shared folder and reads it back.

    This cuts the lineage: what follows reads files, so a lost executor costs one scan and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the intermediates written so far, once nothing that reads them is needed any more; returns how many."""
    n = 0
    while _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def hot_keys(df: DataFrame, key: str, one_in: int = HOT_ONE_IN) -> list:
    """Values of ``key`` that hold at least one row in ``one_in``; hence at most ``one_in`` values, whatever the size.

    The counts are partial aggregates, so a hot key costs one row per map task in the shuffle.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    hot = counts.crossJoin(F.broadcast(total)).where((F.col("n") * one_in >= F.col("t")) & (F.col("n") > one_in)).select(key)
    return [r[0] for r in hot.collect()]


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Joins facts to a lookup that holds each key once, when one key may hold a third of the facts.

    Hot keys (at most ``HOT_ONE_IN``, see ``hot_keys``) meet their lookup rows by broadcast and are never shuffled;
    the other rows go through an ordinary shuffle join, which AQE may turn into a broadcast by measured size.
    """
    hot = hot_keys(facts, key) if hot is None else hot
    if not hot:
        return facts.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    small = lookup.where(F.col(key).isin(hot))
    return facts.where(~is_hot).join(lookup.where(~F.col(key).isin(hot)), key, how).unionByName(facts.where(is_hot).join(F.broadcast(small), key, how))


def salted_join(left: DataFrame, right: DataFrame, key: str, salt: str, salts: int = 32, hot: list | None = None) -> DataFrame:
    """Inner join of many rows to many rows on a key, when one key may hold a third of either side.

    Rows of hot keys of the left side (at most ``HOT_ONE_IN`` keys) are dealt over ``salts`` groups by a hash of the
    column ``salt``; the right side's rows of these keys go to every group. Other keys join by shuffle.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = left.where(is_hot).withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    copied = right.where(is_hot).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(dealt.join(copied, [key, "_salt"]).drop("_salt"))

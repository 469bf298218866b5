"""Mixing sources to target weights by iterative proportional fitting.

Seconds of a sample are the lengths of its audio items (the valid length of the last added entry of the resolved path);
an item counts for its own source, the sample is drawn with the source that holds most of its seconds and is used as
often at most as the least ``max_repeats`` of all sources of its items allows, items of no valid length included. Samples
fall into cells (source, cap, language, topic); languages are normalised and topics are the values of ``task_type``, of
which more than ``MOST_TOPICS`` are refused, so that the table of cells has a bound and is fitted on the driver:

* the total is the largest at which every source can reach its share without more than ``max_repeats`` uses of any
  sample (or a given, smaller one);
* weights, the expected uses of a sample, are raked in turn to the marginals of topic, language (both as in the
  collection) and source (the targets), cut at the caps, until a round changes nothing. Where caps or the sources' own
  languages and topics leave no weights that meet all three, the sources' targets hold and ``p3_marginals`` tells how far
  the others are reached.

Samples are then drawn with the calibrated probabilities: the whole part of a weight always, the fraction by systematic
sampling over the samples of a source ordered by length, so that the seconds drawn stay close to the seconds wanted.
Sources are cut by a hash into blocks of about ``BLOCK`` samples, so that no window holds a whole large source.

Edge cases: samples without a source or without any valid length aren't used; null languages and topics are cells of
their own; a source that has no seconds gets none and the others keep their proportions; no table of targets, no rows;
null or negative shares count as 0 and null repeats as 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import is_blank, posix_resolve
from corpusloom.llm.language import normal_label
from corpusloom.llm.recordings import source_of, source_order
from corpusloom.session import lookup_join, table, written

MOST_TOPICS = 10_000
BLOCK = 50_000
#: Rounds of raking at most, and the relative change of weights at which it ends.
ROUNDS, STILL = 500, 1e-5


def durations(inventory: DataFrame) -> DataFrame:
    """(key, seconds): the length of the last added entry of a path that has a valid one."""
    good = inventory.where((F.col("duration_s") > 0) & ~F.isnan("duration_s") & F.col("path").isNotNull() & F.col("added_at").isNotNull())
    return good.groupBy(posix_resolve(F.col("path")).alias("key")).agg(F.max_by("duration_s", F.struct("added_at", "entry_id")).alias("seconds"))


def sample_seconds(spark: SparkSession, d: str, sources: list[str], repeats: list[int]) -> DataFrame:
    """(row_idx, language, topic, cap, seconds by source, source) of every sample that can be used."""
    t = table(spark, d, "train_samples")
    if t.agg(F.count_distinct("task_type")).first()[0] > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} values of task_type")
    item = t.select("row_idx", F.coalesce(normal_label(F.col("lang")), F.lit("")).alias("language"), F.coalesce("task_type", F.lit("")).alias("topic"), F.explode("audios").alias("item"))
    item = item.where(~is_blank(F.col("item"))).withColumn("item_source", source_of(F.col("item"), sources)).where("item_source is not null")
    sized = lookup_join(item.withColumn("key", posix_resolve(F.col("item"))), durations(table(spark, d, "audio_inventory")), "key", "left")
    sums = [F.sum(F.when(F.col("item_source") == s, F.coalesce("seconds", F.lit(0.0))).otherwise(0.0)).alias(f"s{i}") for i, s in enumerate(sources)]
    allowed = F.lit(None).cast("int")
    for s, n in zip(sources, repeats):
        allowed = F.when(F.col("item_source") == s, F.lit(n)).otherwise(allowed)
    by_row = sized.groupBy("row_idx", "language", "topic").agg(F.min(allowed).alias("cap"), *sums, F.count("seconds").alias("n_sized")).where("n_sized > 0").drop("n_sized")
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(sources))]) if len(sources) > 1 else F.col("s0")
    main = F.lit(None).cast("int")
    for i in reversed(range(len(sources))):
        main = F.when(F.col(f"s{i}") == top, F.lit(i)).otherwise(main)
    return by_row.withColumn("main", main)


def rake(seconds: np.ndarray, main: np.ndarray, language: np.ndarray, topic: np.ndarray, share: np.ndarray, repeats: np.ndarray, total: float | None = None, caps: np.ndarray | None = None) -> np.ndarray:
    """Expected uses of the samples of each cell.

    ``seconds`` is (cells, sources); ``main``, ``language`` and ``topic`` are codes of the cells; ``caps`` are
    the greatest uses of the cells' samples, else ``repeats`` of their main source.
    """
    have = seconds.sum(0)
    share = np.where(have > 0, np.maximum(share, 0), 0.0)
    if not len(seconds) or share.sum() <= 0:
        return np.zeros(len(seconds))
    share = share / share.sum()
    cap = (repeats[main] if caps is None else caps).astype(float)
    reach = (cap[:, None] * seconds).sum(0)
    most = min(reach[s] / share[s] for s in range(len(share)) if share[s] > 0)
    size = min(most, total or most)
    for _ in range(20):
        w = _raked(seconds, main, language, topic, share * size, cap)
        got = (w[:, None] * seconds).sum(0)
        fit = min(got[s] / (share[s] * size) for s in range(len(share)) if share[s] > 0)
        if fit > 1 - 1e-4:
            break
        size *= fit  # a source also held by samples of other sources can't be reached by its own cap alone
    return w


def _raked(seconds: np.ndarray, main: np.ndarray, language: np.ndarray, topic: np.ndarray, want: np.ndarray, cap: np.ndarray) -> np.ndarray:
    have = seconds.sum(0)
    w = np.where(want[main] > 0, (want / np.maximum(have, 1e-9))[main], 0.0)
    cell = seconds.sum(1)
    natural = [(codes, np.bincount(codes, cell) / cell.sum()) for codes in (topic, language)]
    for _ in range(ROUNDS):
        before = w
        for codes, part in natural:
            now = np.bincount(codes, w * cell, len(part))
            f = np.where(now > 0, part * (w * cell).sum() / np.maximum(now, 1e-9), 1.0)
            w = np.minimum(w * f[codes], cap)
        for _ in range(30):  # cut cells leave their part to the others of the source
            now = (w[:, None] * seconds).sum(0)
            gap = want - now
            if np.abs(gap).max() < 1e-9 * want.sum():
                break
            free = (w < cap - 1e-12) & (w > 0)
            loose = np.where(free[:, None], w[:, None] * seconds, 0).sum(0)
            f = np.where(loose > 0, 1 + gap / np.maximum(loose, 1e-9), 1.0)
            over = now > want
            f = np.where(over, want / np.maximum(now, 1e-9), f)
            act = free | over[main]
            w = np.where(act, np.clip(w * np.maximum(f, 0)[main], 0, cap), w)
        if np.abs(w - before).max() <= STILL * max(1e-9, w.max()):
            break
    return w


def mix(samples: DataFrame, sources: list[str], share: list[float], repeats: list[int], total: float | None = None) -> DataFrame:
    """Samples with ``copies`` > 0. ``samples`` is read from files and has the columns of ``sample_seconds``."""
    spark = samples.sparkSession
    names = [f"s{i}" for i in range(len(sources))]
    # At most sources x different repeats x (languages + 1) x (MOST_TOPICS + 1) rows.
    cells = samples.groupBy("main", "cap", "language", "topic").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).orderBy("main", "cap", "language", "topic").collect()
    code = {k: {v: i for i, v in enumerate(sorted({c[k] for c in cells}))} for k in ("language", "topic")}
    w = rake(
        np.array([[c[n] for n in names] for c in cells]).reshape(len(cells), len(names)),
        np.array([c["main"] for c in cells], int), np.array([code["language"][c["language"]] for c in cells], int), np.array([code["topic"][c["topic"]] for c in cells], int),
        np.array(share, float), np.array(repeats, int), total, np.array([c["cap"] for c in cells], int),
    )
    held: dict[int, int] = {}
    for c in cells:
        held[c["main"]] = held.get(c["main"], 0) + c["n"]
    # Rounded, so that a weight that is whole but for the last bits counts as whole.
    plan = [(c["main"], c["cap"], c["language"], c["topic"], round(float(x), 9), max(1, -(-held[c["main"]] // BLOCK))) for c, x in zip(cells, w)]
    fitted = spark.createDataFrame(plan, "main int, cap int, language string, topic string, weight double, blocks int")
    part = F.col("weight") - F.floor("weight")
    in_order = Window.partitionBy("main", "block").orderBy("size", "row_idx").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("main", "block"), F.lit(1000)) / 1000.0
    ranked = samples.join(F.broadcast(fitted), ["main", "cap", "language", "topic"]).withColumn("block", F.pmod(F.xxhash64("row_idx", F.lit(31)), F.col("blocks")))
    ranked = ranked.withColumn("size", sum((F.col(n) for n in names), F.lit(0.0))).withColumn("upto", F.sum(part).over(in_order) + start)
    extra = F.when(part > 0, F.floor("upto") - F.floor(F.col("upto") - part)).otherwise(0)
    return ranked.withColumn("copies", (F.floor("weight") + extra).cast("int")).where("copies > 0").drop("blocks", "block", "upto")


def _targets(spark: SparkSession, d: str) -> tuple[list[str], list[float], list[int]]:
    sources = source_order(spark, d)
    rows = {r["source"]: r for r in table(spark, d, "mix_targets").where("source is not null").collect()}  # as many as ``source_order`` allows
    return sources, [max(0.0, rows[s]["target_share"] or 0.0) for s in sources], [1 if rows[s]["max_repeats"] is None else max(0, rows[s]["max_repeats"]) for s in sources]


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], list[float]]:
    sources, share, repeats = _targets(spark, d)
    if not sources:
        return spark.createDataFrame([], "row_idx long, main int, copies int, size double, weight double"), sources, share
    return mix(written(sample_seconds(spark, d, sources, repeats), "p3-samples"), sources, share, repeats), sources, share


def p3_mix(spark: SparkSession, d: str) -> DataFrame:
    """Samples used, with their source, seconds, weight and number of copies."""
    mixed, sources, _ = _mixed(spark, d)
    name = F.element_at(F.array(*map(F.lit, sources)), F.col("main") + 1) if sources else F.lit(None).cast("string")
    return mixed.select("row_idx", name.alias("source"), F.col("size").alias("seconds"), F.round("weight", 6).alias("weight"), "copies")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source, its seconds, samples and greatest number of copies."""
    mixed, sources, share = _mixed(spark, d)
    if not sources:
        return spark.createDataFrame([], "source string, target_share double, actual_share double, seconds double, n_samples long, most_copies int")
    parts = [F.struct(F.lit(s).alias("source"), F.lit(float(t)).alias("target_share"), F.col(f"s{i}").alias("s")) for i, (s, t) in enumerate(zip(sources, share))]
    long = mixed.select("copies", F.explode(F.array(*parts)).alias("p")).select("copies", "p.*")
    used = F.when(F.col("s") > 0, F.col("copies"))
    agg = long.groupBy("source", "target_share").agg(F.sum(F.col("s") * F.col("copies")).alias("seconds"), F.count(used).alias("n_samples"), F.max(used).alias("most_copies"))
    total = agg.agg(F.sum("seconds").alias("total"))
    return agg.join(F.broadcast(total)).select("source", "target_share", F.round(F.col("seconds") / F.col("total"), 6).alias("actual_share"), F.round("seconds", 2).alias("seconds"), "n_samples", "most_copies")


def p3_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Shares of seconds by language and by topic: in the collection, as weighted, and as drawn."""
    sources, share, repeats = _targets(spark, d)
    if not sources:
        return spark.createDataFrame([], "kind string, value string, natural_share double, weighted_share double, actual_share double")
    samples = written(sample_seconds(spark, d, sources, repeats), "p3-samples")
    size = sum((F.col(f"s{i}") for i in range(len(sources))), F.lit(0.0))
    drawn = mix(samples, sources, share, repeats).select("row_idx", "weight", "copies")
    both = samples.withColumn("size", size).join(drawn, "row_idx", "left").select("language", "topic", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("copies", F.lit(0)).alias("copies"))
    pair = F.explode(F.array(F.struct(F.lit("language").alias("kind"), F.col("language").alias("value")), F.struct(F.lit("topic").alias("kind"), F.col("topic").alias("value"))))
    by = both.groupBy("language", "topic").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("weight")).alias("w"), F.sum(F.col("size") * F.col("copies")).alias("c"))
    long = by.select(pair.alias("p"), "n", "w", "c").groupBy("p.kind", "p.value").agg(*[F.sum(x).alias(x) for x in "nwc"])
    total = long.groupBy("kind").agg(*[F.sum(x).alias(f"t{x}") for x in "nwc"])
    return long.join(F.broadcast(total), "kind").select("kind", "value", *[F.round(F.col(x) / F.col(f"t{x}"), 6).alias(n) for x, n in (("n", "natural_share"), ("w", "weighted_share"), ("c", "actual_share"))])


QUERIES = {"p3_mix": p3_mix, "p3_shares": p3_shares, "p3_marginals": p3_marginals}
ORACLE: dict[str, str] = {}

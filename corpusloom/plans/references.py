"""Queries on references to missing files (problem 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import is_blank, posix_resolve
from corpusloom.operators.orphans import OrphanState, advance, compacted, empty_state, orphans, snapshot
from corpusloom.session import table, written


def _references(df: DataFrame, name: str, rec_id: str, items: str) -> DataFrame:
    item = df.select(F.lit(name).alias("tbl"), F.col(rec_id).alias("rec_id"), F.posexplode(items).alias("pos", "item"), F.col("loaded_at").alias("at"))
    return item.where(~is_blank(F.col("item"))).select("tbl", "rec_id", F.col("pos").cast("bigint").alias("pos"), posix_resolve(F.col("item")).alias("key"), "at")


def audio_references(spark: SparkSession, d: str) -> DataFrame:
    return _references(table(spark, d, "train_samples"), "train_samples", "row_idx", "audios").unionByName(_references(table(spark, d, "test_items"), "test_items", "item_id", "expand_wav"))


def inventory_entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "audio_inventory").where(F.col("path").isNotNull())
    return e.select("entry_id", posix_resolve(F.col("path")).alias("key"), F.col("added_at").alias("added"), F.col("removed_at").alias("removed"))


#: Batches in which ``p4_found`` and ``p4_counts`` take the history.
BATCHES = 2
#: Batches after which the state is written in one segment a table again.
COMPACT_EVERY = 16


def _history(spark: SparkSession, d: str, ends: Callable[[datetime, datetime], list[datetime]], whole: bool) -> Iterator[tuple[datetime, OrphanState]]:
    """States as they were at given times: a batch holds the references since the time before, the entries added since
    and the removals made since. With ``whole`` the last batch brings all that came later, too.

    Entries and references are written once, as every batch reads them.
    """
    refs = written(audio_references(spark, d).where(F.col("at").isNotNull()), "p4-references")
    entries = written(inventory_entries(spark, d).where("added is not null"), "p4-entries")
    lo, hi = refs.agg(F.min("at"), F.max("at")).first()
    times = ends(lo, hi) if lo is not None else []
    state, before = empty_state(spark), None
    for i, end in enumerate(times):
        at = F.lit(end).cast("timestamp_ntz")
        last = whole and i + 1 == len(times)
        known = entries if last else entries.where(F.col("added") < at).withColumn("removed", F.when(F.col("removed") < at, F.col("removed")))
        new = known if before is None else known.where((F.col("added") >= before) | (F.col("removed") >= before))
        fresh = refs if last else refs.where(F.col("at") < at)
        state = advance(state, new, fresh if before is None else fresh.where(F.col("at") >= before))
        yield end, state
        before = at


def _state(spark: SparkSession, d: str) -> OrphanState:
    """The state after the whole history, in ``BATCHES`` batches of equal time."""
    state = empty_state(spark)
    for _, state in _history(spark, d, lambda lo, hi: [lo + (hi - lo) * i / BATCHES for i in range(1, BATCHES + 1)], True):
        pass
    return state


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(_state(spark, d)).select("tbl", "rec_id", "pos", "kind").distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(_state(spark, d))


def _quarters(lo: datetime, hi: datetime) -> list[datetime]:
    """First days of the quarters after lo, up to the first one after hi."""
    y, q, out = lo.year, (lo.month - 1) // 3, []
    while not out or out[-1] <= hi:
        y, q = (y + 1, 0) if q == 3 else (y, q + 1)
        out.append(datetime(y, 3 * q + 1, 1))
    return out


def p4_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Open orphans at the end of every quarter, from a state that is advanced quarter by quarter.

    At the end of a quarter only entries added and removals made before it are known. Each quarter's counts are written
    when its state is reached, so that a long history makes no long plan.
    """
    out = None
    for end, state in _history(spark, d, _quarters, False):
        now = snapshot(state).groupBy("tbl", "kind").agg(F.sum("n").alias("n")).select(F.lit(str(end.date())).alias("until"), "tbl", "kind", "n")
        now = written(now, "p4-counts")
        out = now if out is None else out.unionByName(now)
        if state.batch % COMPACT_EVERY == 0:
            state.segments = compacted(state).segments
    return out if out is not None else spark.createDataFrame([], "until string, tbl string, kind string, n long")


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_timeline": p4_timeline}

_RESOLVE = """CASE WHEN regexp_matches({p}, '//|(^|/)\\.{{1,2}}(/|$)|./$') THEN
  CASE WHEN {p} LIKE '/%' THEN '/' ELSE '' END || array_to_string(list_reduce(
    list_prepend([]::VARCHAR[], list_transform(string_split({p}, '/'), lambda x: [x])),
    lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a
      WHEN x[1] = '..' THEN CASE WHEN len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a)-1] WHEN {p} LIKE '/%' THEN a ELSE list_concat(a, x) END
      ELSE list_concat(a, x) END), '/') ELSE {p} END"""

_P4 = f"""
WITH refs AS (
  SELECT tbl, rec_id, pos, {_RESOLVE.format(p='item')} AS k, loaded_at FROM (
    SELECT 'train_samples' AS tbl, row_idx AS rec_id, generate_subscripts(audios, 1) - 1 AS pos, unnest(audios) AS item, loaded_at FROM train_samples
    UNION ALL
    SELECT 'test_items', item_id, generate_subscripts(expand_wav, 1) - 1, unnest(expand_wav), loaded_at FROM test_items)
  WHERE item IS NOT NULL AND regexp_replace(item, '[\\s\\p{{Z}}\\x{{200B}}\\x{{FEFF}}]+', '', 'g') <> '' AND loaded_at IS NOT NULL),
inv AS (SELECT {_RESOLVE.format(p='path')} AS k, added_at, removed_at FROM audio_inventory WHERE path IS NOT NULL AND added_at IS NOT NULL),
judged AS (
  SELECT tbl, rec_id, pos, r.loaded_at, count(i.k) AS n, min(i.added_at) AS first_added,
    coalesce(bool_or(i.added_at <= r.loaded_at AND (i.removed_at IS NULL OR r.loaded_at < i.removed_at)), false) AS there
  FROM refs r LEFT JOIN inv i ON r.k = i.k GROUP BY ALL),
orphan AS (
  SELECT tbl, rec_id, CAST(pos AS BIGINT) AS pos, loaded_at, CASE WHEN n = 0 THEN 'missing' WHEN first_added > loaded_at THEN 'late' ELSE 'deleted' END AS kind
  FROM judged WHERE NOT there)
"""

_TIMELINE = _P4.split("judged AS")[0] + """
ends AS (SELECT unnest(generate_series((SELECT date_trunc('quarter', min(loaded_at)) + INTERVAL 3 MONTH FROM refs), (SELECT date_trunc('quarter', max(loaded_at)) + INTERVAL 3 MONTH FROM refs), INTERVAL 3 MONTH)) AS e),
judged AS (SELECT e, tbl, rec_id, pos, r.loaded_at, count(i.k) AS n, min(i.added_at) AS first_added,
    coalesce(bool_or(i.added_at <= r.loaded_at AND (i.removed_at IS NULL OR i.removed_at >= e OR r.loaded_at < i.removed_at)), false) AS there
  FROM ends JOIN refs r ON r.loaded_at < e LEFT JOIN inv i ON r.k = i.k AND i.added_at < e GROUP BY ALL)
SELECT strftime(e, '%Y-%m-%d') AS until, tbl, CASE WHEN n = 0 THEN 'missing' WHEN first_added > loaded_at THEN 'late' ELSE 'deleted' END AS kind, count(*) AS n FROM judged WHERE NOT there GROUP BY ALL
"""

ORACLE = {
    "p4_timeline": _TIMELINE,
    "p4_found": _P4 + "SELECT DISTINCT tbl, rec_id, pos, kind FROM orphan",
    "p4_counts": _P4 + "SELECT tbl, strftime(loaded_at, '%Y-%m') AS month, kind, count(*) AS n FROM orphan GROUP BY ALL",
}

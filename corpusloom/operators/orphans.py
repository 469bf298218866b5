"""References to records that do not exist: an incrementally kept index of parents and pending references.

State
    Four append-only tables in the shared folder, each in ``BUCKETS`` buckets of keys, every row with the number of the
    batch that wrote it; the latest row of an identity counts:
    ``entries``   what is known of the parents' records (entry_id, key, added, removed)
    ``parents``   the index: per key ``first_added`` and ``spans``, the merged intervals ``[added, removed)`` in which
                  some entry of the key was there
    ``settled``   references that found their parent when they came
    ``pending``   every status of references that were an orphan at some time; a reference in it is no longer settled

Transition
    ``advance(state, ...)`` takes a batch of new parent entries, changed entries (a deletion is an entry whose
    ``removed`` becomes known) and new references. New references probe the index. The index is made anew for the keys
    of the batch's entries; only these keys' pending references, and their settled ones from the first deletion on, are
    probed again: an arriving parent resolves those that wait, a deletion reopens them. Written are the batch itself,
    the index of its keys and the statuses that changed, nothing else; buckets without a key of the batch are not read.
    Feeding a history in any batches gives the state of one batch. Counts read the pending table only.

An entry is identified by ``entry_id`` and ``key`` (an entry that moves to another key is deleted at the first and added
at the second); a reference by all its columns, so that repeated rows count once.

A reference is judged as of its own time: ``missing`` when the key has no entry at all, ``late`` when all entries were
added after it, ``deleted`` when some were added by then and none was there any more.

Edge cases: null and blank keys are no references; a reference with a null time or an entry with a null ``added`` is
skipped; an entry removed at or before its addition was never there but counts as an entry; repeated entries merge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import hot_keys, lookup_join, written

REF_COLUMNS = ("tbl", "rec_id", "pos", "key", "at")
BUCKETS = 256
_FAR = "cast('9999-12-31 00:00:00' as timestamp_ntz)"
_SPAN = "array<struct<s:timestamp_ntz,e:timestamp_ntz>>"
_REF = "tbl string, rec_id bigint, pos bigint, key string, at timestamp_ntz"
_DDL = {
    "entries": "entry_id bigint, key string, added timestamp_ntz, removed timestamp_ntz",
    "parents": f"key string, first_added timestamp_ntz, spans {_SPAN}",
    "settled": _REF,
    "pending": f"{_REF}, status string",
}


@dataclass
class OrphanState:
    """Segments (one a batch) of the four tables and the number of batches."""

    spark: SparkSession
    segments: dict[str, list[DataFrame]]
    batch: int = 0
    #: Keys that held many of the references or entries of a batch, ``HOT_ONE_IN`` at most of each batch.
    hot: frozenset[str] = frozenset()

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a table, or those of some buckets."""
        out = None
        for part in self.segments[name]:
            part = part if buckets is None else part.where(F.col("bucket").isin(buckets))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], f"{_DDL[name]}, batch int, bucket int")


def _append(state: OrphanState, name: str, rows: DataFrame) -> DataFrame:
    """Writes one segment, its rows in the order of the buckets, so that the files' statistics tell which to skip. A large
    bucket is split over tasks; a small batch is one file."""
    b = rows.select("*", F.lit(state.batch).alias("batch"), F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    part = written(b.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket"), name)
    state.segments[name] = [*state.segments[name], part]
    return part


def _merge(spans: Column) -> Column:
    """Union of intervals, given as structs (s, e) sorted by s."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last.s.alias("s"), F.greatest(last.e, x.e).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x.s <= last.e, joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.array().cast(_SPAN), step)


def build_parents(entries: DataFrame) -> DataFrame:
    """The parent index (key, first_added, spans) of entries (key, added, removed).

    Repeated entries collapse in a partial aggregate; spans are merged per key and month of addition by sorting, which
    spills, and only what is left of them per key, so that no task holds all entries of a hot key.
    """
    far = F.expr(_FAR)
    e = entries.where(F.col("added").isNotNull() & F.col("key").isNotNull())
    once = e.groupBy("key", F.date_trunc("month", "added").alias("m"), F.col("added").alias("s")).agg(F.max(F.coalesce("removed", far)).alias("e"))
    before = Window.partitionBy("key", "m").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("e") > F.col("s"), F.col("e"))
    reach = once.withColumn("e", good).withColumn("_reach", F.max("e").over(before))
    begins = F.when(F.col("e").isNotNull() & (F.col("_reach").isNull() | (F.col("s") > F.col("_reach"))), 1).otherwise(0)
    island = F.sum(begins).over(Window.partitionBy("key", "m").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    held = F.when(F.col("e").isNotNull(), F.col("s"))
    parts = reach.withColumn("_i", island).groupBy("key", "m", "_i").agg(F.min("s").alias("first_added"), F.min(held).alias("s"), F.max("e").alias("e"))
    span = F.when(F.col("s").isNotNull(), F.struct("s", "e"))
    return parts.groupBy("key").agg(F.min("first_added").alias("first_added"), _merge(F.array_sort(F.collect_list(span))).alias("spans"))


def probe(references: DataFrame, parents: DataFrame, hot: list | None = None) -> DataFrame:
    """References with their ``status`` against the parent index; hot keys are joined without a shuffle."""
    kept = references.where(F.col("at").isNotNull() & F.col("key").isNotNull())
    joined = lookup_join(kept, parents.select("key", "first_added", "spans"), "key", "left", hot)
    there = F.exists("spans", lambda x: (x.s <= F.col("at")) & (F.col("at") < x.e))
    status = F.when(F.col("first_added").isNull(), "missing").when(there, "ok").when(F.col("first_added") > F.col("at"), "late").otherwise("deleted")
    return joined.select(*REF_COLUMNS, *([F.col("was")] if "was" in references.columns else []), status.alias("status"))


def _latest(rows: DataFrame, identity: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*identity).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*identity, "_v.*")


def _buckets(keys: DataFrame) -> list[int]:
    return [r[0] for r in keys.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # at most BUCKETS


def empty_state(spark: SparkSession) -> OrphanState:
    return OrphanState(spark, {n: [] for n in _DDL})


def bootstrap(entries: DataFrame, references: DataFrame) -> OrphanState:
    """The state after a first batch."""
    return advance(empty_state(entries.sparkSession), entries, references)


def advance(state: OrphanState, new_entries: DataFrame, new_references: DataFrame) -> OrphanState:
    """The state after one more batch; ``new_entries`` replace entries of the same ``entry_id`` and ``key``."""
    out = OrphanState(state.spark, dict(state.segments), state.batch + 1, state.hot)
    came = _append(out, "entries", new_entries.where(F.col("key").isNotNull()).select("entry_id", "key", "added", "removed"))
    refs = new_references.select(*REF_COLUMNS).where(F.col("at").isNotNull() & F.col("key").isNotNull()).distinct()
    if state.batch == 0:
        index = _append(out, "parents", build_parents(came))
        turned = None
    else:
        refs = written(refs, "references")
        # From when on settled references of a key may lose their parent.
        far = F.expr(_FAR)
        touched = came.groupBy("key").agg(F.min(F.least(F.coalesce("removed", far), F.coalesce("added", far))).alias("since"))
        where, hot_entries = _buckets(touched), frozenset(hot_keys(came, "key"))
        known = lookup_join(out.read("entries", where), touched, "key", "inner", sorted(hot_entries))
        newest = known.withColumn("_b", F.max("batch").over(Window.partitionBy("entry_id", "key"))).where("entry_id is null or batch = _b")
        fresh = _append(out, "parents", build_parents(newest))
        out.hot = state.hot | hot_entries
        again = _latest(lookup_join(state.read("pending", where), touched, "key", "inner", sorted(out.hot)), REF_COLUMNS, ("status",)).withColumnRenamed("status", "was")
        held = lookup_join(state.read("settled", where), touched, "key", "inner", sorted(out.hot)).where("at >= since").select(*REF_COLUMNS).withColumn("was", F.lit("ok"))
        # A reopened reference is in both tables; what the pending table says of it counts.
        both = again.withColumn("_p", F.lit(1)).unionByName(held.withColumn("_p", F.lit(0))).groupBy(*REF_COLUMNS).agg(F.max_by("was", "_p").alias("was"))
        turned = probe(both, fresh, sorted(out.hot)).where("status <> was").drop("was")
        index = _latest(out.read("parents", _buckets(refs)), ("key",), ("first_added", "spans"))
    hot = frozenset(hot_keys(refs, "key"))
    out.hot |= hot
    judged = written(probe(refs, index, sorted(hot)), "judged")
    _append(out, "settled", judged.where("status = 'ok'").select(*REF_COLUMNS))
    orphaned = judged.where("status <> 'ok'")
    _append(out, "pending", orphaned if turned is None else orphaned.unionByName(turned))
    return out


def orphans(state: OrphanState) -> DataFrame:
    """The pending references with their kind."""
    now = _latest(state.read("pending"), REF_COLUMNS, ("status",)).where(F.col("status") != "ok")
    return now.select("tbl", "rec_id", "pos", "key", "at", F.col("status").alias("kind"))


def snapshot(state: OrphanState) -> DataFrame:
    """Orphans per table, month of reference and kind."""
    return orphans(state).groupBy("tbl", F.date_format("at", "yyyy-MM").alias("month"), "kind").agg(F.count(F.lit(1)).alias("n"))


def compacted(state: OrphanState) -> OrphanState:
    """The same state in one segment a table, superseded rows left out; for now and then, as reading takes all segments."""
    out = OrphanState(state.spark, {n: [] for n in _DDL}, state.batch, state.hot)
    rows = state.read("entries").withColumn("_b", F.max("batch").over(Window.partitionBy("entry_id", "key"))).where("entry_id is null or batch = _b")
    _append(out, "entries", rows.select("entry_id", "key", "added", "removed"))
    _append(out, "parents", _latest(state.read("parents"), ("key",), ("first_added", "spans")))
    _append(out, "settled", state.read("settled").select(*REF_COLUMNS))
    _append(out, "pending", _latest(state.read("pending"), REF_COLUMNS, ("status",)))
    return out

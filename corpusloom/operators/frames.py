"""Operators on framed sequences in long form: rows (id, t, value), t dense from 0 within each id.

A sequence may be long, and one id may hold a third of all rows. So nothing here sorts a whole sequence in one task:

* ``frame_index`` numbers frames by ranks within time buckets and offsets from counts of earlier buckets;
* windows of bounded reach run within blocks of ``BLOCK`` frames that carry copies of the neighbouring frames they
  need (``with_halo``);
* running totals add a total within the block to a total of earlier blocks (``running_sum``).

Null values count as missing to sums and means, as in SQL. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import lookup_join

BLOCK = 4096


def frame_index(df: DataFrame, key: str, ts: str, tie: str, bucket: str = "day", name: str = "t") -> DataFrame:
    """Adds the dense 0-based place of each row in its sequence, ordered by (ts, tie).

    Rows without a key or a time have no place and drop out.
    """
    b = df.withColumn("_b", F.date_trunc(bucket, ts))
    counts = b.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(key, "_b").orderBy(ts, tie)) - 1
    return b.withColumn("_r", rank).join(before, [key, "_b"]).withColumn(name, (F.col("_r") + F.col("_o")).cast("bigint")).drop("_b", "_r", "_o")


def with_halo(df: DataFrame, t: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Rows with ``_block`` and copies (``_own`` false) for the following blocks that look back ``before`` frames and
    the preceding ones that look ahead ``after``."""
    own = F.floor(F.col(t) / block)
    lo, hi = F.greatest(F.floor((F.col(t) - after) / block), F.lit(0)), F.floor((F.col(t) + before) / block)
    return df.withColumn("_block", F.explode(F.sequence(lo, hi))).withColumn("_own", F.col("_block") == own)


def bounded(df: DataFrame, key: str, t: str, before: int, after: int, block: int = BLOCK):
    """(rows with halo, window over blocks in the order of t); finish with ``own_only``."""
    return with_halo(df, t, before, after, block), Window.partitionBy(key, "_block").orderBy(t)


def own_only(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block")


def running_sum(df: DataFrame, key: str, t: str, value: str, name: str, inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Total of a value up to each frame (or before it)."""
    b = df.withColumn("_block", F.floor(F.col(t) / block))
    totals = b.groupBy(key, "_block").agg(F.sum(value).alias("_s"))
    offset = totals.withColumn("_o", F.coalesce(F.sum("_s").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    w = Window.partitionBy(key, "_block").orderBy(t).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return b.withColumn("_i", F.coalesce(F.sum(value).over(w), F.lit(0))).join(offset, [key, "_block"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_block", "_i", "_o")


def lengths(df: DataFrame, key: str, t: str) -> DataFrame:
    return df.groupBy(key).agg((F.max(t) + 1).cast("bigint").alias("length"))


def join_per_key(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Rows with the statistics of their sequence; hot sequences don't skew the join."""
    return lookup_join(df, stats, key, "inner")


# --- counts and chunks -------------------------------------------------------------------------------------------


def chunk_counts(df: DataFrame, key: str, t: str, size: int) -> DataFrame:
    """Chunks of each sequence and the padding of the last: (key, length, n_chunks, pad)."""
    n = F.col("length")
    return lengths(df, key, t).select(key, "length", F.ceil(n / size).cast("bigint").alias("n_chunks"), F.pmod(-n, F.lit(size)).cast("bigint").alias("pad"))


def stack(df: DataFrame, key: str, t: str, value: str, k: int, fill: float = 0.0) -> DataFrame:
    """k consecutive frames as one: (key, s, frame), the last one filled up."""
    g = df.groupBy(key, F.floor(F.col(t) / k).cast("bigint").alias("s")).agg(F.array_sort(F.collect_list(F.struct(t, value))).alias("a"))
    vals = F.transform("a", lambda x: x[value])
    return g.select(key, "s", F.concat(vals, F.array_repeat(F.lit(fill), k - F.size("a"))).alias("frame"))


def downsample(df: DataFrame, key: str, t: str, value: str, weights: list[float], name: str = "value") -> DataFrame:
    """Weighted sums of successive frames; where the last group is short its last element repeats."""
    ds = len(weights)
    g = df.groupBy(key, F.floor(F.col(t) / ds).cast("bigint").alias("s")).agg(F.array_sort(F.collect_list(F.struct(t, value))).alias("a"))
    vals = F.transform("a", lambda x: x[value])
    filled = F.concat(vals, F.array_repeat(F.element_at(vals, -1), ds - F.size("a")))
    total = F.aggregate(F.zip_with(filled, F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return g.select(key, "s", total.alias(name))


def upsample(df: DataFrame, key: str, t: str, u: int, cut: DataFrame | None = None) -> DataFrame:
    """Every frame u times, at places t*u to t*u+u-1; cut to ``length`` of a table (key, length) if given."""
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(u - 1)))).withColumn(t, F.col(t) * u + F.col("_k")).drop("_k")
    return join_per_key(out, cut, key).where(F.col(t) < F.col("length")).drop("length") if cut is not None else out


def every(df: DataFrame, t: str, ds: int) -> DataFrame:
    return df.where(F.pmod(F.col(t), F.lit(ds)) == 0)


# --- shifts and filters ------------------------------------------------------------------------------------------


def shift_right(df: DataFrame, key: str, t: str, value: str, start, ignore, pad, name: str = "shifted") -> DataFrame:
    """The value of the preceding frame, ``start`` for the first; ``ignore`` becomes ``pad``."""
    h, w = bounded(df, key, t, 1, 0)
    prev = F.when(F.col(t) == 0, F.lit(start)).otherwise(F.lag(value).over(w))
    return own_only(h.withColumn(name, prev)).withColumn(name, F.when(F.col(name) == ignore, pad).otherwise(F.col(name)))


def delay_align(a: DataFrame, b: DataFrame, key: str, t: str, delay: int, fill=-100) -> DataFrame:
    """Frame t + delay of ``a`` beside frame t of ``b``: the first ``delay`` of a and the last of b drop out.

    Both have a column ``value``; null values of b become ``fill``.
    """
    moved = a.select(key, (F.col(t) - delay).alias(t), F.col("value").alias("a")).where(F.col(t) >= 0)
    return moved.join(b.select(key, t, F.coalesce("value", F.lit(fill)).alias("b")), [key, t])


def fir(df: DataFrame, key: str, t: str, value: str, kernel: list[float], left: int, name: str, within: int | None = None) -> DataFrame:
    """Weighted sum of the frames t - left to t - left + len(kernel) - 1, zeros beyond the ends.

    With ``within``, frames of other chunks of that size count as zeros.
    """
    right = len(kernel) - 1 - left
    h, w = bounded(df, key, t, left, max(right, 0))
    out = F.lit(0.0)
    for i, k in enumerate(kernel):
        off = i - left
        there = F.lag(value, -off).over(w) if off else F.col(value)
        if within and off:
            other = F.floor((F.col(t) + off) / within) == F.floor(F.col(t) / within)
            there = F.when(other, there)
        out = out + F.coalesce(there, F.lit(0.0)) * k
    return own_only(h.withColumn(name, out))


def chunk_scale(t: Column, size: int, left_edge: list[float], right_edge: list[float]) -> Column:
    """1 + what the edges of a chunk add, by the place in the chunk."""
    n = len(left_edge)
    if size < n:
        left, right = left_edge[:size], right_edge[-size:]
    else:
        left, right = left_edge + [0.0] * (size - n), [0.0] * (size - n) + right_edge
    return 1.0 + F.get(F.array(*[F.lit(a + b) for a, b in zip(left, right)]), F.pmod(t, F.lit(size)).cast("int"))


def left_context(df: DataFrame, key: str, t: str, value: str, depth: int, name: str = "context") -> DataFrame:
    """The frame and the ``depth`` before it, oldest first."""
    h, w = bounded(df, key, t, depth, 0)
    return own_only(h.withColumn(name, F.collect_list(value).over(w.rowsBetween(-depth, 0))))


# --- visibility --------------------------------------------------------------------------------------------------


def chunk_causal(df: DataFrame, key: str, t: str, value: str, size: int, left_chunks: int) -> DataFrame:
    """Sum and count of what a frame sees: its own chunk, all of it, and ``left_chunks`` before it.

    No self-join and no window over frames: totals per chunk, a window over chunks, and a join back.
    """
    c = df.withColumn("chunk", F.floor(F.col(t) / size).cast("bigint"))
    totals = c.groupBy(key, "chunk").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("chunk").rangeBetween(-left_chunks, 0)
    seen = totals.select(key, "chunk", F.sum("s").over(w).alias("seen_sum"), F.sum("n").over(w).alias("seen"))
    return c.join(seen, [key, "chunk"])


def softmax(df: DataFrame, key: str, value: str, name: str = "p") -> DataFrame:
    """exp(value) over its sum per key, computed from the maximum."""
    top = df.groupBy(key).agg(F.max(value).alias("_m"))
    shifted = join_per_key(df, top, key).withColumn("_e", F.exp(F.col(value) - F.col("_m")))
    total = shifted.groupBy(key).agg(F.sum("_e").alias("_z"))
    return join_per_key(shifted, total, key).withColumn(name, F.col("_e") / F.col("_z")).drop("_m", "_e", "_z")


# --- alignment ---------------------------------------------------------------------------------------------------


def align_outer(a: DataFrame, b: DataFrame, key: str, t: str, fill: float = 0.0) -> DataFrame:
    """Two sequences (column ``value``) side by side, the shorter one filled up."""
    left, right = a.select(key, t, F.col("value").alias("a")), b.select(key, t, F.col("value").alias("b"))
    return left.join(right, [key, t], "full").select(key, t, F.coalesce("a", F.lit(fill)).alias("a"), F.coalesce("b", F.lit(fill)).alias("b"))


def ratio_fold(slow: DataFrame, fast: DataFrame, key: str, t: str, ratio: int, fill, most_short: int | None = None) -> DataFrame:
    """Exactly ``ratio`` frames of ``fast`` as an array beside each frame of ``slow``; excess cut, shortage filled.

    With ``most_short``, a sequence that lacks more than so many frames is an error.
    """
    sl = slow.select(key, t)
    places = sl.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ratio - 1)))).withColumn("_f", F.col(t) * ratio + F.col("k"))
    joined = places.join(fast.select(key, F.col(t).alias("_f"), F.col("value").alias("v"), F.lit(True).alias("_there")), [key, "_f"], "left")
    v = F.when(F.col("_there"), F.col("v")).otherwise(F.lit(fill))
    if most_short is not None:
        short = joined.groupBy(key).agg(F.count_if(F.col("_there").isNull()).alias("_short"))
        ok = F.assert_true(F.col("_short") <= most_short, F.concat(F.lit("too few frames in "), F.col(key).cast("string")))
        joined = join_per_key(joined, short, key).where(ok.isNull())
    return joined.groupBy(key, t).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", v.alias("v")))), lambda x: x.v).alias("folded"))


def nearest(df: DataFrame, key: str, t: str, value: str, target: DataFrame) -> DataFrame:
    """Resampled to ``target`` (key, want) frames by the index floor(t * length / want)."""
    n = lengths(df, key, t)
    places = target.join(n, key).where("want > 0 and length > 0").select(key, "want", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("want") - 1)).alias("o"))
    src = places.withColumn(t, F.floor(F.col("o") * F.col("length") / F.col("want")).cast("bigint"))
    return src.join(df.select(key, t, value), [key, t]).select(key, F.col("o").alias(t), value)


def mask_downsample(df: DataFrame, key: str, t: str, mask: str, r: int) -> DataFrame:
    """Per r frames: the mean of a mask is at least a half (``any_half``) and all are masked (``all_masked``); a short
    last group drops out."""
    g = df.groupBy(key, F.floor(F.col(t) / r).cast("bigint").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(mask).cast("double")).alias("m"), F.bool_and(mask).alias("all_masked"))
    return g.where(F.col("n") == r).select(key, "s", (F.col("m") >= 0.5).alias("any_half"), "all_masked")


# --- markers and splicing ----------------------------------------------------------------------------------------


def pair_markers(df: DataFrame, key: str, t: str, start: Column, end: Column) -> DataFrame:
    """The k-th start beside the k-th end of a sequence: (key, k, start_t, end_t); what is left over drops out."""
    marks = df.select(key, t, F.when(start, 1).otherwise(0).alias("_s"), F.when(end, 1).otherwise(0).alias("_e"))
    s = running_sum(marks, key, t, "_s", "k").where("_s = 1").select(key, "k", F.col(t).alias("start_t"))
    e = running_sum(marks, key, t, "_e", "k").where("_e = 1").select(key, "k", F.col(t).alias("end_t"))
    return s.join(e, [key, "k"])


def label_mask(df: DataFrame, key: str, t: str, value: str, pairs: DataFrame, shift: int, ignore=-100, name: str = "label") -> DataFrame:
    """The value where some pair has start + shift <= t <= end, else ``ignore``.

    A difference of running counts of beginnings and ends replaces the range join, so the number of pairs per sequence
    doesn't matter.
    """
    good = pairs.where(F.col("start_t") + shift <= F.col("end_t"))
    moves = good.select(key, (F.col("start_t") + shift).alias(t), F.lit(1).alias("_d")).unionByName(good.select(key, (F.col("end_t") + 1).alias(t), F.lit(-1).alias("_d")))
    at = moves.groupBy(key, t).agg(F.sum("_d").alias("_d"))
    open_ = running_sum(df.join(at, [key, t], "left").withColumn("_d", F.coalesce("_d", F.lit(0))), key, t, "_d", "_open")
    return open_.withColumn(name, F.when(F.col("_open") > 0, F.col(value)).otherwise(F.lit(ignore))).drop("_d", "_open")


def splice(df: DataFrame, key: str, t: str, inserted: str, fill=-100) -> DataFrame:
    """Positions after inserting ``inserted`` frames behind each frame (0 for none).

    (key, pos, t, inserted_frame, attention): own frames have a null ``inserted_frame``.
    """
    shifted = running_sum(df, key, t, inserted, "_shift", inclusive=False).withColumn("pos", F.col(t) + F.col("_shift"))
    own = shifted.select(key, "pos", t, F.lit(None).cast("bigint").alias("inserted_frame"))
    new = shifted.where(F.col(inserted) > 0).select(key, "pos", t, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(inserted).cast("bigint") - 1)).alias("inserted_frame"))
    new = new.withColumn("pos", F.col("pos") + 1 + F.col("inserted_frame"))
    return own.unionByName(new).withColumn("attention", F.lit(1))


def backfill(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Every value from the last row, in the order given, that has it: one row per key."""
    return df.groupBy(key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])

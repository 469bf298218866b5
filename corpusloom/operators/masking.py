"""Masks drawn at random, reproducibly: every draw is a hash of the seed, the row and the place."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.seeded import uniform


def row_seed(seed: int, epoch: int, row) -> int:
    return int(hashlib.md5(f"{seed}|{epoch}|{row}".encode()).hexdigest()[:15], 16) % 1_000_000


def block_mask(row: Column, t: Column, length: Column, size: int, p: float, seed: int) -> Column:
    """Whether a frame is masked: whole segments of ``size`` with probability p; a short last segment never."""
    return (uniform(seed, row, F.floor(t / size).cast("bigint")) < p) & (F.floor(t / size) < F.floor(length / size))


def drop_row(row: Column, p: float, seed: int) -> Column:
    return uniform(seed, "drop", row) < p


def feature_mask(row: Column, dim: Column, first: int, second: int, keep: float, seed: int) -> Column:
    """1 or 0: dimensions below ``first`` stay; from there a row keeps them with one draw, from ``second`` with that and
    another, so that the second set is dropped whenever the first is."""
    a, b = uniform(seed, "a", row) < keep, uniform(seed, "b", row) < keep
    return F.when(dim < first, 1).when(dim < second, a.cast("int")).otherwise((a & b).cast("int"))


def apply_mask(value: Column, mask: Column, filler: Column) -> Column:
    return F.when(mask, filler).otherwise(value)


def additive(mask: Column, low: float = -1000.0) -> Column:
    return F.when(mask, low).otherwise(0.0)


#: Laws of span lengths: (generator, number, typical length, other parameter) to lengths of at least 1.
LAWS = {
    "static": lambda rng, n, span, other: np.full(n, span),
    "uniform": lambda rng, n, span, other: rng.integers(int(other), 2 * span - int(other), n, endpoint=True),
    "normal": lambda rng, n, span, other: np.rint(rng.normal(span, other, n)).astype(int),
    "poisson": lambda rng, n, span, other: rng.poisson(span, n),
}


def span_count(length: int, p: float, span: int, least: int, draw: float) -> int:
    """How many spans cover the share p of a row, the fraction being rounded by a draw from [0, 1); as many as ``least``
    and no more than find room side by side, but one."""
    return max(1, min(max(least, math.floor(p * length / span + draw)), length // span))


def strewn(length: int, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Places of spans that may overlap: different starts, from which the shortest span fits; what sticks out is cut."""
    room = max(1, length - int(sizes.min()))
    sizes = sizes[:room]
    start = rng.permutation(room)[: len(sizes)]
    edge = np.bincount(start, minlength=length + 1) - np.bincount(np.minimum(start + sizes, length), minlength=length + 1)
    return np.flatnonzero(np.cumsum(edge[:length]) > 0)


def spaced(length: int, sizes: np.ndarray, space: int, rng: np.random.Generator) -> np.ndarray:
    """Places of spans that keep ``space`` open frames between them: what the spans leave is dealt over the gaps before,
    between and behind them, all ways being equally likely. The last spans are left out while there is no room."""
    ends = np.cumsum(sizes) + space * np.arange(len(sizes))
    sizes = sizes[: int(np.searchsorted(ends, length, "right"))]
    k = len(sizes)
    if not k:
        return np.zeros(0, int)
    free = length - int(sizes.sum()) - space * (k - 1)
    bars = np.sort(rng.permutation(free + k)[:k]) - np.arange(k)  # free frames in front of each span
    start = bars + np.concatenate([[0], np.cumsum(sizes[:-1] + space)])
    return np.repeat(start, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def span_places(length: int, p: float, span: int, least: int, law: str, other: float, apart: bool, space: int, rng: np.random.Generator) -> np.ndarray:
    """Sorted masked places of one row."""
    drawn = LAWS[law](rng, span_count(length, p, span, least, rng.random()), span, other)
    sizes = np.clip(drawn, 1, max(1, length - 1))
    return spaced(length, sizes, space, rng) if apart else strewn(length, sizes, rng)


def span_mask(df: DataFrame, row: str, length: str, p: float = 0.65, span: int = 10, least: int = 2, law: str = "static", other: float = 0.0, apart: bool = False, space: int = 1, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(row, length, masked): sorted masked places of each row. Spans overlap or, with ``apart``, keep ``space`` frames
    between them. Rows of no length have none; a row is never masked whole (its last place is left open then)."""
    if law not in LAWS:
        raise ValueError(f"no law {law!r}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r, n in zip(pdf["row"], pdf["length"]):
                places = span_places(int(n), p, span, least, law, other, apart, space, np.random.default_rng(row_seed(seed, epoch, r))) if n and n > 0 else np.zeros(0, int)
                out.append((places[:-1] if n and len(places) >= n else places).tolist())
            yield pd.DataFrame({"row": pdf["row"], "length": pdf["length"], "masked": out})

    src = df.select(F.col(row).cast("bigint").alias("row"), F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("length"))
    return src.mapInPandas(run, "row long, length long, masked array<long>")


def equalised(df: DataFrame, key: str, places: str, seed: int, length: str | None = None) -> DataFrame:
    """All rows with the same number of masked places: cut to the smallest number or, given the column of lengths, filled
    up to the greatest with open places (all of them, if a row has too few). Places of the least hashes go first."""
    ranked = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(uniform(seed, F.col(key), x).alias("u"), x.alias("v")))), lambda s: s.v)
    size = F.greatest(F.size(places), F.lit(0))
    bound = df.agg((F.min(size) if length is None else F.max(size)).alias("_m"))
    both = df.crossJoin(F.broadcast(bound))  # one row
    if length is None:
        return both.withColumn(places, F.array_sort(F.slice(ranked(F.col(places)), F.lit(1), F.col("_m")))).drop("_m")
    all_ = F.when(F.col(length) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(length).cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    more = F.slice(ranked(F.array_except(all_, places)), F.lit(1), F.greatest(F.col("_m") - size, F.lit(0)))
    return both.withColumn(places, F.array_sort(F.concat(places, more))).drop("_m")


def thinned(df: DataFrame, key: str, places: str, share: float, seed: int) -> DataFrame:
    """Mask drop-out: the share of the masked places, rounded, that has the least hashes is left open, row by row."""
    ranked = F.transform(F.array_sort(F.transform(places, lambda x: F.struct(uniform(seed, "thin", F.col(key), x).alias("u"), x.alias("v")))), lambda s: s.v)
    gone = F.round(F.size(places) * share).cast("int")
    return df.withColumn(places, F.array_sort(F.slice(ranked, gone + 1, F.greatest(F.size(places) - gone, F.lit(0)))))


def mask_ratio(masks: DataFrame) -> DataFrame:
    return masks.agg(F.avg(F.size("masked") / F.greatest(F.col("length"), F.lit(1))).alias("ratio"), F.count(F.lit(1)).alias("rows"))


def expected_ratio(p: float, span: int) -> float:
    """Share masked when spans of one length may overlap."""
    return 1 - math.exp(-p)

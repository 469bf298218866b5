"""Vector quantisation: nearest codes, code counts, k-means steps and moving averages of code books.

A code book is a parameter, refused beyond ``MOST_CODES`` codes; it travels to the executors as an array. Vectors are
compared by the expansion ``|z|^2 + |e|^2 - 2 z.e`` in Arrow batches, so vectors are never paired with codes as rows.
Ties go to the smaller code. Null vectors and vectors of another length get no code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CODES = 65536


def code_book(df: DataFrame, code: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select(code, vec).where(F.col(vec).isNotNull()).orderBy(code).limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"a code book has at most {MOST_CODES} codes")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)


def assign(vectors: DataFrame, vec_id: str, vec: str, book: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(vec_id, code, distance) of the nearest code by squared distance."""
    sent = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, e = sent.value
        e2 = (e**2).sum(1)
        for b in batches:
            z = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float) if b.num_rows else np.zeros((0, e.shape[1]))
            d = np.round((z**2).sum(1)[:, None] + e2[None] - 2 * z @ e.T, 9) if b.num_rows else np.zeros((0, len(codes)))
            k = d.argmin(1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes[k]), pa.array(d[np.arange(len(k)), k])], names=["id", "code", "distance"])

    if not len(book[0]):
        return vectors.select(F.col(vec_id), F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("double").alias("distance")).limit(0)
    good = vectors.where(F.col(vec).isNotNull() & (F.size(vec) == book[1].shape[1]))
    return good.select(F.col(vec_id).cast("bigint").alias("id"), vec).mapInArrow(run, "id long, code long, distance double").withColumnRenamed("id", vec_id)


def histogram(assigned: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Vectors per code, with zeros for codes without any."""
    return codes.select(code).join(assigned.groupBy(code).agg(F.count(F.lit(1)).alias("n")), code, "left").select(code, F.coalesce("n", F.lit(0)).alias("n"))


def smoothed(hist: DataFrame, eps: float) -> DataFrame:
    """Laplace-smoothed counts: (n + eps) / (N + K eps) * N."""
    total = hist.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return hist.crossJoin(F.broadcast(total)).withColumn("smooth", (F.col("n") + eps) / (F.col("_t") + F.col("_k") * eps) * F.col("_t")).drop("_t", "_k")


def means(assigned: DataFrame, vectors: DataFrame, vec_id: str, vec: str, code: str = "code") -> DataFrame:
    """(code, dim, mean, n) of the vectors of each code: partial sums, no group in one task."""
    long = assigned.select(vec_id, code).join(vectors.select(vec_id, F.posexplode(vec).alias("dim", "x")), vec_id)
    return long.groupBy(code, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def kmeans(vectors: DataFrame, vec_id: str, vec: str, book: tuple[np.ndarray, np.ndarray], rounds: int = 10, cosine: bool = False) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Centres after some rounds and the counts of the last assignment. Codes without vectors keep their centre; with
    ``cosine`` centres are brought back to length 1."""
    codes, e = book[0], book[1].copy()
    counts = np.zeros(len(codes), np.int64)
    for _ in range(rounds):
        rows = means(assign(vectors, vec_id, vec, (codes, e)), vectors, vec_id, vec).collect()  # codes x dimensions
        at, counts = {c: i for i, c in enumerate(codes.tolist())}, np.zeros(len(codes), np.int64)
        for r in rows:
            e[at[r["code"]], r["dim"]] = r["mean"]
            counts[at[r["code"]]] = r["n"]
        if cosine:
            e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    return (codes, e), counts


def moving(old: Column, new: Column, decay: float) -> Column:
    return old * decay + new * (1 - decay)

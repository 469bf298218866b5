"""Keyed state over streams: left context, causal filters, delayed subsampling and moving cut-offs.

Each operator is a pure step ``(state, rows) -> (state, rows)``. Spark keeps the state per key and hands over the rows
of a micro-batch, which are sorted by (ts, id) here, as their order within a batch isn't given. The result doesn't
depend on where micro-batches are cut: the batch forms in ``operators`` give the same rows (see the tests). What a
task holds is the rows of one key in one micro-batch, bounded by ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of
the source. Rows that arrive in a later batch than rows behind them in time aren't moved back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.session import shared_dir


def keyed(stream: DataFrame, key: str, order: list[str], step: Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]], out: str, state: str) -> DataFrame:
    """Applies a step per key, with state kept from batch to batch. ``out`` begins with the key."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable").reset_index(drop=True)
        new, result = step(tuple(held.get) if held.exists else None, rows)
        held.update(new)
        result.insert(0, key, k[0])
        yield result

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def left_context(stream: DataFrame, key: str, order: list[str], value: str, depth: int) -> DataFrame:
    """(key, t, context): every frame with the ``depth`` frames before it, oldest first."""

    def step(state, rows):
        t, tail = (state[0], list(state[1])) if state else (0, [])
        ts, out = [], []
        for v in rows[value].tolist():
            tail = (tail + [v])[-(depth + 1) :]
            ts.append(t)
            out.append(list(tail))
            t += 1
        return (t, tail[-depth:] if depth else []), pd.DataFrame({"t": ts, "context": out})

    return keyed(stream, key, order, step, f"{key} bigint, t bigint, context array<bigint>", "t bigint, tail array<bigint>")


def causal_fir(stream: DataFrame, key: str, order: list[str], value: str, kernel: list[float]) -> DataFrame:
    """(key, t, y): weighted sum of a frame and those before it; the last weight is that of the frame itself."""
    k = len(kernel)

    def step(state, rows):
        t, tail = (state[0], list(state[1])) if state else (0, [0.0] * (k - 1))
        ts, ys = [], []
        for v in rows[value].tolist():
            window = tail + [v]
            ys.append(sum(a * b for a, b in zip(kernel, window)))
            ts.append(t)
            tail, t = window[1:], t + 1
        return (t, tail), pd.DataFrame({"t": ts, "y": ys})

    return keyed(stream, key, order, step, f"{key} bigint, t bigint, y double", "t bigint, tail array<double>")


def delayed(stream: DataFrame, key: str, order: list[str], value: str, ahead: int) -> DataFrame:
    """(key, t, ahead_sum): sum of a frame and the ``ahead`` frames behind it, given out once those have come."""

    def step(state, rows):
        t, wait = (state[0], list(state[1])) if state else (0, [])
        ts, ys = [], []
        for v in rows[value].tolist():
            wait.append(v)
            if len(wait) > ahead:
                ts.append(t)
                ys.append(float(sum(wait)))
                wait, t = wait[1:], t + 1
        return (t, wait), pd.DataFrame({"t": ts, "ahead_sum": ys})

    return keyed(stream, key, order, step, f"{key} bigint, t bigint, ahead_sum double", "t bigint, wait array<double>")


def chunks(stream: DataFrame, key: str, order: list[str], value: str, size: int, left: int) -> DataFrame:
    """(key, chunk, seen_sum, seen): whole chunks with what they and ``left`` chunks before them hold. An incomplete
    chunk waits in the state."""

    def step(state, rows):
        c, wait, sums = (state[0], list(state[1]), list(state[2])) if state else (0, [], [])
        out = []
        for v in rows[value].tolist():
            wait.append(v)
            if len(wait) == size:
                sums = (sums + [float(sum(wait))])[-(left + 1) :]
                out.append((c, sum(sums), len(sums) * size))
                c, wait = c + 1, []
        return (c, wait, sums), pd.DataFrame(out, columns=["chunk", "seen_sum", "seen"])

    return keyed(stream, key, order, step, f"{key} bigint, chunk bigint, seen_sum double, seen bigint", "c bigint, wait array<double>, sums array<double>")


def cutoff(stream: DataFrame, key: str, order: list[str], value: str, p: float) -> DataFrame:
    """(key, t, above): whether a value exceeds a cut-off that moves so that a share ``p`` does."""

    def step(state, rows):
        c, n, hits = state if state else (0.0, 0, 0)
        ts, out = [], []
        for v in rows[value].tolist():
            hit = v > c
            ts.append(n)
            n, hits = n + 1, hits + hit
            off = hits / n - p
            if (off > 0) == hit:
                c = v * abs(off) + c * (1 - abs(off))
            out.append(bool(hit))
        return (float(c), int(n), int(hits)), pd.DataFrame({"t": ts, "above": out})

    return keyed(stream, key, order, step, f"{key} bigint, t bigint, above boolean", "cutoff double, n bigint, hits bigint")


def drain(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, into files, and reads them back.

    Files and checkpoint lie in the shared folder unless given. With a given checkpoint a second call goes on where the
    first ended; every row is written exactly once.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/out", checkpoint or f"{base}/state"
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def source(spark: SparkSession, path: str, ddl, files_per_batch: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder, or over a single file."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)

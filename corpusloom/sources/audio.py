"""Audio files as rows: decoding, header probes and a registry of decoders.

PCM WAV is decoded with the standard library; other formats by decoders that users register. A file that can't be
decoded is a row with ``ok`` false and the reason, never a failed job.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Decoders by lower-case extension: (content, most frames or None) to (rate, channels x samples).
DECODERS: dict[str, Callable[[bytes, int | None], tuple[int, np.ndarray]]] = {}

#: Samples of decoded files that are held at most, besides those of one file.
HELD = 1 << 20

SCHEMA = "path string, ok boolean, error string, sample_rate int, channels array<array<float>>"


def decoder(*extensions: str):
    def register(f):
        for e in extensions:
            DECODERS[e] = f
        return f

    return register


@decoder("wav", "wave")
def wav(content: bytes, frames: int | None = None) -> tuple[int, np.ndarray]:
    """PCM of 8, 16, 24 or 32 bits, scaled to [-1, 1); at most ``frames`` frames are read."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, n = w.readframes(w.getnframes() if frames is None else min(frames, w.getnframes())), w.getsampwidth(), w.getnchannels()
        rate = w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return rate, x.reshape(-1, n).T


def nested(rows: list[list[np.ndarray] | None]) -> pa.Array:
    """Rows of lists of vectors as an Arrow array of lists of lists of floats, without a Python number for each."""
    missing = pa.array([r is None for r in rows], pa.bool_())
    rows = [r or [] for r in rows]
    vectors = [np.ascontiguousarray(v, np.float32).ravel() for r in rows for v in r]
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, vectors)]), pa.int32()), pa.array(np.concatenate(vectors) if vectors else np.zeros(0, np.float32)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), inner, mask=missing)


_ROW = pa.schema([("path", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.list_(pa.list_(pa.float32())))])


def decode(files: DataFrame, frames: int | None = None) -> DataFrame:
    """(path, content) of binary files to decoded rows. ``frames`` limits what is read of each. Rows leave in batches of
    ``HELD`` samples, so that no more than these and one decoded file are held; short files don't cost a batch each."""
    table = dict(DECODERS)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols[:4], _ROW)), nested(cols[4])], schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for path, content in zip(*(b.column(i) for i in (0, 1))):
                name = path.as_py()
                try:
                    rate, x = table[name.rsplit(".", 1)[-1].lower()](content.as_py(), frames)
                    rows.append((name, True, None, rate, [np.ascontiguousarray(v, np.float32).ravel() for v in x]))
                    held += sum(map(len, rows[-1][4]))
                except Exception as e:  # any broken file is a row
                    rows.append((name, False, f"{type(e).__name__}: {e}"[:200], None, None))
                if held >= HELD:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_audio(spark: SparkSession, path: str, frames: int | None = None) -> DataFrame:
    return decode(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), frames)


def has_header(content):
    """Whether bytes begin like an MP3 file: an ID3 tag or a frame with a valid version, layer, rate and bit rate."""
    head = F.hex(F.substring(content, 1, 4))
    b = [F.conv(F.substring(head, 2 * i + 1, 2), 16, 10).cast("int") for i in range(4)]
    sync = (b[0] == 255) & (b[1] >= 224) & (b[1].bitwiseAND(F.lit(24)) != 8) & (b[1].bitwiseAND(F.lit(6)) != 0)
    rates = (b[2].bitwiseAND(F.lit(240)) != 240) & (b[2].bitwiseAND(F.lit(12)) != 12)
    return F.coalesce((F.substring(head, 1, 6) == "494433") | (sync & rates), F.lit(False))


def probe(files: DataFrame, endings: tuple[str, ...] = (".mp3",)) -> DataFrame:
    """(path, valid): files with other endings are valid unseen."""
    ending = F.lit(False)
    for e in endings:
        ending = ending | F.lower("path").endswith(e)
    return files.select("path", F.when(ending, has_header(F.col("content"))).otherwise(True).alias("valid"))

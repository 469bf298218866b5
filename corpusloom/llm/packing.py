"""Filling containers of fixed capacity with documents, along a space-filling curve.

Documents are sized in tokens of a public tokenizer. Each gets a hashed vector (the mean of fixed random vectors of its
tokens) projected to ``DIMS`` dimensions, and the key of that point on a Hilbert curve. Documents are range-sorted by
the key, so that neighbours in content are neighbours in order, and every range is packed by itself, for each capacity,
in windows along the curve: within a window by best fit, larger pieces first, into the containers still open. The
fullest containers are closed when a window ends. A document is cut only if it is larger than the capacity; then all
pieces but its last fill a container each.

The number of ranges follows the number of tokens, so that a task packs about ``TOKENS_PER_RANGE`` of them whatever the
corpus; at most one window's worth of containers per range stays badly filled. Equal documents, however many, have
their id as second key and spread over ranges.

Edge cases: null and empty texts have no tokens and are in no container; a text of blanks has tokens and is packed;
capacities that are null or not positive are refused; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public tokenizer's vocabulary expects text to be cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
DIMS, BITS = 3, 10
TOKENS_PER_RANGE = 4_000_000
#: Documents packed together, and containers that stay open from one window to the next. The smaller the window, the
#: nearer on the curve are the documents of a container, and the more room is left over.
WINDOW, OPEN = 512, 64


def tokenizer(path: str = TOKENIZER):
    """The tokenizer whose ranks are in a file; one per process."""
    import tiktoken

    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


_LOADED: dict = {}


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) with coordinates below ``2**bits``, by the transposed form."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= np.where(high, 0, t) if i else 0
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_SIZED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("curve", pa.int64())])


def sized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, curve)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        table_ = np.random.default_rng(17).standard_normal((1 << 13, DIMS)).astype(np.float32)
        for b in batches:
            counts, means = [], np.zeros((b.num_rows, DIMS), np.float32)
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.asarray(enc.encode_ordinary(text), np.int64)
                counts.append(len(ids))
                if len(ids):
                    means[i] = table_[ids & ((1 << 13) - 1)].mean(0)
            grid = np.floor((0.5 + np.arctan(means * 6) / np.pi) * ((1 << BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(hilbert_key(grid))], schema=_SIZED)

    return docs.where("text is not null and text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, curve long")


class Packer:
    """Packs the documents of one range into containers of one capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.room: list[int] = []  # of the open containers, ascending
        self.numbers: list[int] = []

    def _place(self, size: int) -> int:
        i = bisect.bisect_left(self.room, size)
        if i < len(self.room):
            left, number = self.room.pop(i) - size, self.numbers.pop(i)
        else:
            left, number = self.capacity - size, self.made
            self.made += 1
        if left:
            j = bisect.bisect_left(self.room, left)
            self.room.insert(j, left)
            self.numbers.insert(j, number)
        return number

    def window(self, ids: list[int], sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(container number, doc id, piece number, first token, tokens) of the documents."""
        pieces, out = [], []
        for doc, n in zip(ids, sizes):
            whole = n // self.capacity if n > self.capacity else 0
            for k in range(whole):
                out.append((self.made, doc, k, k * self.capacity, self.capacity))
                self.made += 1
            if n - whole * self.capacity:
                pieces.append((n - whole * self.capacity, doc, whole, whole * self.capacity))
        pieces.sort(key=lambda p: -p[0])
        out += [(self._place(n), doc, k, at, n) for n, doc, k, at in pieces]
        if len(self.room) > OPEN:  # the fullest are closed
            cut = len(self.room) - OPEN
            del self.room[:cut], self.numbers[:cut]
        return out


_PACKED = pa.schema([("container", pa.string()), ("container_no", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])


def pack(items: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """Items (doc_id, n_tokens, curve), read from files, to the contents of containers."""
    if any(c is None or c <= 0 for _, c in capacities):
        raise ValueError("capacities must be positive")
    total = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // TOKENS_PER_RANGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * 1_000_000_000
        packers = [(name, Packer(c)) for name, c in capacities]

        def done(ids: list[int], sizes: list[int]) -> pa.RecordBatch:
            rows = [(name, base + r[0], *r[1:]) for name, p in packers for r in p.window(ids, sizes)]
            cols = list(zip(*rows)) or [()] * len(_PACKED)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PACKED)], schema=_PACKED)

        ids, sizes = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            sizes += b.column(1).to_pylist()
            while len(ids) >= WINDOW:
                yield done(ids[:WINDOW], sizes[:WINDOW])
                ids, sizes = ids[WINDOW:], sizes[WINDOW:]
        if ids:
            yield done(ids, sizes)

    ordered = items.where("n_tokens > 0").repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ordered.select("doc_id", "n_tokens").mapInArrow(run, "container string, container_no long, doc_id long, piece long, first_token long, n_tokens long")


def capacities(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    rows = table(spark, d, "pack_targets").where("container is not null").orderBy("container").limit(101).collect()
    if len(rows) > 100:
        raise ValueError("pack_targets is a parameter table of at most 100 rows")
    return [(r["container"], r["capacity_tokens"]) for r in rows]


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Contents of all containers."""
    items = written(sized(table(spark, d, "documents")), "p7-sizes")
    return pack(items, capacities(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every container with its fill."""
    cap = spark.createDataFrame(capacities(spark, d), "container string, capacity_tokens long")
    used = p7_pack(spark, d).groupBy("container", "container_no").agg(F.sum("n_tokens").alias("used_tokens"), F.countDistinct("doc_id").alias("n_docs"))
    return used.join(F.broadcast(cap), "container").withColumn("fill", F.round(F.col("used_tokens") / F.col("capacity_tokens"), 6))


QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}

"""Evaluation passages in documents: SimHash windows, multi-index Hamming blocks and an exact check.

Passages are cut into windows of ``WINDOW`` words, the item size at which a leak of 12 words with one changed word
still has an unchanged window. Each window has a 64-bit SimHash over its words and pairs of neighbouring words. All
document windows are fingerprinted by rolling sums and probed in ``RADIUS`` + 1 blocks of bits: a document window
within ``RADIUS`` bits of a passage window agrees with it in one block, so no such pair is missed. Hits are verified by
the weighted similarity of the words of both windows, then by aligning passage and document around the hit: at least
``LEAST`` words of the passage in their order, with at most one word in ten replaced, left out or added.

Passages are the stated query set. They are sent to the executors in blocks of at most ``BLOCK_WORDS`` words, one pass
over the documents for each block, so that what is broadcast has a fixed bound whatever the number of passages.

Edge cases: null texts hold nothing; passages of fewer than 12 words can't leak; repeated passages and documents each
count; very long documents are read whole, in steps of fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import table

WINDOW, RADIUS, LEAST, ONE_IN = 6, 2, 12, 10
#: Weighted similarity of the words of two windows that is worth an alignment.
SIMILAR = 0.6
BLOCK_WORDS = 400_000
#: Words fingerprinted at once.
STEP = 20_000
_BITS = (22, 21, 21)
_CLEAN = re.compile(r"<[^<>]{0,200}>|\[\d{1,2}:\d\d(?::\d\d)?\]|^[ \t]*[A-Z][A-Za-z0-9]{0,12}:[ \t]|&[a-z]{2,6};", re.M)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def words(text: str) -> list[str]:
    """Words in lower case; markup, time marks and speaker marks left out, punctuation dropped."""
    return [w.replace("’", "").replace("'", "").replace("-", "") for w in _WORD.findall(_CLEAN.sub(" ", text).lower())]


class Fingerprints:
    """SimHash of word windows from fixed random signs."""

    def __init__(self) -> None:
        rng = np.random.default_rng(29)
        self.signs = (rng.integers(0, 2, (1 << 16, 64), dtype=np.int8) * 2 - 1).astype(np.int8)
        self.cells: dict[str, int] = {}

    def ids(self, ws: list[str]) -> np.ndarray:
        cells, out = self.cells, []
        for w in ws:
            c = cells.get(w)
            if c is None:
                c = xxhash.xxh32_intdigest(w)
                if len(cells) < 500_000:
                    cells[w] = c
            out.append(c)
        return np.array(out, np.uint64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Fingerprints of all windows of a word sequence."""
        if len(ids) < WINDOW:
            return np.array([], np.uint64)
        one = self.signs[(ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)]
        pair = self.signs[((ids[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + ids[1:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)]
        n = len(ids) - WINDOW + 1
        total = one[:n].copy()
        for k in range(1, WINDOW):
            total += one[k : k + n]
        for k in range(WINDOW - 1):
            total += pair[k : k + n]
        return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


def _blocks(fp: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 64
    for b in _BITS:
        shift -= b
        out.append(((fp >> np.uint64(shift)) & np.uint64((1 << b) - 1)).astype(np.int64))
    return out


class Index:
    """Passages with their windows, by block of the fingerprint."""

    def __init__(self, passages: list[tuple[int, str]]):
        self.fingerprints = Fingerprints()
        self.ids, self.words, at, fps = [], [], [], []
        df: Counter = Counter()
        for pid, text in passages:
            ws = words(text)
            if len(ws) < LEAST:
                continue
            f = self.fingerprints(self.fingerprints.ids(ws))
            at += [(len(self.ids), i) for i in range(len(f))]
            fps.append(f)
            self.ids.append(pid)
            self.words.append(ws)
            df.update(set(ws))
        self.weight = {w: math.log(1 + len(self.ids) / c) for w, c in df.items()}
        self.unknown = math.log(1 + max(1, len(self.ids)))
        self.at = np.array(at, np.int64).reshape(-1, 2)
        self.fp = np.concatenate(fps) if fps else np.array([], np.uint64)
        self.order, self.sorted, self.flags = [], [], []
        for values, b in zip(_blocks(self.fp), _BITS):
            o = np.argsort(values, kind="stable")
            flag = np.zeros(1 << b, bool)
            flag[values] = True
            self.order.append(o)
            self.sorted.append(values[o])
            self.flags.append(flag)

    def hits(self, fp: np.ndarray) -> np.ndarray:
        """(window of fp, window of the index) pairs within the radius."""
        out = []
        for values, o, s, flag in zip(_blocks(fp), self.order, self.sorted, self.flags):
            q = np.flatnonzero(flag[values])
            if not len(q):
                continue
            lo, hi = np.searchsorted(s, values[q]), np.searchsorted(s, values[q], "right")
            n = hi - lo
            a = np.repeat(q, n)
            b = o[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            ok = np.bitwise_count(fp[a] ^ self.fp[b]) <= RADIUS
            out.append(np.stack([a[ok], b[ok]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def similarity(self, a: list[str], b: list[str]) -> float:
        """Weighted words in common over the weighted words of both."""
        x, y = Counter(a), Counter(b)
        w = lambda c: sum(self.weight.get(k, self.unknown) * n for k, n in c.items())
        return 2 * w(x & y) / max(1e-9, w(x) + w(y))

    def leaked(self, ws: list[str], hits: np.ndarray) -> set[int]:
        """Ids of the passages that the words hold, given (word position, index window) hits."""
        by: dict[int, set[int]] = defaultdict(set)
        for pos, win in hits.tolist():
            p, at = self.at[win].tolist()
            by[p].add((pos, at))
        found = set()
        for p, places in by.items():
            passage, tried = self.words[p], set()
            for pos, at in sorted(places):
                diagonal = (pos - at) // 4
                if diagonal in tried or self.similarity(ws[pos : pos + WINDOW], passage[at : at + WINDOW]) < SIMILAR:
                    continue
                if aligned(passage, ws, pos - at):
                    found.add(self.ids[p])
                    break
                tried.add(diagonal)
        return found


def aligned(passage: list[str], ws: list[str], shift: int) -> bool:
    """Whether the words hold enough of the passage, near the diagonal on which passage word i is word i + shift.

    best[e][j] is the longest stretch of the passage that ends at the present passage word and word j, both equal or
    changed, with e changes; a stretch begins and ends with equal words.
    """
    reach = len(passage) // ONE_IN + 2
    most = max(1, len(passage) // ONE_IN)
    lo = max(0, shift - reach)
    hi = min(len(ws), shift + len(passage) + reach)
    part = ws[lo:hi]
    n = len(part)
    before = [[0] * (n + 1) for _ in range(most + 1)]
    for i, w in enumerate(passage):
        now = [[0] * (n + 1) for _ in range(most + 1)]
        mid = i + shift - lo
        for j in range(max(0, mid - reach), min(n, mid + reach + 1)):
            same = part[j] == w
            for e in range(most + 1):
                if same:
                    v = before[e][j] + 1 if before[e][j] or e == 0 else 0
                else:
                    v = 0
                if e:
                    for x in (before[e - 1][j] + 1 if before[e - 1][j] else 0, before[e - 1][j + 1] + 1 if before[e - 1][j + 1] else 0, now[e - 1][j]):
                        if x > v:
                            v = x
                now[e][j + 1] = v
                if same and v >= LEAST and e * ONE_IN <= v:
                    return True
        before = now
    return False


_FOUND = pa.schema([("passage_id", pa.int64()), ("doc_id", pa.int64())])


def _passage_blocks(rows: Iterator) -> Iterator[list[tuple[int, str]]]:
    block, n = [], 0
    for r in rows:
        if r["text"] is None:
            continue
        block.append((r["passage_id"], r["text"]))
        n += len(r["text"]) // 4
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """All (passage_id, doc_id) such that the document holds enough of the passage."""
    spark = docs.sparkSession
    out = None
    for block in _passage_blocks(passages.select("passage_id", "text").toLocalIterator()):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for b in batches:
                pids, dids = [], []
                for doc, ids_text in _grouped(b, index):
                    ws, hits = ids_text
                    for p in index.leaked(ws, hits):
                        pids.append(p)
                        dids.append(doc)
                yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(dids, pa.int64())], schema=_FOUND)

        part = docs.where("text is not null").select("doc_id", "text").mapInArrow(run, "passage_id long, doc_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else spark.createDataFrame([], "passage_id long, doc_id long")


def _grouped(b: pa.RecordBatch, index: Index) -> Iterator[tuple[int, tuple[list[str], np.ndarray]]]:
    """Documents that have hits, with their words and hits; many short documents are fingerprinted together."""

    def flush(group: list[tuple[int, list[str]]]) -> Iterator:
        every = [w for _, ws in group for w in ws]
        ids = index.fingerprints.ids(every)
        found = [np.zeros((0, 2), np.int64)]
        for s in range(0, max(1, len(ids) - WINDOW + 1), STEP):
            h = index.hits(index.fingerprints(ids[s : s + STEP + WINDOW - 1]))
            h[:, 0] += s
            found.append(h)
        hits = np.concatenate(found)
        start = 0
        hits = hits[np.argsort(hits[:, 0], kind="stable")]
        for doc, ws in group:
            lo, hi = np.searchsorted(hits[:, 0], [start, start + len(ws) - WINDOW + 1])
            if hi > lo:
                mine = hits[lo:hi].copy()
                mine[:, 0] -= start
                yield doc, (ws, mine)
            start += len(ws)

    group, n = [], 0
    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        ws = words(text)
        if len(ws) < LEAST - LEAST // ONE_IN:
            continue
        group.append((doc, ws))
        n += len(ws)
        if n >= STEP:
            yield from flush(group)
            group, n = [], 0
    if group:
        yield from flush(group)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked passages per task: how many, and in how many documents."""
    p = table(spark, d, "eval_passages").select("passage_id", "task")
    found = p8_found(spark, d).join(p, "passage_id")
    return found.groupBy("task").agg(F.countDistinct("passage_id").alias("n_passages"), F.countDistinct("doc_id").alias("n_docs"))


QUERIES = {"p8_found": p8_found, "p8_report": p8_report}
ORACLE: dict[str, str] = {}

"""Near-duplicate replies: a set-similarity join with adaptive multi-match prefixes.

Similarity is twice the words in common, as multisets, over the words of both; pairs of at least ``MIN_WORDS`` words
each and a similarity of at least ``THRESHOLD`` are found, all of them.

1. Exact copies (same multiset of words) become one class; the join runs over one representative of each class.
2. Words are ordered from rare to frequent. Frequencies come from a count over all documents into a table of hashed
   cells that grows with the vocabulary up to ``MOST_CELLS``, so what is sent to the executors has a bound.
3. A document that may lose d words to its partner shares its i-th common word, in that order, within its first d + i
   words. A word whose estimated number of bearers is at most ``MAX_COST`` stands alone as a signature, within the
   first d + 1 words. Partners that share no such word lose all of theirs, r of the d, and share q words within the
   first d - r + q of the others: the prefix is lengthened, and more shared words are asked for. The words are dealt
   over m groups by hash; of q = (depth - 1) m + 1 shared words some group holds ``depth`` at least. Signatures are the
   shortest leading runs of shared words within a group whose estimated bearers are few enough, at most ``depth`` long.
   With m in proportion to the length their number is in proportion to the length, too: there are about depth words in
   each group. m depends on the class of lengths of the longer partner only, and the depth on the corpus only, so that
   both partners take the same decision; a document gives signatures for its own class and the next.
4. Documents of one signature are compared by a 128-bit parity sketch of their words, in vector operations: every word
   in which two documents differ flips at most one bit, so more flipped bits than the threshold allows prove that a
   pair fails. (Beyond some 300 words the threshold allows all bits, and candidates go to the exact check at once.) A signature borne by more than ``BLOCK`` documents is worked off in blocks, spread over tasks.
5. What remains is verified exactly.

Edge cases: null replies, replies of fewer words and empty tables give no rows; a document is never its own partner.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.replies import reply
from corpusloom.session import hot_keys, lookup_join, salted_join, table, written

THRESHOLD = Fraction(8, 10)
MIN_WORDS = 30
#: Cells of the table of frequencies: four for each word of the vocabulary, within these bounds.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 22
#: Estimated bearers of a signature beyond which it is lengthened by one more shared word; each further word must be
#: worth ``GROWTH`` times as many, as the number of signatures grows with it.
MAX_COST = 3000
GROWTH = 4
#: Documents of one signature that are compared at once; more are spread over tasks in blocks of this size.
BLOCK = 8192


def words(text):
    """Words of a text column: pieces between white space, lower-cased, of letters and digits only."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{Z}\s\x{85}\x{1C}-\x{1F}]+", "")
    return F.filter(F.split(clean, r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]+"), lambda w: w != "")


def _numbered(ids):
    """Sorted word hashes to elements that are unique: the n-th occurrence of a word gets n hashed in."""
    places = F.sequence(F.lit(0), F.size(ids) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(ids, i) != F.get(ids, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.size(ids)), F.array(F.size(ids)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.transform(F.sequence(s, e - 1), lambda i: F.xxhash64(F.get(ids, s), i - s))))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (id, text) to representatives (rep, ids: sorted word hashes) and membership (id, rep, n)."""
    hashed = docs.where(F.col("text").isNotNull()).select("id", F.array_sort(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("ids")).where(F.size("ids") >= MIN_WORDS)
    hashed = written(hashed, "p2-words")
    # The key is the multiset itself in 128 bits of hash.
    keyed = hashed.select("id", F.concat_ws("|", F.xxhash64("ids"), F.xxhash64(F.lit(1), F.reverse("ids"))).alias("h"))
    group = keyed.groupBy("h").agg(F.min("id").alias("rep"))
    member = written(lookup_join(keyed, group, "h", "inner").select("id", "rep"), "p2-members")
    reps = hashed.join(member.where("id = rep").select("id"), "id").select(F.col("id").alias("rep"), "ids")
    return reps, member


def _cell_counts(reps: DataFrame) -> np.ndarray:
    """Documents by hashed cell of their words, and the number of documents at the end.

    Counted in ``MOST_CELLS`` cells (at most so many rows come back) and folded to four cells a word, which leaves
    every number an upper bound of the bearers of its words.
    """
    cell = F.explode(F.array_distinct(F.transform("ids", lambda w: F.pmod(w, F.lit(MOST_CELLS)).cast("int"))))
    rows = reps.select(cell.alias("c")).groupBy("c").count().toPandas()
    size = LEAST_CELLS
    while size < min(MOST_CELLS, 4 * len(rows)):
        size *= 2
    out = np.zeros(size + 1, np.int64)
    np.add.at(out, rows["c"].to_numpy(np.int64) % size, rows["count"].to_numpy(np.int64))
    out[size] = reps.count()
    return out


def depth_of(df: np.ndarray, most_cost: float) -> int:
    """Shared words that make a signature selective: so many of the typical words (the geometric mean over all places
    in texts) of those that are too frequent to stand alone."""
    n, held = max(1, int(df[-1])), df[:-1][df[:-1] > most_cost].astype(float)
    if not len(held):
        return 2
    one = -float((held * np.log(np.minimum(held / n, 0.9))).sum() / held.sum()) + math.log(GROWTH)
    return int(min(8, max(2, math.ceil((math.log(n / most_cost) + math.log(GROWTH)) / one))))


class LengthClasses:
    """Classes of lengths of the longer partner: from, to (exclusive), and how many groups their words are dealt over."""

    def __init__(self, depth: int):
        self.depth, self.start = depth, [MIN_WORDS]

    def of(self, n: int) -> int:
        while self.start[-1] <= n:
            self.start.append(-(-self.start[-1] * 3 // 2))
        return bisect.bisect_right(self.start, n) - 1

    def groups(self, c: int) -> int:
        """As many as the longest of the class may lose words, if its shortest pair shares enough for them."""
        low, high = self.start[c], self.start[c + 1] - 1
        shared = -int(-(THRESHOLD * (low + least_partner(low)) / 2) // 1)
        lose = high - -int(-(THRESHOLD * (high + least_partner(high)) / 2) // 1)
        return max(1, min(lose, (shared - 1) // (self.depth - 1)))


def least_partner(n: int) -> int:
    """Words of the shortest partner of a document of n words."""
    return max(MIN_WORDS, -int(-(n * THRESHOLD / (2 - THRESHOLD)) // 1))


#: What a signature's bearer may be: the shorter partner, the longer one.
SHORTER, LONGER = 1, 2


def _signer(df: np.ndarray, most_cost: float):
    """Function from sorted word hashes to (signatures, roles)."""
    cells, total = len(df) - 1, max(1, int(df[-1]))
    log_share = np.log(np.maximum(df[:-1], 1) / total)
    budget, log_growth = float(np.log(most_cost / total)), float(np.log(GROWTH))
    classes_ = LengthClasses(depth_of(df, most_cost))
    depth = classes_.depth

    @functools.cache
    def bounds(n: int) -> tuple[int, int, list[tuple[int, bool, int, int, int]]]:
        """What a document of n words may lose to a shorter and to a longer partner; and for both classes that the longer
        partner may be in: the class, whether it is its own, what it may lose, what as the shorter, and the groups."""
        lose_long = n - -int(-(THRESHOLD * (n + least_partner(n)) / 2) // 1)
        lose_short = n - -int(-(THRESHOLD * (n + n) / 2) // 1)
        own = classes_.of(n)
        classes_.of(2 * n)
        both = [(own, True, lose_long, lose_short, classes_.groups(own))]
        longer = classes_.start[own + 1]
        if least_partner(longer) <= n:
            lose = n - -int(-(THRESHOLD * (n + longer) / 2) // 1)
            both.append((own + 1, False, lose, lose, classes_.groups(own + 1)))
        return lose_long, lose_short, both

    def sign(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids)
        lose_long, lose_short, both = bounds(n)
        share = log_share[ids % cells]
        order = np.lexsort((ids, share))
        ranked, ids = share[order], ids[order]
        # Repeated words are numbered, so that common words are a set.
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        k = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        toks = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (k + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        rare = int(np.searchsorted(ranked, budget, "right"))
        alone = min(rare, lose_long + 1)
        sigs = [_mixed(toks[:alone] ^ (toks[:alone] >> np.uint64(32)))]
        roles = [np.where(np.arange(alone) <= lose_short, LONGER | SHORTER, LONGER).astype(np.int8)]
        for c, own, lose, short, m in both:
            if rare > lose:
                continue  # a partner shares one of the rare words
            need = (depth - 1) * m + 1
            prefix, logs = toks[rare : lose + need], ranked[rare : lose + need]
            # In order of the groups, ranks ascending within each; runs grow by the later members of their group.
            group = (prefix >> np.uint64(20)) % np.uint64(m)
            o = np.argsort(group, kind="stable")
            group, prefix, logs = group[o], prefix[o], logs[o]
            later = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1
            at, key, cost = np.arange(len(group)), _mixed(prefix ^ np.uint64(c + 1)), logs
            for level in range(2, depth + 1):
                n_next = later[at]
                total_ = int(n_next.sum())
                if not total_:
                    break
                step = np.arange(total_) - np.repeat(np.cumsum(n_next) - n_next, n_next)
                at = np.repeat(at, n_next) + 1 + step
                key, cost = _mixed(np.repeat(key, n_next) ^ prefix[at]), np.repeat(cost, n_next) + logs[at]
                done = cost <= budget + (level - 1) * log_growth if level < depth else np.ones(total_, bool)
                sigs.append(key[done])
                roles.append((LONGER if own else 0) | np.where(o[at[done]] < short - rare + need, SHORTER, 0).astype(np.int8))
                at, key, cost = at[~done], key[~done], cost[~done]
        return np.concatenate(sigs), np.concatenate(roles)

    return sign


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sketch(ids: np.ndarray) -> tuple[int, int]:
    h = (ids.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(57)
    bits = np.bincount(h.astype(np.int64), minlength=128) & 1
    lo, hi = np.packbits(bits.astype(np.uint8)).view(np.int64)
    return int(lo), int(hi)


_SIG = pa.schema([("sig", pa.int64()), ("rep", pa.int64()), ("n", pa.int32()), ("role", pa.int8()), ("s0", pa.int64()), ("s1", pa.int64())])


def signatures(reps: DataFrame, counts: np.ndarray) -> DataFrame:
    cost = MAX_COST
    df = reps.sparkSession.sparkContext.broadcast(counts)  # at most ``MOST_CELLS`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signer(df.value, cost)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                rep, ids = b.column(0).to_numpy(), b.column(1)
                values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
                sigs, roles, counts_, lens, halves = [], [], [], [], []
                for i in range(b.num_rows):
                    words_ = values[offsets[i] : offsets[i + 1]]
                    s, ok = sign(words_)
                    sigs.append(s)
                    roles.append(ok)
                    counts_.append(len(s))
                    lens.append(len(words_))
                    halves.append(_sketch(words_))
                each = np.array(counts_)
                half = np.array(halves, np.int64).reshape(-1, 2)
                cols = [np.concatenate(sigs).view(np.int64), np.repeat(rep, each), np.repeat(np.array(lens, np.int32), each), np.concatenate(roles), np.repeat(half[:, 0], each), np.repeat(half[:, 1], each)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SIG)], schema=_SIG)

    return reps.select("rep", "ids").mapInArrow(run, "sig long, rep long, n int, role tinyint, s0 long, s1 long")


def _compare(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks of one signature that the sketches can't rule out."""
    t = float(THRESHOLD)
    out_a, out_b = [], []
    # First against the loosest bound of the two blocks, in bytes; the exact bound only for what passes.
    loosest = min(128, int((1 - t) * (int(a["n"].max()) + int(b["n"].max())) + 1e-9))
    a0, a1, b0, b1 = (x[k].view(np.uint64) for x, k in ((a, "s0"), (a, "s1"), (b, "s0"), (b, "s1")))
    for lo in range(0, len(a["rep"]), 256):
        s = slice(lo, lo + 256)
        flips = np.bitwise_count(a0[s, None] ^ b0[None, :])
        flips += np.bitwise_count(a1[s, None] ^ b1[None, :])
        i, j = np.nonzero(flips <= loosest)
        ok = flips[i, j] <= np.floor((1 - t) * (a["n"][lo + i] + b["n"][j]) + 1e-9)
        i, j = i[ok] + lo, j[ok]
        ra, rb = a["role"][i], b["role"][j]
        role = (a["n"][i] <= b["n"][j]) & (ra & SHORTER > 0) & (rb & LONGER > 0) | (b["n"][j] <= a["n"][i]) & (rb & SHORTER > 0) & (ra & LONGER > 0)
        keep = role & (a["rep"][i] != b["rep"][j]) & (np.minimum(a["n"][i], b["n"][j]) * (2 - t) >= np.maximum(a["n"][i], b["n"][j]) * t - 1e-9)
        if same:
            keep &= i < j
        out_a.append(a["rep"][i[keep]])
        out_b.append(b["rep"][j[keep]])
    return np.concatenate(out_a or [np.array([], np.int64)]), np.concatenate(out_b or [np.array([], np.int64)])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, left, right) to candidate pairs; a group of rows is at most two blocks."""
    names = ["sig", "side", "rep", "n", "role", "s0", "s1"]
    rest: dict[str, np.ndarray] | None = None

    def emit(cols: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        edges = np.flatnonzero(np.diff(cols["sig"]) != 0) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(cols["sig"])]])
        xs, ys = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            g = {k: cols[k][s:e] for k in names}
            if g["side"].any():
                a, b = ({k: v[g["side"] == x] for k, v in g.items()} for x in (1, 2))
                i, j = _compare(a, b, False)
            else:
                i, j = _compare(g, g, True)
            if len(i):
                xs.append(np.minimum(i, j))
                ys.append(np.maximum(i, j))
        if not xs:
            return None
        p = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["x", "y"])

    for b in batches:
        cols = {k: b.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
        if rest is not None:
            cols = {k: np.concatenate([rest[k], cols[k]]) for k in names}
        last = int(np.searchsorted(cols["sig"], cols["sig"][-1])) if len(cols["sig"]) else 0
        rest = {k: v[last:] for k, v in cols.items()}
        if last and (out := emit({k: v[:last] for k, v in cols.items()})) is not None:
            yield out
    if rest is not None and len(rest["sig"]) and (out := emit(rest)) is not None:
        yield out


def _blocked(sigs: DataFrame) -> DataFrame:
    """Signatures with many bearers are cut into blocks; every pair of blocks becomes a group of its own.

    Counts in 2**20 hashed cells, a table of fixed size, tell which signatures can't be large; the others are counted
    one by one.
    """
    cells = 1 << 20
    cell = F.pmod(F.xxhash64("sig"), F.lit(cells)).alias("_c")
    full = sigs.groupBy(cell).count().where(F.col("count") > BLOCK).select("_c")
    counted = sigs.select("sig", cell).join(F.broadcast(full), "_c", "left_semi").groupBy("sig").count()
    large = written(counted.where(F.col("count") > BLOCK).select("sig", F.ceil(F.col("count") / BLOCK).cast("bigint").alias("_n")), "p2-large")
    plain = sigs.withColumn("side", F.lit(0))
    if large.isEmpty():
        return plain
    big = plain.join(large, "sig", "left")  # one row in BLOCK at most: broadcast by AQE if its measured size allows it
    small, hot = big.where("_n is null").drop("_n"), big.where("_n is not null")
    mine = hot.withColumn("_b", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("_n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    spread = mine.withColumn("_o", other)
    same = F.col("_o") == F.col("_b")
    key = F.xxhash64("sig", F.least("_b", "_o"), F.greatest("_b", "_o"))
    side = F.when(same, 0).when(F.col("_b") < F.col("_o"), 1).otherwise(2)
    return small.unionByName(spread.withColumn("sig", key).withColumn("side", side).select(*small.columns))


def similar_representatives(reps: DataFrame) -> DataFrame:
    """All pairs (x, y), x < y, of representatives that are similar enough."""
    counts = _cell_counts(reps)
    sigs = _blocked(written(signatures(reps, counts), "p2-signatures"))
    grouped = sigs.select("sig", "side", "rep", "n", "role", "s0", "s1").repartition("sig").sortWithinPartitions("sig")
    candidates = grouped.mapInArrow(_pairs, "x long, y long").distinct()
    unique = reps.select("rep", _numbered(F.col("ids")).alias("ids"))
    both = candidates.join(unique.select(F.col("rep").alias("x"), F.col("ids").alias("a")), "x").join(unique.select(F.col("rep").alias("y"), F.col("ids").alias("b")), "y")
    common = F.size(F.array_intersect("a", "b"))
    enough = common * 2 * THRESHOLD.denominator >= (F.size("a") + F.size("b")) * THRESHOLD.numerator
    return both.where(enough).select("x", "y")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_samples").select(F.col("row_idx").alias("id"), reply().alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of samples whose replies are similar enough, copies included."""
    reps, member = classes(_docs(spark, d))
    pairs = written(similar_representatives(reps), "p2-pairs")
    m = member.select("id", "rep")
    hot = hot_keys(m, "rep")  # classes of very many copies are salted
    left = salted_join(m.select(F.col("id").alias("i"), F.col("rep").alias("x")), pairs, "x", "i", hot=hot)
    between = salted_join(m.select(F.col("id").alias("j"), F.col("rep").alias("y")), left, "y", "j", hot=hot).select("i", "j")
    inside = salted_join(m.select(F.col("id").alias("i"), "rep"), m.select(F.col("id").alias("j"), "rep"), "rep", "i", hot=hot).where("i < j").select("i", "j")
    return between.unionByName(inside).select(F.least("i", "j").alias("row_idx_a"), F.greatest("i", "j").alias("row_idx_b")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (id) to the least id of their component, over undirected edges (x, y).

    Alternates large-star and small-star rounds, written to the shared folder; stops when a round changes nothing.
    """
    now = written(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "p2-edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, "p2-edges")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            return nodes.join(after.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("_m")), "id", "left").select("id", F.coalesce("_m", "id").alias("component"))
        now = after


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample with at least 30 words: its class of exact copies, links of its class, and its group."""
    reps, member = classes(_docs(spark, d))
    pairs = written(similar_representatives(reps), "p2-pairs")
    degree = pairs.select(F.col("x").alias("rep")).union(pairs.select("y")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    group = components(pairs, reps.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep")
    out = member.join(group, "rep").join(degree, "rep", "left")
    return out.select(F.col("id").alias("row_idx"), F.col("rep").alias("class_id"), F.col("component").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
#: All pairs by counting common words, numbered when repeated.
ORACLE = {
    "p2_found": r"""
WITH r AS (SELECT row_idx, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS t FROM train_samples),
w AS (SELECT row_idx, list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^\p{L}\p{N}\p{Z}\s\x{85}\x{1C}-\x{1F}]+', '', 'g'), '[\s\p{Z}\x{85}\x{1C}-\x{1F}]+'), lambda x: x <> '') AS w FROM r WHERE t IS NOT NULL),
d AS (SELECT row_idx, w, len(w) AS n FROM w WHERE len(w) >= 30),
u AS (SELECT row_idx, unnest(w) AS x FROM d),
k AS (SELECT row_idx, x, row_number() OVER (PARTITION BY row_idx, x) AS k FROM u),
c AS (SELECT a.row_idx AS row_idx_a, b.row_idx AS row_idx_b, count(*) AS c FROM k a JOIN k b ON a.x = b.x AND a.k = b.k AND a.row_idx < b.row_idx GROUP BY 1, 2)
SELECT row_idx_a, row_idx_b FROM c JOIN d a ON a.row_idx = row_idx_a JOIN d b ON b.row_idx = row_idx_b WHERE 20 * c >= 8 * (a.n + b.n)
""",
}

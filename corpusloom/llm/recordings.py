"""Same or near-same recordings across splits: an edit-distance segment join over recording names.

``edit_segment_join`` finds all pairs of an evaluation string and a training string within ``k`` edits. Evaluation
strings are cut into k + ``SPARE`` parts; k edits touch k of them at most, so that ``SPARE`` parts occur unchanged at
allowed positions: the shift of a part is what the edits before it leave, that of the rest what the lengths ask for. A
key holds ``SPARE`` unchanged parts (one part, as with k + 1 segments, would be a hot key where names share prefixes).
Training strings emit the substrings at the allowed positions, for each length they can match. Candidates are verified
by the banded edit distance of the engine (``levenshtein`` with a threshold).

``recording_names`` gives each path its source, its name (the part of the path that the source's pattern matches,
without padding of numbers and letter case; names may still differ by edits, such as a prefixed letter) and its
identity, the characters that name the recording by the rules of the sources. The distance of two names is that of their
spellings, in which an edit of a character of the identity costs more than k: numbers one digit apart are different
recordings. Whatever else a path holds, before or after that part, is in no name; only letters and digits that go on
an id of fixed length belong to it, as they make it another id.

Edge cases: null and blank paths name nothing; a path of no source is its own recording (as the file system resolves
it); strings of one character work as any other (empty parts match at any string of allowed length).
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import is_blank
from corpusloom.session import lookup_join, salted_join, table, written

#: Edits, and parts of a name that make a key.
K, SPARE = 1, 3
#: Evaluation strings from which the places to cut are chosen.
CUT_SAMPLE = 20000

# What names a recording, by source. Pattern over "folder/stem" in lower case, groups in order.
IDENTITY = {
    "talehall": r"(\d+)-(\d+)-(\d+)",
    "moodbox": r"mb(\d+)_([fm])(\d+)",
    "pairmix": r"(\d+-\d+)_(\d+-\d+)",
    "chartsong": r"/(tr[a-z0-9]{11})",
    "gigavoice": r"gvc(\d+)_s(\d+)",
    "capnook": r"/y?([a-z0-9]{11})_(\d+)",
    "tunecards": r"/y?([a-z0-9]{11})",
    "facevoice": r"([^/]+)/(\d+)",
    "fieldclips": r"(\d+)$",
    "opentongue": r"ot_([a-z]+)_(\d+)",
    "wavtrove": r"([^/]+)/(\d+)",
}
#: Sources whose names end in an id of fixed length.
FIXED_IDS = ("chartsong", "tunecards")
#: The number that ends a title: the last one that stands alone, so that additions such as "_part9" don't count.
TITLE_NUMBER = r".*(?<![^\W_])(\d+)(?![^\W_])"
# Endings of a stem that mark a copy or a conversion.
COPY_MARKS = r"((?<=\d)x|~| \(\d+\)|-copy|_16k|_norm|\.(wav|mp3|flac|m4a|ogg|opus))+$"


def source_order(spark: SparkSession, d: str) -> list[str]:
    """Source names by rank. The table is a parameter of fixed size; more than 1,000 rows are refused."""
    rows = table(spark, d, "mix_targets").where("source is not null").orderBy("match_rank", "source").select("source").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("mix_targets is a parameter table of at most 1,000 rows")
    return [r[0] for r in rows]


def source_of(path: Column, sources: list[str]) -> Column:
    """First source, in the given order, that occurs in the path in any letter case; else null."""
    low, found = F.lower(path), F.lit(None).cast("string")
    for s in reversed(sources):
        found = F.when(low.contains(s.lower()), F.lit(s)).otherwise(found)
    return found


def _resolve(path: str) -> str:
    parts: list[str] = []
    for x in path.split("/"):
        if x == ".." and parts and parts[-1] != "..":
            parts.pop()
        elif x not in ("", ".") and not (x == ".." and path.startswith("/")):
            parts.append(x)
    return ("/" if path.startswith("/") else "") + "/".join(parts)


class Namer:
    """Source, name and identity of a path."""

    def __init__(self, sources: list[str]):
        self.sources = [(s, s.lower()) for s in sources]
        self.patterns = {s: re.compile(p) for s, p in IDENTITY.items()}
        self.numeric = {s: [set(g) <= set("\\d+-") for g in re.findall(r"\(([^()]*)\)", p)] for s, p in IDENTITY.items()}
        self.marks, self.extensions = re.compile(COPY_MARKS), re.compile(r"(\.[a-z][a-z0-9]{1,4}){1,2}$")
        self.padding, self.title_number, self.more = re.compile(r"(?<!\d)0+(?=\d)"), re.compile(TITLE_NUMBER), re.compile(r"[a-z0-9]*")

    def __call__(self, path: str) -> tuple[str | None, str, str]:
        low = path.lower()
        source = next((s for s, l in self.sources if l in low), None)
        pattern = self.patterns.get(source or "")
        if pattern is None:
            whole = _resolve(path)
            return source, whole, ":" + whole
        folder, _, base = ("/" + _resolve(low.replace("%20", " "))).rpartition("/")
        stem = self.marks.sub("", self.extensions.sub("", base))
        tail = folder.rpartition("/")[2] + "/" + stem
        m = source == "fieldclips" and self.title_number.match(stem) or pattern.search(tail)
        if not m:
            return source, self.padding.sub("", tail), ":" + _resolve(path)
        groups = [self.padding.sub("", g) if number else g for g, number in zip(m.groups(), self.numeric[source])]
        if source == "fieldclips":
            return source, groups[0], "|".join([source, *groups])
        shown, at = "", m.start()
        for k, g in enumerate(groups):
            shown += tail[at : m.start(k + 1)] + g
            at = m.end(k + 1)
        shown = (shown + tail[at : m.end()]).lstrip("/")
        if source in FIXED_IDS:
            shown += self.more.match(tail, m.end()).group()
        return source, shown, "|".join([source, *groups])


_NAMES = pa.schema([("side", pa.int32()), ("path", pa.string()), ("source", pa.string()), ("name", pa.string()), ("identity", pa.string())])


def recording_names(paths: DataFrame, sources: list[str]) -> DataFrame:
    """(side, path) to (side, path, source, name, identity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = Namer(sources)
        for b in batches:
            found = list(map(namer, b.column(1).to_pylist())) or [(None, None, None)][:0]
            cols = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.string()) for c in cols)], schema=_NAMES)

    return paths.select(F.col("side").cast("int").alias("side"), "path").mapInArrow(run, "side int, path string, source string, name string, identity string")


def segment_cuts(sample: list[tuple[str, str]], parts: int) -> dict[tuple[str, int], tuple[int, ...]]:
    """Where strings of a group and length are cut into parts of equal information.

    ``sample`` holds (group, string). Positions at which all strings agree carry none, so that a shared prefix doesn't
    fill whole segments. Any cuts give all pairs; good ones give few candidates.
    """
    columns: dict[tuple[str, int], list[Counter]] = {}
    for g, s in sample:
        for c, ch in zip(columns.setdefault((g, len(s)), [Counter() for _ in s]), s):
            c[ch] += 1
    cuts = {}
    for k, cols in columns.items():
        bits = [sum(n * math.log2(sum(c.values()) / n) for n in c.values()) / sum(c.values()) for c in cols]
        total, acc, at = sum(bits), 0.0, []
        for i, x in enumerate(bits):
            while len(at) < parts - 1 and acc + x / 2 >= total * (len(at) + 1) / parts:
                at.append(i)
            acc += x
        cuts[k] = (*at, *[len(cols)] * (parts - 1 - len(at)))
    return cuts


def shifts(k: int, spare: int, delta: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(unchanged parts, their shifts) that k edits can leave in a string that is ``delta`` longer.

    The edits lie in the other k parts; the shift changes only across these, by at most k in all, from 0 to delta. (An
    insertion between two parts counts as one in the later of them, or in the last.)
    """
    out = []
    for kept in itertools.combinations(range(k + spare), spare):
        gaps = [b - a - 1 for a, b in zip((-1, *kept), (*kept, k + spare))]
        for moved in itertools.product(*[range(-k, k + 1) if g else (0,) for g in gaps[:-1]]):
            at = tuple(itertools.accumulate(moved))
            if sum(map(abs, moved)) + abs(delta - at[-1]) <= k and (gaps[-1] or at[-1] == delta):
                out.append((kept, at))
    return out


def _keys(g: str, s: str, m: int, cuts: dict, k: int, moves: list | None = None) -> set[int]:
    """The keys that string s has in common with a string of m characters within k edits."""
    parts = k + SPARE
    b = (0, *(cuts.get((g, m)) or [m * i // parts for i in range(1, parts)]), m)
    n, out = len(s), set()
    for kept, at in moves if moves is not None else shifts(k, SPARE, n - m):
        if all(0 <= b[p] + d and b[p + 1] + d <= n for p, d in zip(kept, at)):
            held = "\0".join(s[b[p] + d : b[p + 1] + d] for p, d in zip(kept, at))
            out.add(xxhash.xxh64_intdigest(f"{g}\0{kept}\0{m}\0{held}") - (1 << 63))
    return out


_KEYED = pa.schema([("g", pa.string()), ("s", pa.string()), ("k", pa.int64())])


def edit_segment_join(evals: DataFrame, train: DataFrame, k: int = K) -> DataFrame:
    """All pairs (``g``, ``a``, ``b``, ``distance``) of strings of one group at most ``k`` edits apart.

    ``evals`` and ``train`` hold distinct (``g``, ``s``); further columns are ignored. Null strings match nothing; a
    null group is a group. Each pair comes once.
    """
    clean = [x.where("s is not null").select(F.coalesce("g", F.lit("")).alias("g"), "s") for x in (evals, train)]
    step = max(1, clean[0].count() // CUT_SAMPLE)
    sample = clean[0].where(F.pmod(F.xxhash64("g", "s"), F.lit(step)) == 0).limit(2 * CUT_SAMPLE).collect()
    cuts = segment_cuts([(r[0], r[1]) for r in sample], k + SPARE)

    def emitter(reach: int):
        moves = {d: shifts(k, SPARE, d) for d in range(-reach, reach + 1)} if reach else {0: [(x, (0,) * SPARE) for x in itertools.combinations(range(k + SPARE), SPARE)]}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gs, ss, ks = [], [], []
                for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for m in range(max(0, len(s) - reach), len(s) + reach + 1):
                        for key in _keys(g, s, m, cuts, k, moves[len(s) - m]):
                            gs.append(g)
                            ss.append(s)
                            ks.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(gs, pa.string()), pa.array(ss, pa.string()), pa.array(ks, pa.int64())], schema=_KEYED)

        return run

    left = clean[0].mapInArrow(emitter(0), "g string, s string, k long").select("g", F.col("s").alias("a"), "k")
    right = clean[1].mapInArrow(emitter(k), "g string, s string, k long").select("g", F.col("s").alias("b"), "k")
    near = left.join(right, ["k", "g"]).select("g", "a", "b", F.levenshtein("a", "b", k).alias("distance"))
    return near.where("distance >= 0").distinct()


def mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(item_id, split, path) of the test items and (row_idx, path) of the training samples, blank paths left out."""
    items = table(spark, d, "test_items").select("item_id", "split", "path").where(~is_blank(F.col("path")))
    rows = table(spark, d, "train_samples").select("row_idx", F.explode("audios").alias("path")).where(~is_blank(F.col("path"))).distinct()
    return items, rows


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs (test path, train path, identity) that name one recording: names at most ``K`` edits apart, none of them in the identity."""
    sources = source_order(spark, d)
    items, rows = mentions(spark, d)
    paths = items.select(F.lit(0).alias("side"), "path").union(rows.select(F.lit(1), "path")).distinct()
    named = written(recording_names(paths, sources), "p1-names")
    left, right = named.where("side = 0"), named.where("side = 1")
    strings = [x.select(F.col("source").alias("g"), F.col("name").alias("s")).distinct() for x in (left, right)]
    near = edit_segment_join(*strings).withColumn("source", F.nullif("g", F.lit("")))
    by = F.coalesce("source", F.lit(""))
    l = left.select(by.alias("g"), F.col("path").alias("item_path"), F.col("name").alias("a"), "identity")
    r = right.select(by.alias("g"), F.col("path").alias("train_path"), F.col("name").alias("b"), F.col("identity").alias("train_identity"))
    pairs = near.join(l, ["g", "a"]).join(r, ["g", "b"])
    return pairs.where("identity = train_identity").select("item_path", "train_path", "identity", "source", "distance")


def found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a test item and a training sample that name the same recording.

    Matched paths meet again on the identity of the recording; a recording that a third of the samples name is salted.
    """
    items, rows = mentions(spark, d)
    pairs = written(_matches(spark, d), "p1-matches")
    named_items = items.join(pairs.select(F.col("item_path").alias("path"), "identity", "source").distinct(), "path").select("item_id", "split", "identity", "source").distinct()
    named_rows = lookup_join(rows, pairs.select(F.col("train_path").alias("path"), "identity").distinct(), "path", "inner").select("row_idx", "identity").distinct()
    return salted_join(named_rows, named_items, "identity", "row_idx").select("item_id", "row_idx", "split", "source").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("item_id", "row_idx").distinct()


def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per split and source: pairs, test items and training samples concerned."""
    agg = found(spark, d).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("row_idx").alias("n_samples"))
    return agg.select("split", "source", "n_pairs", "n_items", "n_samples")


QUERIES = {"p1_found": p1_found, "p1_overlaps": p1_overlaps}

#: The rules of the sources once more, by themselves: base is the file's name up to its first dot, folder what holds it.
_SQL = r"""
WITH refs AS (
  SELECT 'e' AS side, item_id AS id, split, path FROM test_items UNION ALL
  SELECT DISTINCT 't', row_idx, NULL, path FROM (SELECT row_idx, unnest(audios) AS path FROM train_samples)),
paths AS (SELECT DISTINCT path FROM refs WHERE trim(coalesce(path, '')) <> ''),
sourced AS (SELECT path, (SELECT arg_min(m.source, m.match_rank) FROM mix_targets m WHERE contains(lower(p.path), lower(m.source))) AS source,
  list_filter(string_split(lower(path), '/'), lambda x: x NOT IN ('', '.')) AS steps FROM paths p),
bases AS (SELECT path, source, steps[-2] AS folder, split_part(steps[-1], '.', 1) AS base FROM sourced),
pieces AS (SELECT path, source, folder, base, list_transform(regexp_extract_all(base, '[0-9]+'), lambda x: ltrim(x, '0') || CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE '' END) AS n,
  regexp_replace(regexp_extract(base, '^[a-z0-9]+'), '^(.*[0-9])x$', CASE WHEN length(regexp_extract(base, '^[a-z0-9]+')) IN (12, 14) THEN '\1' ELSE '\0' END) AS lead FROM bases),
named AS (SELECT path, source || ' ' || CASE source
  WHEN 'talehall' THEN concat_ws(' ', n[1], n[2], n[3])
  WHEN 'moodbox' THEN concat_ws(' ', n[1], regexp_extract(base, '_([fm])[0-9]', 1), n[2])
  WHEN 'pairmix' THEN concat_ws(' ', n[1], n[2], n[3], n[4])
  WHEN 'gigavoice' THEN concat_ws(' ', n[1], n[2])
  WHEN 'chartsong' THEN lead
  WHEN 'tunecards' THEN right(lead, 11)
  WHEN 'capnook' THEN concat_ws(' ', right(split_part(base, '_', 1), 11), ltrim(regexp_extract(base, '^[^_]*_([0-9]+)', 1), '0'))
  WHEN 'facevoice' THEN concat_ws(' ', folder, n[1])
  WHEN 'wavtrove' THEN concat_ws(' ', folder, n[1])
  WHEN 'opentongue' THEN concat_ws(' ', regexp_extract(base, 'ot_([a-z]+)_', 1), n[1])
  WHEN 'fieldclips' THEN regexp_extract(regexp_replace(base, '%[0-9a-f]{2}', ' ', 'g'), '^[^0-9]*0*([0-9]+)', 1) END AS identity, source FROM pieces
  UNION ALL SELECT path, ':' || regexp_replace(regexp_replace(path, '/(\./)+', '/', 'g'), '/+', '/', 'g'), NULL FROM pieces WHERE source IS NULL),
hit AS (SELECT DISTINCT e.id AS item_id, t.id AS row_idx, e.split, ne.source FROM refs e JOIN named ne ON e.path = ne.path
  JOIN named nt ON ne.identity = nt.identity JOIN refs t ON t.path = nt.path WHERE e.side = 'e' AND t.side = 't')
"""
ORACLE = {
    "p1_found": _SQL + "SELECT DISTINCT item_id, row_idx FROM hit",
    "p1_overlaps": _SQL + "SELECT split, source, count(*) AS n_pairs, count(DISTINCT item_id) AS n_items, count(DISTINCT row_idx) AS n_samples FROM hit GROUP BY ALL",
}

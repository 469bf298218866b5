"""Reading level of each document by gradient-boosted regression trees.

1. A lexicon of levels is learned from the labelled documents: log-likelihoods of words by level, refined by giving
   each sentence of a labelled document the level its words vote for (within reach of the label) and counting again.
2. Every document becomes a row of features: distributions of sentence and word length, vocabulary (shares of words by
   level of their sentence, type-token ratio, rare words), syntax (function words, commas, subordination) and cohesion
   (words shared by neighbouring sentences).
3. One ensemble of regression trees per level predicts whether a document is of that level, boosting from the share
   of words at that level; folds of sources give
   out-of-fold predictions, on which the scores are calibrated (isotonic by pooling); the best calibrated level wins.

Training reads at most about ``LABELLED`` labelled documents, twice as many never (a documented bound, drawn by a hash
of the id); the statistics
of the lexicon come from these, the levels are given to every document.

Edge cases: null texts, texts of fewer than ``LEAST_PIECES`` pieces and texts in other languages get no level in
``p9_found`` (``p9_levels`` lists them with a null level); without any label there is no model and no row has a level;
repeated labels of one rater count once; a document on which raters disagree has the mean as its target.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.language import LATIN, SAMPLE_PER_LANGUAGE, LanguageModel, normal_label
from corpusloom.session import table

LABELLED = 2000
LEAST_PIECES = 40
LEVELS = (1, 2, 3, 4)
TREES, DEPTH, RATE, FOLDS, LEAF = 40, 3, 0.1, 3, 25
#: Words of a unit where a text has no sentences.
UNIT = 7
_CLEAN = re.compile(r"<[^<>]{0,200}>|\[\d{1,2}:\d\d(?::\d\d)?\]|^[ \t]*[A-Z][A-Za-z0-9]{0,12}:[ \t]|&[a-z]{2,6};", re.M)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?\n]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
# English words of subordination and connection.
CONNECTIVES = frozenset("although because while whenever which that whose when if unless until though albeit insofar notwithstanding whereas neither nor however therefore by".split())


def units(text: str) -> tuple[list[str], list[int], int]:
    """Words in lower case, the number of words of each unit, and the number of commas. Units are sentences, or
    ``UNIT`` words where there is hardly any punctuation."""
    clean = _CLEAN.sub(" ", text)
    words: list[str] = []
    sizes: list[int] = []
    for sentence in _END.split(clean.lower()):
        found = _WORD.findall(sentence)
        if found:
            words += found
            sizes.append(len(found))
    n = len(words)
    if n > 25 * max(1, len(sizes)):
        sizes = [UNIT] * (n // UNIT) + ([n % UNIT] if n % UNIT else [])
    return words, sizes, clean.count(",")


class Lexicon:
    """Log-likelihoods of words by level."""

    def __init__(self, index: dict[str, int], weights: np.ndarray):
        self.index, self.weights = index, weights

    @classmethod
    def fit(cls, docs: list[tuple[tuple, float]], rounds: int = 3) -> Lexicon:
        """``docs``: (parsed text, mean level)."""
        parsed = [(p[0], p[1], y) for p, y in docs]
        counts = Counter(w for ws, _, _ in parsed for w in set(ws))
        index = {w: i + 1 for i, w in enumerate(sorted(w for w, c in counts.items() if c >= 3))}
        out = cls(index, np.zeros((len(index) + 1, 4)))
        flat, at, levels = [], [], []
        n = 0
        for ws, sizes, y in parsed:
            flat.append(out.ids(ws))
            for k in sizes:
                at.append(n)
                n += k
            levels += [y] * len(sizes)
        if not at:
            return out
        ids, at_, apart = np.concatenate(flat), np.array(at), np.abs(np.array(levels)[:, None] - np.array(LEVELS)[None, :])
        piece = np.repeat(np.arange(len(at_)), np.diff(np.append(at_, n)))
        soft = np.exp(-2.0 * apart)
        soft /= soft.sum(1, keepdims=True)
        for _ in range(rounds):
            c = np.stack([np.bincount(ids, soft[piece, j], len(index) + 1) for j in range(4)], 1) + 0.02
            share = c / c.sum(0, keepdims=True)
            w = np.log(share) - np.log(share).mean(1, keepdims=True)
            out.weights = np.where((c.sum(1) >= 2)[:, None], np.clip(w, -3, 3), 0.0)
            out.weights[0] = 0
            s = np.add.reduceat(out.weights[ids], at_, axis=0) - 0.7 * apart
            soft = np.exp(s - s.max(1, keepdims=True))
            soft /= soft.sum(1, keepdims=True)
        return out

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        return np.array([get(w, 0) for w in words], np.int64)


class Vocabulary:
    """One index of words for the lexicon and, where given, the language model."""

    def __init__(self, lex: Lexicon, lm: LanguageModel | None = None):
        own = list(lex.index) + [w for w in (lm.weights if lm else ()) if w not in lex.index]
        self.index = {w: i + 1 for i, w in enumerate(own)}
        n = len(own) + 1
        self.level, self.lang = np.zeros((n, 4), np.float32), np.zeros((n, 4), np.float32)
        self.known, self.connects = np.zeros(n, bool), np.zeros(n, bool)
        for w, i in self.index.items():
            self.connects[i] = w in CONNECTIVES
            if w in lex.index:
                self.level[i], self.known[i] = lex.weights[lex.index[w]], True
            if lm and w in lm.weights:
                self.lang[i] = lm.weights[w]

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        return np.array([get(w, 0) for w in words], np.int64)


def features(voc: Vocabulary, parsed: list[tuple[list[str], list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features (documents, N_FEATURES) and language scores (documents, 4) of parsed texts, computed together."""
    n = len(parsed)
    count = np.array([len(p[0]) for p in parsed])
    full = np.flatnonzero(count)
    out, lang = np.zeros((n, N_FEATURES), np.float32), np.zeros((n, 4))
    if not len(full):
        return out, lang
    flat = [w for p in parsed for w in p[0]]
    ids = voc.ids(flat)
    lens = np.fromiter(map(len, flat), np.float64, len(flat))
    size = np.array([k for p in parsed for k in p[1]])
    unit_doc = np.repeat(np.arange(n), [len(p[1]) for p in parsed])
    doc = np.repeat(np.arange(n), count)
    unit = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    m = count[full].astype(float)

    def per_doc(x: np.ndarray, by: np.ndarray = doc) -> np.ndarray:
        return np.bincount(by, x, n)[full]

    def quantile(x: np.ndarray, by: np.ndarray, total: np.ndarray, q: float) -> np.ndarray:
        order = np.lexsort((x, by))
        start = np.cumsum(total) - total
        return x[order][(start + np.floor(q * np.maximum(total - 1, 0)).astype(int))[full]]

    scores = np.add.reduceat(voc.level[ids], first, axis=0).astype(float)
    level = scores.argmax(1)
    share = np.stack([per_doc(size * (level == k), unit_doc) for k in range(4)], 1) / m[:, None]
    soft = np.exp(scores - scores.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    soft = np.stack([per_doc(size * soft[:, k], unit_doc) for k in range(4)], 1) / m[:, None]
    mean = np.stack([per_doc(voc.level[ids, k]) for k in range(4)], 1) / m[:, None]
    order = np.argsort(-share, 1, kind="stable")
    top = np.take_along_axis(share, order, 1)
    n_units = np.bincount(unit_doc, minlength=n)
    u = n_units[full].astype(float)
    len_mean, size_mean = per_doc(lens) / m, per_doc(size.astype(float), unit_doc) / u
    types = np.bincount(np.unique(doc * np.int64(1 << 32) + ids) >> 32, minlength=n)[full]
    keys = np.unique(unit * np.int64(1 << 32) + ids)
    again = np.isin(keys - (1 << 32), keys, assume_unique=True) & (unit_doc[keys >> 32] == unit_doc[np.maximum((keys >> 32) - 1, 0)])
    cohesion = np.bincount(unit_doc[keys >> 32], again, n)[full] / np.maximum(np.bincount(unit_doc[keys >> 32], minlength=n)[full], 1)
    cols = [
        *share.T, *soft.T, *mean.T, top[:, 0], order[:, 0], order[:, 1], top[:, 0] - top[:, 1],
        len_mean, np.sqrt(np.maximum(per_doc(lens**2) / m - len_mean**2, 0)), per_doc(lens >= 9) / m, per_doc(lens <= 3) / m, quantile(lens, doc, count, 0.75), quantile(lens, doc, count, 0.95),
        size_mean, np.sqrt(np.maximum(per_doc(size.astype(float) ** 2, unit_doc) / u - size_mean**2, 0)), *(quantile(size, unit_doc, n_units, x) for x in (0.25, 0.5, 0.9)),
        types / m, per_doc(~voc.known[ids]) / m, per_doc(voc.connects[ids]) / m, np.array([p[2] for p in parsed])[full] / m, cohesion, np.log(m),
    ]
    out[full] = np.stack(cols, 1)
    lang[full] = np.stack([per_doc(voc.lang[ids, k]) for k in range(4)], 1)
    return out, lang


N_FEATURES = 33


class Trees:
    """Gradient-boosted regression trees on binned features, for squared error."""

    def __init__(self, edges: list[np.ndarray], base: int, trees: list):
        self.edges, self.base, self.trees = edges, base, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, base: int) -> Trees:
        """Boosts from feature ``base``."""
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        out = cls(edges, base, [])
        b, pred = out.bins(x), x[:, base].astype(float)
        for _ in range(TREES):
            tree = cls._grow(b, y - pred, weight, np.arange(len(y)), DEPTH)
            out.trees.append(tree)
            pred += cls._apply(tree, b)
        return out

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T)], 1).astype(np.int16)

    @classmethod
    def _grow(cls, b: np.ndarray, r: np.ndarray, w: np.ndarray, rows: np.ndarray, depth: int):
        g, n = (r[rows] * w[rows]).sum(), w[rows].sum()
        leaf = RATE * g / (n + 5.0)
        if depth == 0 or len(rows) < 2 * LEAF:
            return leaf
        best, choice = 1e-6, None
        for f in range(b.shape[1]):
            v = b[rows, f]
            gs, ns = np.cumsum(np.bincount(v, r[rows] * w[rows], 33)), np.cumsum(np.bincount(v, w[rows], 33))
            gain = gs**2 / (ns + 1) + (g - gs) ** 2 / (n - ns + 1) - g * g / (n + 1)
            gain[(ns < LEAF) | (n - ns < LEAF)] = 0
            k = int(gain[:-1].argmax())
            if gain[k] > best and 0 < ns[k] < n:
                best, choice = gain[k], (f, k)
        if choice is None:
            return leaf
        left = b[rows, choice[0]] <= choice[1]
        if left.all() or not left.any():
            return leaf
        return (*choice, cls._grow(b, r, w, rows[left], depth - 1), cls._grow(b, r, w, rows[~left], depth - 1))

    @classmethod
    def _apply(cls, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, k, l, r = tree
        return np.where(b[:, f] <= k, cls._apply(l, b), cls._apply(r, b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return x[:, self.base] + sum((self._apply(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints and values of the best rising step function of the score, by pooling adjacent violators."""
    o = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, k in zip(score[o], y[o], w[o]):
        blocks.append([s, v * k, k])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, a, c = blocks.pop()
            blocks[-1][1] += a
            blocks[-1][2] += c
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Grader:
    def __init__(self, lex: Lexicon, models: list[Trees], steps: list[tuple[np.ndarray, np.ndarray]], accuracy: dict[str, float], report: list[tuple[str, int, float, float]] | None = None):
        self.lex, self.models, self.steps, self.accuracy = lex, models, steps, accuracy
        self.report = report or []

    @classmethod
    def fit(cls, docs: list[tuple[str, str, dict[int, float]]]) -> Grader:
        """``docs``: (source, text, level shares of the raters)."""
        target = np.array([[d[2].get(l, 0.0) for l in LEVELS] for d in docs])
        mean = target @ np.array(LEVELS)
        parsed = [units(d[1]) for d in docs]
        sources = sorted({d[0] for d in docs})
        fold = np.array([sources.index(d[0]) % FOLDS for d in docs]) if len(sources) >= FOLDS else np.arange(len(docs)) % FOLDS
        oof, lexical = np.zeros((len(docs), 4)), np.zeros((len(docs), 4))
        w = np.array([1.0 if max(d[2].values()) > 0.99 else 0.5 for d in docs])
        for k in sorted(set(fold.tolist())):
            tr, te = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if not len(tr):
                tr = te
            voc = Vocabulary(Lexicon.fit([(parsed[i], mean[i]) for i in tr]))
            xt, xe = (features(voc, [parsed[i] for i in rows])[0] for rows in (tr, te))
            lexical[te] = xe[:, :4]
            for j in range(4):
                oof[te, j] = Trees.fit(xt, target[tr, j], w[tr], j).predict(xe)
        steps = [isotonic(oof[:, j], target[:, j], w) for j in range(4)]
        lex = Lexicon.fit(list(zip(parsed, mean)))
        x = features(Vocabulary(lex), parsed)[0]
        out = cls(lex, [Trees.fit(x, target[:, j], w, j) for j in range(4)], steps, {})
        hit, plain = (d == target.argmax(1) + 1 for d in (out.decide(oof), lexical.argmax(1) + 1))
        for s in sources:
            mine = np.array([d[0] == s for d in docs])
            out.accuracy[s] = float(hit[mine].mean())
            out.report.append((s, int(mine.sum()), out.accuracy[s], float(plain[mine].mean())))
        return out

    def decide(self, raw: np.ndarray) -> np.ndarray:
        p = np.stack([np.interp(raw[:, j], *self.steps[j]) for j in range(4)], 1)
        return (p + 0.02 * raw).argmax(1) + 1

    def grade(self, x: np.ndarray) -> np.ndarray:
        """Levels by features; many rows at once."""
        return self.decide(np.stack([m.predict(x) for m in self.models], 1)) if len(x) else np.zeros(0, int)


def _foreign(text: str, n_words: int) -> bool:
    """Whether Chinese or Japanese characters outnumber the words."""
    return not text.isascii() and len(_CJK.findall(text)) > n_words


class Reader:
    """Levels of texts: whole batches at once."""

    def __init__(self, lm: LanguageModel, grader: Grader):
        self.grader, self.voc = grader, Vocabulary(grader.lex, lm)

    def levels(self, texts: list[str | None]) -> list[int | None]:
        out: list[int | None] = [None] * len(texts)
        for lo in range(0, len(texts), 512):
            at = [i for i in range(lo, min(lo + 512, len(texts))) if texts[i] and len(texts[i].split()) >= LEAST_PIECES]
            parsed = [units(texts[i]) for i in at]
            x, lang = features(self.voc, parsed)
            english = (lang.argmax(1) == 0) & (np.ptp(lang, 1) > 0)
            rows = [k for k, i in enumerate(at) if english[k] and not _foreign(texts[i], len(parsed[k][0]))]
            for k, g in zip(rows, self.grader.grade(x[rows]).tolist()):
                out[at[k]] = g
        return out


def english(model: LanguageModel, text: str) -> bool:
    """Whether the larger part of a text is English."""
    words = units(text)[0]
    s = model.score(words)
    return bool(words) and not _foreign(text, len(words)) and max(s) == s[0] and len(set(s)) > 1


def fit(spark: SparkSession, d: str) -> tuple[LanguageModel, Grader | None]:
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "lang")
    sample = _language_sample(docs)
    labels = table(spark, d, "level_labels").where("reading_level between 1 and 4").groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("reading_level"))
    labels = labels.withColumn("reading_level", F.round("reading_level").cast("int")).groupBy("doc_id").agg(F.collect_list("reading_level").alias("levels"))
    step = max(1, labels.count() // LABELLED)
    chosen = docs.where(F.col("text").isNotNull()).join(labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(step)) == 0), "doc_id")
    rows = chosen.select("source", "text", "levels").limit(2 * LABELLED).collect()
    lm = LanguageModel.fit(sample)
    data = [(r["source"] or "", r["text"], {l: c / len(r["levels"]) for l, c in Counter(r["levels"]).items()}) for r in rows if english(lm, r["text"])]
    return lm, (Grader.fit(data) if data else None)


def _language_sample(docs: DataFrame) -> list[tuple[str, str]]:
    label = normal_label(F.col("lang"))
    counts = {r[0]: max(1, r[1] // (SAMPLE_PER_LANGUAGE // 2)) for r in docs.groupBy(label.alias("l")).count().collect() if r[0] in LATIN}
    if not counts:
        return []
    step = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[label]
    chosen = docs.where(step.isNotNull() & F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(13)), step) == 0))
    return [(r[0], r[1]) for r in chosen.select("text", label).limit(2 * SAMPLE_PER_LANGUAGE * len(LATIN)).collect()]


_OUT = pa.schema([("doc_id", pa.int64()), ("reading_level", pa.int32())])


def levels(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, reading_level) of every document; the level is null where there is none to give."""
    model = spark.sparkContext.broadcast(fit(spark, d))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, grader = model.value
        reader = Reader(lm, grader) if grader else None
        for b in batches:
            texts = b.column(1).to_pylist()
            out = reader.levels(texts) if reader else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], schema=_OUT)

    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, reading_level int")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, d).where("reading_level is not null").distinct()


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and level."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return levels(spark, d).join(docs, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, d)


def p9_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated by source: labelled English documents, and the share of them given the level most raters give, by
    the trees and by the largest share of the lexicon alone (each from models that saw no document of the source's fold)."""
    _, grader = fit(spark, d)
    rows = [(s, n, round(a, 6), round(b, 6)) for s, n, a, b in (grader.report if grader else [])]
    return spark.createDataFrame(rows, "source string, n_labelled long, accuracy double, lexicon_accuracy double")


QUERIES = {"p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile, "p9_accuracy": p9_accuracy}
ORACLE: dict[str, str] = {}

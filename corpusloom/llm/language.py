"""Languages of texts and of their segments, by Bayesian evidence fusion.

Likelihoods of a sentence: (1) a naive Bayes model over words for languages in Latin script; for Chinese and Japanese
how often either writes kana or other characters.
Prior of a text: (2) P(language | host), from one grouped aggregation over all rows, smoothed over the hierarchy all
rows, table, host within the table; times the likelihoods (3) P(declared label | language) and (4) P(language part of
the address | language). How far labels and addresses can be trusted is estimated from texts, not given.
Posterior: log prior and log likelihoods are added before a language is chosen. Sentences form a chain, whose language
changes with the probability seen in texts; the most probable chain gives the segments, and a segment's confidence is
the posterior probability of its language. A weak text so follows its label and host, a strong one its words.

Words are counted over all replies and prompts with a declared language, trust in labels and addresses and changes of
the language over all texts, as sums of what each batch of rows holds; wrong labels are weighed down by a vote of frequent
words in each sentence, since a mixed text would give the rarer language the words of the other. What reaches the driver
are the words of which some language has as many as one in ``RARE`` of its texts, and counts whose number is fixed by the
lists of languages. Priors and the labelling cover every row. (``fit_model``, for other operators, is fitted on a bounded
sample: at most about ``SAMPLE_PER_LANGUAGE`` texts for each declared language, drawn by a hash of the id, whole texts.)

Edge cases: null, blank and tag-only texts have no segment; a text without evidence gets the most probable language of
its declared label, address and host with a low confidence; ties go to the first language in ``LANGUAGES``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import is_blank
from corpusloom.llm.recordings import source_of, source_order
from corpusloom.llm.replies import prompt, reply
from corpusloom.session import table

LANGUAGES = ("en", "de", "fr", "es", "zh", "ja")
LATIN = LANGUAGES[:4]
SAMPLE_PER_LANGUAGE = 2000
#: Words rarer than one in so many texts of a language are left out of the likelihoods, being mostly names.
RARE = 2000
#: Rows from which the priors of a table and of a host count as much as those of the level above.
SMOOTH = 20
#: Sentences of fewer words in Latin script don't change the language.
MIN_UNIT_WORDS = 3

#: Probability that a sentence has another language than the one before, where none is estimated.
CHANGE = 0.05

# Codes and English names of languages.
LABELS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "zh": ("zh", "zho", "chi", "chinese", "cmn"),
    "ja": ("ja", "jpn", "japanese"),
}
# Frequent words that vote before anything is learned.
STOPWORDS = {
    "en": "the of and a an to in is that with for as at by from on was it while near when no every but some not yet we you our my who why what".split(),
    "de": "der die das und ein eine einen dem den des im in ist nicht mit von wie man nach dann danach noch nur neben aus für über schon zu".split(),
    "fr": "le la les de des du un une et est que qui dans près pendant puis encore avec pour sur plus se on au aux en jusqu".split(),
    "es": "el la los las de del un una y es que se en con por para luego como más mas junto al después despues lo mientras hasta".split(),
}

TAG = re.compile(r"<[^<>]{0,200}>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々]")
_KANA = re.compile(r"[぀-ヿｦ-ﾟ]")
_CJK_RUN = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々，、。！？「」：；・ー\d\sA-Z]*[぀-ヿ㐀-鿿ｦ-ﾟ々][぀-ヿ㐀-鿿ｦ-ﾟ々，、。！？「」：；・ー]*")
_SENTENCE = re.compile(r"[^.!?。！？…\n]+[.!?。！？…]*[\"'”’»)\]]*|[.!?。！？…]+")


def normal_label(label: Column) -> Column:
    """The language a label declares, by code or English name, with or without region, in any case; else null."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        out = F.when(base.isin(*names), F.lit(lang)).otherwise(out)
    return out


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class LanguageModel:
    """Word log-likelihoods of the Latin-script languages, centred, so that an unknown word says nothing, and the
    log-shares of kana and of other characters in Chinese and Japanese."""

    def __init__(self, weights: dict[str, tuple[float, ...]], kana: dict[str, tuple[int, int]] | None = None):
        self.weights = weights
        # Counts of (kana, all characters); without any, as if one text of a hundred characters each had been seen.
        share = {l: (k + own[0]) / (n + 100) for l, own in (("zh", (0.01,)), ("ja", (55,))) for k, n in [(kana or {}).get(l, (0, 0))]}
        self.kana = {l: (math.log(x), math.log(1 - x)) for l, x in share.items()}

    @classmethod
    def fit(cls, rows: Iterable[tuple[str, str | None]]) -> LanguageModel:
        """``rows``: (text, declared language)."""
        counts, kana = cls.counted(rows)
        return cls.of(counts, {l: sum(c.values()) for l, c in counts.items()}, kana)

    @staticmethod
    def counted(rows: Iterable[tuple[str, str | None]]) -> tuple[dict[str, Counter], dict[str, list[int]]]:
        """Rows with a word by language, and (kana, all characters) of Chinese and Japanese. A row counts for the language
        its words vote for, if they do. The counts of parts of the rows add up to those of all."""
        votes = {w: l for l in LATIN for w in STOPWORDS[l] if sum(w in STOPWORDS[x] for x in LATIN) == 1}
        counts, kana = {l: Counter() for l in LATIN}, {"zh": [0, 0], "ja": [0, 0]}
        for text, label in rows:
            n = len(_CJK.findall(text))
            if n >= 8:
                k = len(_KANA.findall(text))
                own = kana["ja" if 5 * k > n else "zh"]
                own[0] += k
                own[1] += n
            if label in kana:
                continue
            ws = [w for w in words_of(TAG.sub(" ", text)) if not _CJK.search(w)]
            c = Counter(votes[w] for w in ws if w in votes)
            best = c.most_common(2)
            if not best or (len(best) > 1 and best[1][1] * 3 > best[0][1]):
                continue
            if label == best[0][0] or best[0][1] >= 3:
                counts[best[0][0]].update(set(ws))
        return counts, kana

    @classmethod
    def of(cls, counts: dict[str, Counter], size: dict[str, int], kana: dict[str, list[int]]) -> LanguageModel:
        """The model of such counts; ``size``: their sums by language, rare words included."""
        counts, size = {l: Counter(counts[l]) for l in LATIN}, {l: size[l] + 3 * len(STOPWORDS[l]) + 200.0 for l in LATIN}
        for l in LATIN:
            for w in STOPWORDS[l]:
                counts[l][w] += 3
        weights = {}
        for w in set().union(*counts.values()):
            if sum(counts[l][w] for l in LATIN) < 3:
                continue
            logs = [math.log((counts[l][w] + 0.05) / size[l]) for l in LATIN]
            mean = max(logs)
            weights[w] = tuple(max(x - mean, -6.0) for x in logs)
        return cls(weights, {l: tuple(x) for l, x in kana.items()})

    def score(self, ws: list[str]) -> list[float]:
        a = b = c = d = 0.0
        get = self.weights.get
        for w in ws:
            v = get(w)
            if v is not None:
                a += v[0]
                b += v[1]
                c += v[2]
                d += v[3]
        return [a, b, c, d]

    def _split(self, ws: list[str]) -> list[tuple[int, int, list[float]]]:
        """Cuts words without punctuation where the language changes; pieces of at least 4 words."""
        whole = self.score(ws)
        top = max(whole)
        best = whole.index(top)
        if len(ws) < 8 or top > -9.0:  # every word is likely enough in one language
            return [(0, len(ws), whole)]
        n, get, zero = len(ws), self.weights.get, (0.0,) * 4
        left = [[0.0] * 4]
        for w in ws:
            v = get(w, zero)
            left.append([x + y for x, y in zip(left[-1], v)])
        gain, at = 0.0, 0
        for i in range(4, n - 3):
            g = max(left[i]) + max(t - x for t, x in zip(whole, left[i]))
            if g - top > gain:
                gain, at = g - top, i
        if gain < 12.0 or at == 0:
            return [(0, n, whole)]
        del best
        head = self._split(ws[:at])
        tail = self._split(ws[at:])
        return head + [(s + at, e + at, v) for s, e, v in tail]

    def _characters(self, piece: str) -> tuple[float, ...]:
        """Log-likelihoods of a piece of Chinese or Japanese, over ``LANGUAGES``."""
        n, k = len(_CJK.findall(piece)), len(_KANA.findall(piece))
        far = -min(20.0, 4.0 * n)
        zh, ja = (k * self.kana[l][0] + (n - k) * self.kana[l][1] for l in ("zh", "ja"))
        top = max(zh, ja)
        return far, far, far, far, zh - top, ja - top

    def _latin(self, piece: str) -> list[tuple[str, tuple[float, ...], int]]:
        ws = words_of(piece)
        if not ws:
            return []
        cuts = self._split(ws)
        return [(piece if len(cuts) == 1 else " ".join(ws[s:e]), (*(x - max(v) for x in v), *(2 * (-min(20.0, 4.0 * (e - s)),))), e - s) for s, e, v in cuts]

    def evidence(self, text: str) -> list[tuple[str, tuple[float, ...], int]]:
        """(sentence, log-likelihoods over ``LANGUAGES``, the best being 0, words or characters) of a text. A sentence of
        fewer than ``MIN_UNIT_WORDS`` words may be a name and says little."""
        out: list[tuple[str, tuple[float, ...], int]] = []
        for m in _SENTENCE.finditer(TAG.sub(" ", text)):
            piece = m.group()
            n_cjk = len(_CJK.findall(piece))
            if n_cjk:
                ws = words_of(_CJK.sub(" ", piece))
                if len(ws) >= MIN_UNIT_WORDS and n_cjk >= 4:
                    pos = 0
                    for r in _CJK_RUN.finditer(piece):
                        if len(_CJK.findall(r.group())) >= 4:
                            if r.start() > pos:
                                out += self._latin(piece[pos : r.start()])
                            out.append((r.group(), self._characters(r.group()), MIN_UNIT_WORDS))
                            pos = r.end()
                    out += self._latin(piece[pos:])
                    continue
                if n_cjk >= 2 or not ws:
                    out.append((piece, self._characters(piece), max(n_cjk, MIN_UNIT_WORDS)))
                    continue
            out += self._latin(piece)
        return out

    def units(self, text: str) -> list[tuple[str, str | None, float]]:
        """(sentence, its most likely language or None without evidence, margin in nats) of a text."""
        out = []
        for unit, v, n in self.evidence(text):
            best, second = sorted(v, reverse=True)[:2]
            margin = best - second
            out.append((unit, LANGUAGES[v.index(best)] if margin >= 1.5 else None, margin if n >= MIN_UNIT_WORDS else min(margin, 1.0)))
        return out

    def segments(self, text: str, prior: dict[str, float] | None = None, change: float = CHANGE) -> list[tuple[str, float, str]]:
        """(language, confidence, text) of the longest runs of sentences in one language, by the most probable chain of
        languages given ``prior`` and the probability of a change from one sentence to the next."""
        seen = self.evidence(text)
        if not seen:
            return []
        logs = [v if n >= MIN_UNIT_WORDS or len(seen) == 1 else tuple(max(x, -1.0) for x in v) for _, v, n in seen]
        start = [math.log(max((prior or {}).get(l, 1 / 6), 1e-6)) for l in LANGUAGES]
        stay, move = math.log(1 - change), math.log(change / 5)
        score, back = [a + b for a, b in zip(start, logs[0])], []
        for v in logs[1:]:
            top = max(score)
            lead = score.index(top)
            came, now = [], []
            for k, x in enumerate(v):
                same, other = score[k] + stay, top + move
                came.append(k if same >= other or lead == k else lead)
                now.append(x + max(same, other) if lead != k else x + same)
            back.append(came)
            score = now
        chain = [score.index(max(score))]
        for came in reversed(back):
            chain.append(came[chain[-1]])
        chain.reverse()
        out, at = [], 0
        while at < len(chain):
            end = at
            total = list(start)
            while end < len(chain) and chain[end] == chain[at]:
                total = [x + y for x, y in zip(total, logs[end])]
                end += 1
            top = max(total)
            weight = [math.exp(max(x - top, -40.0)) for x in total]
            out.append((LANGUAGES[chain[at]], weight[chain[at]] / sum(weight), " ".join(u.strip() for u, _, _ in seen[at:end])))
            at = end
        return out


def detectable(text: str) -> bool:
    """Enough to tell a language from: 4 words that hold a letter or 8 Chinese or Japanese characters, tags left out."""
    clean = TAG.sub(" ", text)
    if len(_CJK.findall(clean)) >= 8:
        return True
    return sum(1 for w in clean.split() if any(ch.isalpha() for ch in w)) >= 4


def labelled_turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_samples")
    return t.select("row_idx", reply().alias("text"), prompt().alias("prompt"), normal_label(F.col("lang")).alias("label"))


def fit_model(spark: SparkSession, d: str) -> LanguageModel:
    """A model fitted on the bounded sample of labelled replies and their prompts."""
    labels = table(spark, d, "train_samples").select(normal_label(F.col("lang")).alias("label")).groupBy("label").count().where("label is not null")
    per = {r[0]: max(1, r[1] // SAMPLE_PER_LANGUAGE) for r in labels.collect()}  # at most 6 rows
    if not per:
        return LanguageModel.fit([])
    step = F.create_map(*[F.lit(x) for kv in per.items() for x in kv])[F.col("label")]
    chosen = labelled_turns(spark, d).where(step.isNotNull() & (F.pmod(F.xxhash64("row_idx", F.lit(11)), step) == 0))
    rows = chosen.select("text", "prompt", "label").limit(3 * SAMPLE_PER_LANGUAGE * len(LANGUAGES)).collect()
    return LanguageModel.fit([(t, r[2]) for r in rows for t in r[:2] if t])


_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("kana", pa.int64())])


def fit_whole(spark: SparkSession, d: str) -> LanguageModel:
    """A model of all labelled replies and their prompts, from one grouped aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reply, prompt, label = (c.to_pylist() for c in b.columns)
            counts, kana = LanguageModel.counted((x, l) for *both, l in zip(reply, prompt, label) for t in both if t for x in _SENTENCE.findall(TAG.sub(" ", t)))
            rows = [(l, w, n, 0) for l, c in counts.items() for w, n in c.items()]
            rows += [(l, "", sum(c.values()), 0) for l, c in counts.items()] + [(l, "", n, k) for l, (k, n) in kana.items()]  # no word is empty
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTED)], schema=_COUNTED)

    turns = labelled_turns(spark, d).where("label is not null")
    least = {r[0]: max(3, 2 * r[1] / RARE) for r in turns.groupBy("label").count().collect()}
    of = lambda l, c: F.coalesce(F.sum(F.when(F.col("lang") == l, F.col(c))), F.lit(0))
    words = turns.select("text", "prompt", "label").mapInArrow(run, "lang string, word string, n long, kana long").groupBy("word").agg(*[of(l, "n").alias(l) for l in LANGUAGES], *[of(l, "kana").alias(f"kana_{l}") for l in ("zh", "ja")])
    stop = sorted({w for l in LATIN for w in STOPWORDS[l]})
    rows = words.where((F.col("word") == "") | F.col("word").isin(stop) | (sum((F.col(l) / F.lit(float(least.get(l, 3))) for l in LATIN), F.lit(1e-9)) >= 1)).collect()
    total = next((r for r in rows if r["word"] == ""), None)
    if total is None:
        return LanguageModel.fit([])
    counts = {l: Counter({r["word"]: r[l] for r in rows if r["word"] and r[l]}) for l in LATIN}
    return LanguageModel.of(counts, {l: total[l] for l in LATIN}, {l: [total[f"kana_{l}"], total[l]] for l in ("zh", "ja")})


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, text, declared, host, address) of replies and test texts."""
    sources = source_order(spark, d)
    t = table(spark, d, "train_samples")
    first = F.try_element_at(F.filter("audios", lambda p: ~is_blank(p)), F.lit(1))
    a = t.select(F.lit("train_samples").alias("tbl"), F.col("row_idx").alias("rec_id"), reply().alias("text"), normal_label(F.col("lang")).alias("declared"), first.alias("path"))
    i = table(spark, d, "test_items").select("item_id", "text", "task", "path")
    p = table(spark, d, "task_prompts").groupBy("task").agg(F.min("reply_lang").alias("reply_lang"))
    b = i.join(p, "task", "left").select(F.lit("test_items").alias("tbl"), F.col("item_id").alias("rec_id"), "text", normal_label(F.col("reply_lang")).alias("declared"), "path")
    address = normal_label(F.regexp_extract(F.lower("path"), r"/(en|de|fr|es|zh|ja)/", 1))
    return a.unionByName(b).select("tbl", "rec_id", "text", "declared", F.coalesce(source_of(F.col("path"), sources), F.lit("")).alias("host"), address.alias("address"))


class Trust:
    """P(declared label | language) by table and P(language part of the address | language), and how often the language
    changes from one sentence to the next: counts over texts whose words alone are decisive."""

    def __init__(self, label: dict, address: dict, change: float):
        self.label, self.address, self.change = label, address, change

    @classmethod
    def fit(cls, model: LanguageModel, rows: Iterable[tuple[str, str, str | None, str | None]]) -> Trust:
        """``rows``: (tbl, text, declared, address)."""
        return cls.summed(cls.counted(model, rows).items())

    @staticmethod
    def counted(model: LanguageModel, rows: Iterable[tuple[str, str, str | None, str | None]]) -> Counter:
        """Counts of (what, table, language, value), which add up over parts of the rows."""
        n = Counter()
        for tbl, text, declared, part in rows:
            units = [l for _, l, m in model.units(text) if l and m >= 6.0]
            n["change", None, None, None] += sum(a != b for a, b in zip(units, units[1:]))
            n["pair", None, None, None] += max(0, len(units) - 1)
            if units and len(set(units)) == 1:
                n["label", tbl, units[0], declared] += 1
                n["address", None, units[0], part] += 1
        return n

    @classmethod
    def summed(cls, counts: Iterable[tuple[tuple[str, str | None, str | None, str | None], int]]) -> Trust:
        label, address, other = defaultdict(Counter), defaultdict(Counter), Counter()
        for (what, tbl, lang, value), n in counts:
            if what == "label":
                label[tbl, lang][value] += n
            elif what == "address":
                address[lang][value] += n
            else:
                other[what] += n
        return cls(cls._shares(label), cls._shares(address), (other["change"] + 1) / (other["pair"] + 20))

    @staticmethod
    def _shares(counts: dict) -> dict:
        """Smoothed shares of the values, null being one, by condition."""
        values = [None, *LANGUAGES]
        return {k: {v: (c[v] + 0.5) / (sum(c.values()) + 0.5 * len(values)) for v in values} for k, c in counts.items()}

    def of(self, tbl: str, declared: str | None, address: str | None) -> list[float]:
        """Likelihood of a label and an address by language; what no text tells of is the same for all."""
        none: dict = {}
        return [self.label.get((tbl, l), none).get(declared, 1 / 7) * self.address.get(l, none).get(address, 1 / 7) for l in LANGUAGES]


def host_priors(counts: list, trust: Trust) -> dict[tuple[str, str, str | None, str | None], dict[str, float]]:
    """P(language | table, host, address, declared) of every group, from the counts of the groups.

    P(language | table, host) is the mean of what labels and addresses of the host's rows say, smoothed towards the
    table's, which is smoothed towards that of all rows. The number of groups is fixed by the lists of sources and
    languages.
    """

    def mean(rows: list, base: list[float]) -> list[float]:
        total = [SMOOTH * b for b in base]
        for r in rows:
            seen = [x * b for x, b in zip(trust.of(r["tbl"], r["declared"], r["address"]), base)]
            z = sum(seen)
            total = [t + r["count"] * x / z for t, x in zip(total, seen)]
        return [t / sum(total) for t in total]

    tables, hosts = defaultdict(list), defaultdict(list)
    for r in counts:
        tables[r["tbl"]].append(r)
        hosts[r["tbl"], r["host"]].append(r)
    overall = mean(counts, [1 / len(LANGUAGES)] * len(LANGUAGES))
    by_table = {k: mean(rows, overall) for k, rows in tables.items()}
    by_host = {k: mean(rows, by_table[k[0]]) for k, rows in hosts.items()}
    out = {}
    for r in counts:
        p = [x * b for x, b in zip(trust.of(r["tbl"], r["declared"], r["address"]), by_host[r["tbl"], r["host"]])]
        out[r["tbl"], r["host"], r["address"], r["declared"]] = {l: x / sum(p) for l, x in zip(LANGUAGES, p)}
    return out


_TRUST = pa.schema([("what", pa.string()), ("tbl", pa.string()), ("lang", pa.string()), ("value", pa.string()), ("n", pa.int64())])


def fit_trust(df: DataFrame, model: LanguageModel) -> Trust:
    """Trust counted over all texts, in one grouped aggregation whose groups are fixed by the list of languages."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*k, n) for k, n in Trust.counted(shared.value, zip(*(c.to_pylist() for c in b.columns))).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_TRUST)], schema=_TRUST)

    parts = df.where(F.col("text").isNotNull()).select("tbl", "text", "declared", "address").mapInArrow(run, "what string, tbl string, lang string, value string, n long")
    return Trust.summed((tuple(r)[:4], r["n"]) for r in parts.groupBy("what", "tbl", "lang", "value").agg(F.sum("n").alias("n")).collect())


def fit_priors(df: DataFrame, model: LanguageModel) -> tuple[dict, float]:
    """Priors by group and the probability of a change, from grouped aggregations over all rows."""
    counts = df.groupBy("tbl", "host", "address", "declared").count().collect()
    trust = fit_trust(df, model)
    return host_priors(counts, trust), trust.change


_OUT = pa.schema([("tbl", pa.string()), ("rec_id", pa.int64()), ("seg_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_segments", pa.int64()), ("declared", pa.string()), ("detectable", pa.bool_()), ("n_chars", pa.int64())])
_DDL = "tbl string, rec_id long, seg_no long, lang string, confidence double, n_segments long, declared string, detectable boolean, n_chars long"


def label(spark: SparkSession, d: str) -> DataFrame:
    """One row per segment of each text that has letters."""
    df = texts(spark, d)
    fitted = fit_whole(spark, d)
    model = spark.sparkContext.broadcast((fitted, *fit_priors(df, fitted)))  # all of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, priors, change = model.value
        for b in batches:
            cols: list[list] = [[] for _ in _OUT]
            for tbl, rec, text, declared, host, address in zip(*(c.to_pylist() for c in b.columns)):
                segs = m.segments(text, priors.get((tbl, host, address, declared)), change) if text else []
                ok = bool(segs) and detectable(text)
                for k, (lang, conf, part) in enumerate(segs):
                    for c, v in zip(cols, (tbl, rec, k + 1, lang, round(conf, 4), len(segs), declared, ok, len(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    return df.where(F.col("text").isNotNull()).mapInArrow(run, _DDL)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose declared language is missing or wrong, and all segments of mixed texts."""
    seg = label(spark, d)
    wrong = (F.col("n_segments") == 1) & F.col("detectable") & (F.col("declared").isNull() | (F.col("declared") != F.col("lang")))
    return seg.where((F.col("n_segments") > 1) | wrong).select("tbl", "rec_id", "seg_no", "lang").distinct()


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every text and segment with its language and confidence."""
    return label(spark, d).select("tbl", "rec_id", "seg_no", "lang", "confidence").distinct()


QUERIES = {"p6_found": p6_found, "p6_languages": p6_languages}
ORACLE: dict[str, str] = {}

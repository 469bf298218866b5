"""Broken prompt and response pairs: each defective pair with the first defect that fits.

``empty``            no reply, or a complete reply without a letter, digit or answer value
``refusal``          automata over the sentences of the reply, in six languages, whose finds lie near one another: who
                     speaks, a negation of ability, permission, will or fitness, and the task; or an apology and such
                     a negation with little more; every sentence of a reply counts, whatever its length, unless it or
                     the quotation that it is part of is reported as someone's speech
``copied_question``  a suffix automaton of the prompt's words is traversed with the reply; the reply is covered by runs
                     of the prompt and one run holds most of the question or of the instruction
``truncated``        a delimiter stack that isn't empty (JSON, brackets, quotes), or an end at which no sentence ends:
                     a logistic model of sentence ends over the last words (characters in Chinese and Japanese), or a
                     last word that is only the beginning of known words
``other_language``   votes of stopwords and learned words for languages: no part in the wanted language

Words, and how often they begin a reply, are counted over all replies in one grouped aggregation; a word is known from a
share ``KNOWN`` of the replies on, whatever the size of the table, which also bounds the vocabulary. The last word of a
reply without a last stop may be a fragment and makes no word known. Only the weights of the sentence-end model are
fitted on a bounded sample of at most about ``SAMPLE`` whole replies, drawn by a hash of the id; all rows are judged.

Edge cases: a null list of turns and a null reply are ``empty``; null prompts leave out the checks that need a prompt;
very long replies are read whole.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.language import TAG, LanguageModel, fit_model
from corpusloom.llm.replies import prompt, reply
from corpusloom.session import table

SAMPLE = 12000
#: Sentences end with at least this probability where a reply may end.
END_LEAST = 0.06
#: Share of a word's places that are the first of a reply, from which it counts as one that begins sentences.
BEGINS = 0.12
#: Share of the replies, at least 2 of them, from which a word is known.
KNOWN = 1 / 12000
EPOCHS, STEP = 6, 0.2
_DIM = 1 << 17
_CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々]")
_KANA = re.compile(r"[぀-ヿｦ-ﾟ]")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々]|[^\W_぀-ヿ㐀-鿿ｦ-ﾟ々]+(?:['’-][^\W_]+)*|[.!?。！？\n]")
_STOPS = set(".!?。！？\n")
#: Dots that trail off end no sentence.
_TRAILING = re.compile(r"(?:\s*(?:\.{2,}|…))+$")
_ENDED = re.compile(r"[.!?。！？][\"'”’»)\]」』]*$")
#: A label of one or two words in front of a text, or a quotation mark of mail.
_LEAD = re.compile(r"^[>\s]*(?:(?:[^\W\d_]+ )?[^\W\d_]+\s*[:：]\s+)?")
_OPTION = re.compile(r"^\s*\(?[A-Z0-9]{1,3}[).:]\s")

# What a sentence of declining is made of, in the six languages; a star stands for any ending.
# Who speaks, and the model as such.
SELF = "i i'* me my myself we our us ich mir mich mein* je j'* m'* moi mes yo mí mi mis puedo podría soy debo quiero tengo niego 我 本模型 本助手 模型 抱歉 对不起 不好意思".split()
MODEL = ["language model", "ai model", "speech model", "as an ai", "ai assistant", "sprachmodell", "als ki", "modèle de lang*", "en tant qu'ia", "modelo de leng*", "como ia", "语言模型", "人工智能", "言語モデル", "aiとして"]
# Words that refuse by themselves, negations, and what a negation must meet to refuse: ability, permission, will, fitness.
REFUSES = ["cannot", "can't", "can not", "won't", "unable", "decline", "declining", "refuse", "refusing", "rather not", "pass on", "lehne", "verweigere", "décline", "incapable", "niego", "rechazo", "incapaz", *"不能 无法 没有办法 没办法 不可以 不便 不会 拒绝 不允许 不合适 不愿 できません できない かねます お断り ことはでき 控えさせ わけにはいきません".split()]
NEGATES = "not no never don't doesn't isn't aren't couldn't wouldn't shouldn't didn't nicht kein* ne n'* pas unmöglich impossible imposible".split()
ABLE = """can could will would able ability allow* permit* possible right appropriate comfortable position given provide offer kann könnte darf möchte werde lage
 erlaub* möglich richtig peux puis pourrais mesure permet* autoris* suis puedo podría posible capaz debo quiero correcto""".split()
# What is declined: the task, the recording, who or what is in it.
TASK = [*"""question* request* task* audio* recording* clip clips file files voice* speaker* opinion* content transcrib* aufgabe* aufnahme* frage* anfrage* bitte inhalt* stimme* datei*
 meinung demande* enregistrement* tâche* fichier* voix avis contenu pregunta* solicitud* grabaci* tarea* archivo* petici* opinión voz""".split(), "people in", "what you ask*", "what you are ask*", "what you're ask*", "do as you asked", *"要求 问题 请求 录音 音频 任务 内容 意见 質問 依頼 録音 音声 作業 タスク リクエスト 手伝い 要望 お答え 意見".split()]
# Apologies, followed by a pause where words are apart.
APOLOGIES = re.compile(r"\b(sorry|apologies|i apologi[sz]e|entschuldigung|es tut mir leid|tut mir leid|désolée?|pardon|lo siento|perdón)\s*[,.!;:—–-]|对不起|抱歉|不好意思|申し訳|すみません|ごめん")
# Beginnings of these.
SORRY = "sorry apolog entschuldigung leid désol pardon siento perdón 对不起 抱歉 不好意思 申し訳 すみません ごめん".split()
# Words with which someone's speech is reported; what the reader or the writer was asked isn't speech.
REPORTS = re.compile(r"\b(?<!\byou )(?<!\byou've )(?<!\bi was )(?<!\bi've been )(said|says|yelled|told|asked|asks|sagte|fragt|dit|demande si|cuenta|dijo)\b|说[：:“]|と言")
# Names of languages in prompts, in the six languages.
NAMED = {
    "en": r"\benglish\b|\benglisch\w*|\banglais\w*|\binglés\b|英语|英文|英語",
    "de": r"\bgerman\b|\bdeutsch\w*|\ballemand\w*|\balemán\b|德语|德文|ドイツ語",
    "fr": r"\bfrench\b|\bfranzösisch\w*|\bfrançais\w*|\bfrancés\b|法语|法文|フランス語",
    "es": r"\bspanish\b|\bspanisch\w*|\bespagnol\w*|\bespañol\b|西班牙语|スペイン語",
    "zh": r"\bchinese\b|\bmandarin\b|\bchinesisch\w*|\bchinois\w*|\bchino\b|中文|汉语|中国語",
    "ja": r"\bjapanese\b|\bjapanisch\w*|\bjaponais\w*|\bjaponés\b|日语|日文|日本語",
}
_NAMED = {k: re.compile(v) for k, v in NAMED.items()}


_SENTENCE = re.compile(r"[^.!?。！？]*(?:[.!?。！？]+[\"”’»)\]」』]*\s*|$)")
_QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"'}


def spoken(text: str) -> Iterator[tuple[str, str]]:
    """Sentences with their surroundings: all sentences that a quotation holds together, and what goes on after its end."""
    run: list[str] = []
    closing = ""
    for x in filter(None, _SENTENCE.findall(text)):
        if run and not closing and not (run[-1].rstrip()[-1:] in set('"”»」』') and x[:1].islower()):
            yield from ((y, "".join(run)) for y in run)
            run = []
        run.append(x)
        for ch in x:
            closing = "" if closing and ch in closing else closing or _QUOTES.get(ch, "")
    yield from ((y, "".join(run)) for y in run)


class SuffixAutomaton:
    """Suffix automaton of a token sequence."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for t in tokens:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][t]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def runs(self, tokens: list[str]) -> list[int]:
        """For each position, how many tokens up to it occur together in the automaton's sequence."""
        out, state, n = [], 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                n = self.len[state]
            if t in self.next[state]:
                state, n = self.next[state][t], n + 1
            out.append(n)
        return out


def _plain(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text.lower()) if t not in _STOPS]


def copied(prompt_text: str, reply_tokens: list[str]) -> bool:
    """Whether the reply is only the prompt's question or instruction again."""
    lines = [re.sub(r"^\s*(question|frage|pregunta|问题|質問)\s*[:：]", "", x, flags=re.I) for x in TAG.sub(" ", prompt_text).split("\n")]
    units = [u for u in (_plain(x) for x in lines if not _OPTION.match(x)) if u]
    if not units or not reply_tokens:
        return False
    shortest, total = min(map(len, units)), sum(map(len, units))
    if len(reply_tokens) * 1.25 < 0.8 * shortest or len(reply_tokens) > 4 * total + 6:
        return False
    runs = SuffixAutomaton([t for u in units for t in [*u, "\n"]]).runs(reply_tokens)
    covered, i = 0, len(reply_tokens) - 1
    while i >= 0:
        if runs[i] >= 3:
            covered += runs[i]
            i -= runs[i]
        else:
            i -= 1
    longest = max(runs)
    return covered >= 0.85 * len(reply_tokens) and any(longest >= 0.85 * len(u) and longest >= 3 for u in units)


def open_delimiters(text: str) -> bool:
    """Whether the stack of brackets and quotes isn't empty at the end."""
    stack: list[str] = []
    pairs = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "„": "“"}
    for ch in text:
        if stack and ch == stack[-1]:
            stack.pop()
        elif ch == '"':
            stack.append('"')
        elif ch in pairs:
            stack.append(pairs[ch])
    return bool(stack)


def _features(tokens: list[str], i: int) -> list[int]:
    """Hashed features of the place after token i."""
    w = [tokens[j] if j >= 0 else "^" for j in range(i, i - 8, -1)]
    for k, t in enumerate(w):
        if t in _STOPS or t == "^":
            w[k:] = ["^"] * (len(w) - k)
            break
    keys = [f"{k}{t}" for k, t in enumerate(w)]
    keys += [f"a{w[0]} {w[1]}", f"b{w[1]} {w[2]}", f"c{w[2]} {w[3]}", f"d{w[3]} {w[4]}", f"e{w[4]} {w[5]}", f"f{w[0]} {w[1]} {w[2]}", f"g{w[2]} {w[4]}", f"h{w[3]} {w[5]}"]
    return [xxhash.xxh32_intdigest(k) % _DIM for k in keys]


class EndModel:
    """Where sentences end, and which words there are."""

    def __init__(self, weights: np.ndarray, vocabulary: list[str]):
        self.weights, self.vocabulary = weights, vocabulary

    @classmethod
    def fit(cls, replies: list[str], seed: int = 5, words: tuple[list[str], set[str]] = ((), frozenset())) -> EndModel:
        """From replies and, of all replies, the known words and those that begin sentences. Where a reply has stops inside, they say where its sentences end; where it has none, places
        before words that often begin replies may be ends and say nothing."""
        rng = np.random.default_rng(seed)
        tokens = [_TOKEN.findall(TAG.sub(" ", text).lower()) for text in replies]
        vocabulary, begins = words
        x, y = [], []
        for toks in tokens:
            n = len(toks)
            if n < 3:
                continue
            marked = sum(t in _STOPS for t in toks[:-1]) * 25 >= n
            picks = set(rng.integers(0, n, 20).tolist())
            picks |= {i for i in range(n - 1) if toks[i + 1] in _STOPS} | {n - 1}
            for i in picks:
                if toks[i] in _STOPS:
                    continue
                last = i + 1 == n
                end = last or toks[i + 1] in _STOPS
                if not end and not marked and toks[i + 1] in begins:
                    continue
                x.append(_features(toks, i))
                y.append(end)
        w = np.zeros(_DIM)
        if x:
            f, t = np.array(x), np.array(y, float)
            g2 = np.full(_DIM, 1e-3)
            for _ in range(EPOCHS):
                for s in np.array_split(rng.permutation(len(t)), max(1, len(t) // 256)):
                    p = 1 / (1 + np.exp(-w[f[s]].sum(1) + 2.0))
                    g = np.bincount(f[s].ravel(), np.repeat(p - t[s], f.shape[1]), _DIM)
                    hit = np.flatnonzero(g)
                    g2[hit] += g[hit] ** 2
                    w[hit] -= STEP * g[hit] / np.sqrt(g2[hit])
        return cls(w.astype(np.float32), sorted(vocabulary))

    def end_probability(self, tokens: list[str]) -> float:
        return float(1 / (1 + np.exp(-self.weights[_features(tokens, len(tokens) - 1)].sum() + 2.0)))

    def is_fragment(self, word: str) -> bool:
        """Whether a word isn't known but begins known ones."""
        i = bisect.bisect_left(self.vocabulary, word)
        if i < len(self.vocabulary) and self.vocabulary[i] == word:
            return False
        return len(word) > 0 and i < len(self.vocabulary) and self.vocabulary[i].startswith(word)


def _pattern(phrases: list[str]) -> re.Pattern:
    whole = [re.escape(p).replace(r"\*", r"\w*") for p in phrases if not _CJK.search(p)]
    return re.compile("|".join([rf"\b(?:{'|'.join(whole)})\b", *(re.escape(p) for p in phrases if _CJK.search(p))]))


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds what may be one of the phrases, in linear time."""
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p.rstrip("*"), p)
    a.make_automaton()
    return a


_SELF, _MODEL, _REFUSES, _NEGATES, _ABLE, _TASK = map(_pattern, (SELF, MODEL, REFUSES, NEGATES, ABLE, TASK))
_NO, _WHAT = _automaton([*REFUSES, *NEGATES]), _automaton([*TASK, *SORRY])
#: Words (two Chinese or Japanese characters count as one) within which the finds of a refusal lie, those of a negation
#: and what it negates, and what may follow where an apology takes the place of the task.
NEAR, CLOSE, REST = 12, 5, 10
_STEP = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々]{1,2}|[^\W_぀-ヿ㐀-鿿ｦ-ﾟ々]+(?:['-][^\W_]+)*")


def _found(a: ahocorasick.Automaton, text: str) -> bool:
    return next(a.iter(text), None) is not None


def declines(sentence: str) -> bool:
    """Whether a sentence, in lower case, declines a task in the speaker's own name."""
    if not (_found(_WHAT, sentence) and _found(_NO, sentence)):
        return False
    starts = [m.start() for m in _STEP.finditer(sentence)]

    def at(pattern: re.Pattern) -> list[int]:
        return [bisect.bisect_right(starts, m.start()) for m in pattern.finditer(sentence)]

    able = at(_ABLE)
    no = at(_REFUSES) + [n for n in at(_NEGATES) if any(abs(n - a) <= CLOSE for a in able)]
    model = at(_MODEL)
    if model:
        no += at(_NEGATES)
    if not no:
        return False
    own = at(_SELF) + model
    cjk = len(_CJK.findall(sentence)) >= 4
    near = [n for n in no if (cjk and _KANA.search(sentence)) or any(abs(n - x) <= NEAR for x in own)]
    if any(abs(n - t) <= NEAR for n in near for t in at(_TASK)):
        return True
    sorry = [bisect.bisect_right(starts, m.start()) for m in APOLOGIES.finditer(sentence)]
    return any(0 <= n - x <= NEAR for n in no for x in sorry) and len(starts) - max(no) <= REST


def leaves(value: object) -> list:
    """The values in a JSON value that are no objects or lists, in order."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, (dict, list)):
            todo += list(x.values() if isinstance(x, dict) else x)[::-1]
        else:
            out.append(x)
    return out


class Judge:
    def __init__(self, ends: EndModel, languages: LanguageModel):
        self.ends, self.languages = ends, languages
        self._wanted: dict[str, str | None] = {}

    def empty(self, text: str) -> bool:
        body = TAG.sub(" ", text).strip()
        if body[:1] in "{[" and body:
            try:
                v = json.loads(body)
            except ValueError:
                return False
            return not any(any(ch.isalnum() for ch in str(x)) for x in leaves(v) if x is not None)
        return not any(ch.isalnum() for ch in body)

    def refusal(self, text: str) -> bool:
        shown = TAG.sub(" ", text).replace("’", "'")
        low = shown.lower()
        if not (_found(_WHAT, low) and _found(_NO, low)):
            return False
        return any(declines(x.lower()) and not REPORTS.search(y.lower()) for x, y in spoken(shown))

    def truncated(self, text: str) -> bool:
        body = TAG.sub(" ", text).strip()
        if body[:1] in ("{", "["):
            try:
                json.loads(body)
                return False
            except ValueError:
                return open_delimiters(body)
        body = _TRAILING.sub("", body)
        if _ENDED.search(body):
            return False
        if re.search(r"[,;:，、；：\-–—(（\[{/&]$", body) or open_delimiters(body):
            return True
        toks = _TOKEN.findall(body.lower())
        while toks and toks[-1] in _STOPS:
            toks.pop()
        if not toks:
            return False
        if len(toks) >= 3 and not _CJK.match(toks[-1]) and self.ends.is_fragment(toks[-1]):
            return True
        return len(toks) >= 4 and self.ends.end_probability(toks) < END_LEAST

    def wanted(self, prompt_text: str) -> str | None:
        key = prompt_text if len(prompt_text) < 300 else None
        if key in self._wanted:
            return self._wanted[key]
        low = TAG.sub(" ", prompt_text).lower()
        named = [l for l, r in _NAMED.items() if r.search(low)]
        if len(named) == 1:
            out = named[0]
        else:
            segs = self.languages.segments(low)
            strong = [s for s in segs if s[1] >= 0.9]
            out = max(strong, key=lambda s: len(s[2]))[0] if strong else None
        if key is not None and len(self._wanted) < 10000:
            self._wanted[key] = out
        return out

    def other_language(self, prompt_text: str, text: str) -> bool:
        body = TAG.sub(" ", text)
        try:
            body = " ".join(str(x) for x in leaves(json.loads(body)) if x is not None) if body.lstrip()[:1] in ("{", "[") else body
        except ValueError:
            pass
        if sum(ch.isalpha() for ch in body) < 4:
            return False
        want = self.wanted(prompt_text)
        if want is None:
            return False
        segs = [s for s in self.languages.units(body) if s[1]]
        return bool(segs) and sum(s[2] for s in segs) >= 3.0 and all(s[1] != want for s in segs)

    def defect(self, prompt_text: str | None, text: str | None) -> str | None:
        if text is None or self.empty(text):
            return "empty"
        if self.refusal(text):
            return "refusal"
        if prompt_text is not None and copied(prompt_text, _plain(_LEAD.sub("", TAG.sub(" ", text)))):
            return "copied_question"
        if self.truncated(text):
            return "truncated"
        if prompt_text is not None and self.other_language(prompt_text, text):
            return "other_language"
        return None


_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("docs", pa.int64())])


def word_counts(replies: DataFrame) -> DataFrame:
    """(word, n, first, docs) of all replies ``r``: times, times in front, and replies that hold it before their last
    word or a stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, first, docs = Counter(), Counter(), Counter()
            for text in b.column(0).to_pylist():
                toks = _TOKEN.findall(TAG.sub(" ", text).lower()) if text else []
                if toks:
                    n.update(toks)
                    first[toks[0]] += 1
                    docs.update(set(toks if toks[-1] in _STOPS else toks[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([c[w] for w in n], pa.int64()) for c in (n, first, docs))], schema=_COUNTED)

    parts = replies.select("r").mapInArrow(run, "word string, n long, first long, docs long")
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "first", "docs")])


def known_words(replies: DataFrame, total: int) -> tuple[list[str], set[str]]:
    """The words that the table's replies know, and those that begin sentences; ``total`` is the number of replies."""
    least = max(2, math.ceil(total * KNOWN))
    rows = word_counts(replies).where((F.col("docs") >= least) | (F.col("first") >= least)).collect()  # at most the words of a reply / KNOWN
    return [r["word"] for r in rows if r["docs"] >= least and len(r["word"]) > 1], {r["word"] for r in rows if r["first"] >= least and r["first"] > BEGINS * r["n"]}


def fit_judge(spark: SparkSession, d: str) -> Judge:
    t = table(spark, d, "train_samples")
    total = t.count()
    step = max(1, total // SAMPLE)
    rows = t.where(F.pmod(F.xxhash64("row_idx", F.lit(23)), F.lit(step)) == 0).select(reply().alias("r")).where("r is not null").limit(2 * SAMPLE).collect()
    return Judge(EndModel.fit([r[0] for r in rows], words=known_words(t.select(reply().alias("r")), total)), fit_model(spark, d))


_OUT = pa.schema([("row_idx", pa.int64()), ("defect", pa.string())])


def defective(spark: SparkSession, d: str) -> DataFrame:
    j = fit_judge(spark, d)
    model = spark.sparkContext.broadcast((j.ends, j.languages))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*model.value)
        for b in batches:
            ids, out = [], []
            for row, p, r in zip(*(c.to_pylist() for c in b.columns)):
                kind = judge.defect(p, r)
                if kind:
                    ids.append(row)
                    out.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], schema=_OUT)

    return table(spark, d, "train_samples").select("row_idx", prompt().alias("p"), reply().alias("r")).mapInArrow(run, "row_idx long, defect string")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return defective(spark, d).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_samples").select("row_idx", "task_type")
    return defective(spark, d).join(t, "row_idx").groupBy("task_type", "defect").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
ORACLE: dict[str, str] = {}

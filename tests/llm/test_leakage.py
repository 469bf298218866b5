import random

import numpy as np
import pytest

from corpusloom.llm import leakage as K
from corpusloom.session import table

rng = random.Random(4)
WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ane", "orel", "imp", "usk", "ealt", "ovin", "at", "ish")]
PASSAGE = rng.choices(WORDS, k=50)
NOISE = ["zq" + w for w in WORDS]


def doc(part, seed=0):
    r = random.Random(seed)
    return " ".join(r.choices(NOISE, k=30) + part + r.choices(NOISE, k=30))


def changed(part, places, how):
    out = list(part)
    for p in sorted(places, reverse=True):
        if how == "replace":
            out[p] = "zqnew"
        elif how == "drop":
            out.pop(p)
        else:
            out.insert(p, "zqadd")
    return out


P = PASSAGE
CASES = [
    (P, True), (P[10:22], True), (P[10:21], False), (changed(P[10:23], [6], "replace"), True), (changed(P[10:24], [6], "drop"), True), (changed(P[10:22], [6], "add"), True),
    (changed(P[:40], [8, 17, 26, 34], "replace"), True), (changed(P, [5, 9, 13, 17, 21, 25, 29, 33, 37, 41, 45], "replace"), False), (list(reversed(P)), False), (P[:8] + ["zq"] * 5 + P[20:28], False),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_cases(spark, case):
    part, want = CASES[case]
    docs = spark.createDataFrame([(1, doc(part, case)), (2, doc([], case))], "doc_id long, text string")
    pas = spark.createDataFrame([(7, " ".join(PASSAGE))], "passage_id long, text string")
    assert [tuple(r) for r in K.leaks(docs, pas).collect()] == ([(7, 1)] if want else [])


def test_form_does_not_matter(spark):
    text = "<p>" + " ".join(P[:6]).upper() + ",</p>\n<p>[00:12] " + " — ".join(P[6:14]) + "!</p>\nA: " + " ".join(P[14:20])
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text), (5, "x " * 200000 + text)], "doc_id long, text string")
    pas = spark.createDataFrame([(7, " ".join(P[:20])), (8, None), (9, "too short"), (10, " ".join(P[:20]))], "passage_id long, text string")
    assert sorted(tuple(r) for r in K.leaks(docs, pas).collect()) == [(p, d) for p in (7, 10) for d in (1, 4, 5)]


def test_blocks_of_passages(spark, data, monkeypatch):
    docs, pas = table(spark, data, "documents"), table(spark, data, "eval_passages")
    whole = {tuple(r) for r in K.leaks(docs, pas).collect()}
    monkeypatch.setattr(K, "BLOCK_WORDS", 5000)
    assert {tuple(r) for r in K.leaks(docs, pas).collect()} == whole


def test_all_fingerprints_in_the_radius_are_found():
    r = np.random.default_rng(1)
    index = K.Index([(i, " ".join(random.Random(i).choices(WORDS, k=30))) for i in range(20)])
    fp = index.fp.copy()
    for k in range(K.RADIUS):
        fp ^= np.uint64(1) << r.integers(0, 64, len(fp), dtype=np.uint64)
    probe = np.concatenate([fp, r.integers(0, 2**63, 2000, dtype=np.uint64)])
    got = {tuple(x) for x in index.hits(probe).tolist()}
    want = {(i, j) for i in range(len(probe)) for j in np.flatnonzero(np.bitwise_count(probe[i] ^ index.fp) <= K.RADIUS)}
    assert got == want and len(want) >= len(fp)

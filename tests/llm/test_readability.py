from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import readability as R
from corpusloom.llm.language import LanguageModel


@pytest.fixture(scope="module")
def big(data):
    return data.replace("sf0.001", "sf0.1")


def test_held_out_accuracy(spark, big):
    """Levels of half of the labelled documents from the labels of the other half."""
    lab = {}
    for i, r, l in duckdb.sql(f"select distinct doc_id, rater, reading_level from '{big}/level_labels.parquet' where reading_level is not null").fetchall():
        lab.setdefault(i, []).append(l)
    rows = duckdb.sql(f"select source, text, doc_id from '{big}/documents.parquet' where text is not null and doc_id in (select doc_id from '{big}/level_labels.parquet')").fetchall()
    docs = [(s, t, {l: c / len(lab[i]) for l, c in Counter(lab[i]).items()}) for s, t, i in rows if i in lab]
    g = R.Grader.fit(docs[::2])
    test = [d for d in docs[1::2] if max(d[2].values()) == 1.0]
    x, _ = R.features(R.Vocabulary(g.lex), [R.units(d[1]) for d in test])
    hit = np.mean([level in d[2] for level, d in zip(g.grade(x), test)])
    assert hit > 0.9, hit  # raters of one document disagree in about one case in nine
    assert min(g.accuracy.values()) > 0.7


def test_trees_learn_and_share_a_base():
    r = np.random.default_rng(0)
    x = r.random((800, 3))
    y = (x[:, 1] > 0.5).astype(float)
    t = R.Trees.fit(x, y, np.ones(800), 0)
    assert np.corrcoef(t.predict(x), y)[0, 1] > 0.95


def test_isotonic():
    s, v = R.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert v.tolist() == [0, 0.5, 1] and s.tolist() == [1, 2, 4]


def test_units():
    assert R.units("[00:07] The cow is kind.\nA: It runs, now!") == (["the", "cow", "is", "kind", "it", "runs", "now"], [4, 3], 1)
    w, s, _ = R.units("word " * 100)
    assert len(w) == 100 and sum(s) == 100 and max(s) == R.UNIT
    assert R.units("") == ([], [], 0)


def test_reader_rejects(spark, data):
    lm, g = R.fit(spark, data.replace("sf0.001", "sf0.01"))
    german = "Der laute Hund knarrt neben dem Schlüssel und der Wagen bellt in der alten Mühle. " * 5
    easy = "The cow is kind. I see a big book. My dog plays and goes. Can you hear the car? " * 4
    got = R.Reader(lm, g).levels([None, "", "too short", german, easy, easy * 3000, "说话的人觉得 " * 60])
    assert got == [None, None, None, None, 1, 1, None]
    assert R.Reader(lm, g).levels([]) == []


def test_no_labels(spark, data, tmp_path):
    from conftest import rough

    d = rough(tmp_path, 0)
    assert R.fit(spark, d)[1] is None and isinstance(R.fit(spark, d)[0], LanguageModel)

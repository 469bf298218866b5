import random
from collections import Counter

import pytest

from corpusloom.llm import neardup as N


def dice(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def corpus(seed=5):
    """Texts over a small vocabulary with edits of many sizes, reorderings, repeats and a hot text."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)]
    out = []
    for _ in range(60):
        base = [rng.choice(vocab[: rng.choice([40, 120])]) for _ in range(rng.randint(30, 60))]
        out.append(base)
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, len(t) // 4)):
                k = rng.randrange(len(t))
                op = rng.random()
                if op < 0.4:
                    t[k] = rng.choice(vocab)
                elif op < 0.7:
                    t.insert(k, rng.choice(vocab))
                elif len(t) > 31:
                    t.pop(k)
            rng.shuffle(t)
            out.append(t)
    out += [out[0]] * 5 + [["a"] * 31 + ["b"] * 2, ["a"] * 33, ["a"] * 28 + ["b"] * 8]
    return [(i, " ".join(t)) for i, t in enumerate(out)] + [(9001, None), (9002, ""), (9003, "short one"), (9004, "W1! " * 5)]


@pytest.mark.parametrize("cost,block", [(3000, 8192), (1, 8192), (20, 8192), (3000, 16), (100, 8192), (5, 64)])
def test_all_pairs(spark, monkeypatch, cost, block):
    monkeypatch.setattr(N, "MAX_COST", cost)
    monkeypatch.setattr(N, "BLOCK", block)
    docs = corpus()
    reps, member = N.classes(spark.createDataFrame(docs, "id long, text string"))
    pairs = {(r["x"], r["y"]) for r in N.similar_representatives(reps).collect()}
    rep = {r["id"]: r["rep"] for r in member.collect()}
    texts = {i: t for i, t in docs if t and len(t.split()) >= 30}
    assert set(rep) == set(texts)
    want = {(min(rep[i], rep[j]), max(rep[i], rep[j])) for i in texts for j in texts if i < j and rep[i] != rep[j] and dice(texts[i], texts[j]) >= 0.8 - 1e-12}
    assert pairs == want and len(want) > 50


def sized_corpus(n, seed, vocab=400, families=12):
    """Families of texts of about n words over a vocabulary that all of them use, with changes up to the threshold."""
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = [f"w{int(vocab * rng.random() ** 2)}" for _ in range(n)]
        out.append(base)
        for share in (0.05, 0.15, 0.19, 0.21, 0.3):
            t = [w if rng.random() > share else f"w{int(vocab * rng.random() ** 2)}" for w in base]
            t = t[: len(t) - rng.randint(0, n // 8)]
            rng.shuffle(t)
            out.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("n,cost", [(80, 2), (120, 2), (120, 10), (1000, 4), (1000, 3000)])
def test_long_replies_of_frequent_words(spark, monkeypatch, n, cost):
    monkeypatch.setattr(N, "MAX_COST", cost)
    docs = sized_corpus(n, 3)
    reps, _ = N.classes(spark.createDataFrame(docs, "id long, text string"))
    pairs = {(r["x"], r["y"]) for r in N.similar_representatives(reps).collect()}
    want = {(i, j) for i, a in docs for j, b in docs if i < j and dice(a, b) >= 0.8 - 1e-12}
    assert pairs == want and len(want) > 12


def test_signatures_grow_with_length_only():
    """Of texts in which every word is frequent, the number of signatures is in proportion to the length."""
    import numpy as np

    rng = np.random.default_rng(1)
    df = np.full((1 << 16) + 1, 20_000)
    df[-1] = 1_000_000
    sign = N._signer(df, 3000)
    per_word = [len(sign(np.sort(rng.integers(0, 1 << 60, n)))[0]) / n for n in (60, 120, 1000, 8000)]
    assert max(per_word) < 12 and per_word[-1] < 1.5 * per_word[0]


def test_signatures_ask_for_more_words_when_they_are_frequent():
    import numpy as np

    assert [N.depth_of(np.append(np.full(1 << 16, c), 1_000_000), 3000) for c in (10, 50_000, 300_000, 600_000)] == [2, 2, 3, 4]


def test_very_long_texts(spark):
    rng = random.Random(1)
    base = [f"v{rng.randrange(3000)}" for _ in range(30000)]
    other = base[:26000] + [f"u{i}" for i in range(4000)]
    far = base[:20000] + [f"u{i}" for i in range(10000)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(reversed(other))), (3, " ".join(far))], "id long, text string")
    reps, _ = N.classes(docs)
    assert sorted(tuple(r) for r in N.similar_representatives(reps).collect()) == [(1, 2), (2, 3)]  # 2 and 3 at exactly 0.8


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (7, 7)], "x long, y long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 100, 101, 102, 500]], "id long")
    got = {r["id"]: r["component"] for r in N.components(edges, nodes).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 500: 500}


def test_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("It's  a-b C​d — Été　x_1",)], "t string")
    assert df.select(N.words(F.col("t"))).first()[0] == ["its", "ab", "cd", "été", "x1"]


def test_hot_class(spark, monkeypatch, tmp_path):
    """A third of the replies is one text; all its pairs and those with its relatives come out."""
    from corpusloom import session

    monkeypatch.setattr(N, "hot_keys", lambda df, key: session.hot_keys(df, key, one_in=10))
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base)] * 30 + [" ".join([*base[:37], "a", "b", str(i)]) for i in range(3)] + [" ".join(f"z{i}_{k}" for k in range(35)) for i in range(60)]
    rows = [(i, [("user", "q"), ("assistant", t)]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "row_idx long, messages array<struct<role:string,content:string>>").write.parquet(str(tmp_path / "train_samples.parquet"))
    assert session.hot_keys(N.classes(N._docs(spark, str(tmp_path)))[1], "rep", one_in=10) == [0]
    got = {tuple(r) for r in N.p2_found(spark, str(tmp_path)).collect()}
    assert got == {(i, j) for i in range(33) for j in range(i + 1, 33)}

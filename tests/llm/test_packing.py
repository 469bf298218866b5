import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import packing as P


def test_hilbert_is_a_walk():
    side = 8
    g = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = P.hilbert_key(g, 3)
    assert sorted(k.tolist()) == list(range(side**3))
    steps = np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1)
    assert (steps == 1).all()


@pytest.mark.parametrize("ranges", [10**9, 20_000])
def test_contents(spark, monkeypatch, ranges):
    monkeypatch.setattr(P, "TOKENS_PER_RANGE", ranges)
    rng = np.random.default_rng(2)
    sizes = {i: int(n) for i, n in enumerate(rng.lognormal(4.5, 1.2, 1500))} | {5000: 0, 5001: 512, 5002: 513, 5003: 20000}
    items = spark.createDataFrame([(i, n, int(rng.integers(0, 5))) for i, n in sizes.items()], "doc_id long, n_tokens long, curve long")
    rows = P.pack(items, [("a", 512), ("b", 8192)]).collect()
    for name, cap in (("a", 512), ("b", 8192)):
        mine = [r for r in rows if r["container"] == name]
        used, docs = {}, {}
        for r in mine:
            used[r["container_no"]] = used.get(r["container_no"], 0) + r["n_tokens"]
            docs.setdefault(r["doc_id"], []).append(r)
        assert max(used.values()) <= cap and set(docs) == {i for i, n in sizes.items() if n}
        for i, pieces in docs.items():
            pieces.sort(key=lambda r: r["piece"])
            assert sum(p["n_tokens"] for p in pieces) == sizes[i] and len(pieces) == max(1, -(-sizes[i] // cap))
            assert [p["first_token"] for p in pieces] == [cap * k for k in range(len(pieces))]
        if ranges == 10**9:
            assert sum(used.values()) / (cap * len(used)) > (0.97 if name == "a" else 0.9)


def test_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, " \n"), (5, "x" * 100000), (6, "Hello world")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["curve"]) for r in P.sized(df).collect()}
    assert got[1][0] == 2 and set(got) == {1, 4, 5, 6} and got[1] == got[6]
    assert P.pack(P.sized(df).where("false"), [("a", 5)]).count() == 0
    with pytest.raises(ValueError, match="positive"):
        P.pack(P.sized(df), [("a", 0)])


def test_pattern_is_that_of_the_vocabulary():
    import public_tokenizers as T
    import tiktoken

    own, ref = P.tokenizer(), None
    ref = tiktoken.Encoding("ref", pat_str=T.PATTERN, mergeable_ranks=own._mergeable_ranks, special_tokens={})
    for t in ("It's  1,000 tests\n\n  — naïve 三秒 ", "a'll B'LL  \t x", ""):
        assert own.encode_ordinary(t) == ref.encode_ordinary(t) and own.decode(own.encode_ordinary(t)) == t


def test_fill(spark, data):
    low = P.p7_fill(spark, data).groupBy("container").agg(F.avg("fill").alias("f"), F.count("*").alias("n")).collect()
    assert all(r["f"] > 0.95 or r["n"] < 20 for r in low)


def test_containers_hold_neighbours_of_the_curve(spark, data):
    """Documents of one container lie near one another on the curve, not as anywhere in the collection."""
    import numpy as np

    items = {r["doc_id"]: r for r in P.sized(P.table(spark, data.replace("sf0.001", "sf0.1"), "documents")).collect() if r["n_tokens"]}
    order = sorted(items.values(), key=lambda r: (r["curve"], r["doc_id"]))
    spread = lambda keys: np.mean([np.std(k) for k in keys if len(k) > 1])
    packer, held = P.Packer(2048), {}
    for lo in range(0, len(order), P.WINDOW):
        part = order[lo : lo + P.WINDOW]
        for number, doc, *_ in packer.window([r["doc_id"] for r in part], [r["n_tokens"] for r in part]):
            held.setdefault(number, []).append(items[doc]["curve"])
    assert spread(held.values()) < 0.15 * np.std([r["curve"] for r in order])
    assert sum(r["n_tokens"] for r in order) / (2048 * packer.made) > 0.99

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing as M
from corpusloom.llm.recordings import source_of
from corpusloom.session import table


def test_rake_reaches_targets_within_caps():
    r = np.random.default_rng(3)
    n = 60
    main, lang, topic = r.integers(0, 3, n), r.integers(0, 3, n), r.integers(0, 4, n)
    seconds = np.zeros((n, 3))
    seconds[np.arange(n), main] = r.random(n) * 100
    seconds[::7, 2] += 5
    share, cap = np.array([0.2, 0.3, 0.5]), np.array([1, 4, 2])
    w = M.rake(seconds, main, lang, topic, share, cap)
    got = (w[:, None] * seconds).sum(0)
    assert np.allclose(got / got.sum(), share, atol=2e-3) and (w <= cap[main] + 1e-9).all() and (w >= 0).all()
    small = M.rake(seconds, main, lang, topic, share, cap, total=100.0)
    assert (small[:, None] * seconds).sum() == pytest.approx(100, rel=1e-2)


def test_rake_without_a_source():
    w = M.rake(np.array([[10.0, 0], [20.0, 0]]), np.array([0, 0]), np.array([0, 1]), np.array([0, 0]), np.array([0.5, 0.5]), np.array([2, 2]))
    assert np.allclose(w, 2)
    assert len(M.rake(np.zeros((0, 2)), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.array([0.5, 0.5]), np.array([1, 1]))) == 0


@pytest.mark.parametrize("block", [50_000, 100])
def test_shares(spark, data, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    d = data.replace("sf0.001", "sf0.1")
    sources, share, repeats = M._targets(spark, d)
    rows = {r["source"]: r for r in M.p3_shares(spark, d).collect()}
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1, abs=1e-4)
    for s, t in zip(sources, share):
        assert abs(rows[s]["actual_share"] - t) < 0.02 * max(1, block == 100 and 1.5), (s, t, rows[s])
    over = [r for r in M.p3_mix(spark, d).collect() if r["copies"] > repeats[sources.index(r["source"])] or r["copies"] < 1]
    assert not over


def test_least_repeats_of_all_sources_held(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    sources, _, repeats = M._targets(spark, d)
    least = F.least(*[F.when(F.array_contains("held", s), n).otherwise(99) for s, n in zip(sources, repeats)])
    item = table(spark, d, "train_samples").select("row_idx", F.explode("audios").alias("p"))
    held = item.select("row_idx", source_of(F.col("p"), sources).alias("s")).groupBy("row_idx").agg(F.collect_set("s").alias("held"))
    mixed = M.p3_mix(spark, d).join(held, "row_idx").select("copies", least.alias("most"))
    assert mixed.where("copies > 1").count() > 0 and mixed.where("copies > most").count() == 0


def test_all_three_marginals_are_met():
    r = np.random.default_rng(5)
    n = 400
    main, lang, topic = r.integers(0, 3, n), r.integers(0, 4, n), r.integers(0, 5, n)
    seconds = np.zeros((n, 3))
    seconds[np.arange(n), main] = 10 + r.random(n) * 100
    w = M.rake(seconds, main, lang, topic, np.array([0.2, 0.3, 0.5]), np.array([3, 3, 3]), total=seconds.sum() / 3)
    cell = seconds.sum(1)
    for codes in (lang, topic):
        assert np.allclose(np.bincount(codes, w * cell) / (w * cell).sum(), np.bincount(codes, cell) / cell.sum(), atol=1e-3)


def test_marginals(spark, data):
    rows = M.p3_marginals(spark, data.replace("sf0.001", "sf0.1")).collect()
    for kind in ("language", "topic"):
        mine = [r for r in rows if r["kind"] == kind]
        assert len(mine) > 3 and all(sum(r[c] for r in mine) == pytest.approx(1, abs=1e-4) for c in ("natural_share", "weighted_share", "actual_share"))
        assert all(abs(r["natural_share"] - r["weighted_share"]) < 0.005 for r in mine)

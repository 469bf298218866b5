import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import frames as W
from corpusloom.operators import masking, stats, vq
from corpusloom.operators import piecewise as PW
from corpusloom.operators import samples as S
from corpusloom.operators.rules import Rule
from corpusloom.session import hot_keys, lookup_join


def test_lookup_join_hot(spark):
    facts = spark.range(4000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.createDataFrame([(7, "hot"), (3000, "cold")], "k long, v string")
    assert hot_keys(facts, "k") == [7]
    got = lookup_join(facts, lookup, "k").groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {"hot": 2000, "cold": 1, None: 1999}
    assert lookup_join(facts, lookup, "k", "inner").count() == 2001


def test_salted_join(spark):
    from corpusloom.session import salted_join

    left = spark.range(4000).select(F.when(F.col("id") < 2000, 7).when(F.col("id") < 3000, F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (2500, "c"), (None, "d"), (9999, "e")], "k long, v string")
    got = salted_join(left, right, "k", "id")
    assert got.groupBy("v").count().orderBy("v").collect() == [("a", 2000), ("b", 2000), ("c", 1)] and got.distinct().count() == 4001
    assert salted_join(left, right, "k", "id", hot=[]).count() == 4001


def test_written_and_released(spark):
    from corpusloom import session

    df = session.written(spark.range(5), "t")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert session.release(spark) >= 1 and session.release(spark) == 0


def test_options_encodings(spark):
    rows = [
        (0, '["x", "y"]', 1, None), (1, '[{"content": "x", "label": "A"}, {"content": "y", "label": "B"}]', None, "A"),
        (2, '[{"content": "x", "is_correct": true}, {"content": "y", "is_correct": true}]', None, None), (3, '["x"]', 5, None), (4, "[]", 0, None),
        (5, "no json", 0, None), (6, None, 0, None), (7, "[" + ",".join(f'"{i}"' for i in range(30)) + "]", 27, None),
    ]
    df = spark.createDataFrame(rows, "i int, o string, n long, l string").withColumn("opts", S.options(F.col("o"), F.col("n"), F.col("l")))
    got = {r["i"]: (r["opts"] and len(r["opts"]), r["label"]) for r in df.select("i", "opts", S.right_label(F.col("opts")).alias("label")).collect()}
    assert got == {0: (2, "B"), 1: (2, "A"), 2: (2, "B"), 3: (1, None), 4: ([], None), 5: (None, None), 6: (None, None), 7: (30, "28")}


def test_captions(spark):
    df = spark.createDataFrame([(1, [" a ", "", None], None), (2, [" "], ["s"]), (3, ["l"], ["s"])], "i long, l array<string>, s array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", S.caption(F.col("l"), F.col("s"), "mix", 1, F.col("i")).alias("c")).collect()}
    assert got[1]["caption"] is None and got[3]["caption"] in ("l", "s") and got[3]["prompt"].startswith("<audio>")
    assert [r[0] for r in df.orderBy("i").select(S.caption(F.col("l"), F.col("s"), "long", 1, F.col("i")).caption).collect()] == ["a", None, "l"]
    with pytest.raises(ValueError, match="style"):
        S.caption(F.col("l"), F.col("s"), "odd")


def test_extract(spark):
    samples = spark.createDataFrame([(1, ["/o/set/a.wav", None, "plain"]), (2, ["/o/set/gone.wav", "/o/set/a.wav"]), (3, None), (4, []), (5, ["plain"]), (6, ["/O/SET/bad.mp3"])], "row_idx long, audios array<string>")
    inv = spark.createDataFrame([("/n/set/a.wav", True), ("/O/SET/bad.mp3", False)], "path string, valid boolean")
    items = C.extract(samples, inv, ["set"], [Rule("set", "swap", "/o/", "/n/")]).cache()
    kept = C.keep_rows(items).collect()
    assert [(r["row_idx"], r["audios"], r["datasets"]) for r in kept] == [(1, ["/n/set/a.wav", None, "plain"], ["set"])]
    assert [tuple(r) for r in C.first_failures(items).collect()] == [("set", 2)]
    assert C.extract(samples.limit(0), inv.limit(0), ["set"], []).count() == 0


def test_replacement(spark):
    ids = spark.range(50).withColumnRenamed("id", "r")
    got = C.replacement(ids, "r", ids.where("r % 2 = 0"), 5).collect()
    assert len(got) == 25 and all(g["taken"] is None or g["taken"] % 2 == 1 for g in got) and sum(g["taken"] is not None for g in got) > 15


@pytest.mark.parametrize("block", [3, 4096])
def test_bounded_windows_do_not_depend_on_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", block)
    df = spark.createDataFrame([(k, t, float(t * k % 7)) for k in (1, 2) for t in range(11)], "id long, t long, v double")
    h, w = W.bounded(df, "id", "t", 2, 1, block)
    got = {(r["id"], r["t"]): (r["a"], r["b"]) for r in W.own_only(h.withColumn("a", F.lag("v", 2).over(w)).withColumn("b", F.lead("v").over(w))).collect()}
    v = {(k, t): float(t * k % 7) for k in (1, 2) for t in range(11)}
    assert got == {(k, t): (v.get((k, t - 2)), v.get((k, t + 1))) for k, t in v}
    run = {(r["id"], r["t"]): r["c"] for r in W.running_sum(df, "id", "t", "v", "c", block=block).collect()}
    assert run == {(k, t): sum(v[k, i] for i in range(t + 1)) for k, t in v}


def test_ratio_fold_short(spark):
    slow = spark.createDataFrame([(1, t) for t in range(5)], "id long, t long")
    fast = spark.createDataFrame([(1, 0, 9)], "id long, t long, value long")
    assert W.ratio_fold(slow, fast, "id", "t", 2, -100).count() == 5
    with pytest.raises(Exception, match="too few frames"):
        W.ratio_fold(slow, fast, "id", "t", 2, -100, most_short=5).collect()


def test_kmeans_keeps_empty_codes(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(10)] + [(10, None)], "i long, v array<double>")
    book = (np.array([0, 1, 2]), np.array([[0.1, 0.0], [0.9, 0.0], [50.0, 50.0]]))
    (_, e), n = vq.kmeans(df, "i", "v", book, rounds=2)
    assert n.tolist() == [5, 5, 0] and e.tolist() == [[0, 0], [1, 0], [50, 50]]
    (_, e), _ = vq.kmeans(df, "i", "v", book, rounds=1, cosine=True)
    assert np.allclose(np.linalg.norm(e[1:], axis=1), 1)


def test_whiteness(spark):
    rng = np.random.default_rng(1)
    white = spark.createDataFrame([(rng.standard_normal(8).tolist(),) for _ in range(3000)], "v array<double>")
    one_way = spark.createDataFrame([((rng.standard_normal() * np.ones(8)).tolist(),) for _ in range(300)], "v array<double>")
    assert stats.whiteness(white, "v", 1, 8).first()[0] == pytest.approx(1, abs=0.02)
    assert stats.whiteness(one_way, "v", 1, 8).first()[0] == pytest.approx(8, abs=0.01)


@pytest.mark.parametrize("law,other,apart", [("static", 0, False), ("uniform", 2, False), ("normal", 3, False), ("poisson", 0, False), ("static", 0, True)])
def test_span_masks(spark, law, other, apart):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 5, 9, 10, 11, 200, 1000, None])], "row long, n long")
    rows = masking.span_mask(df, "row", "n", law=law, other=other, apart=apart).collect()
    assert len(rows) == 9
    for r in rows:
        assert r["masked"] == sorted(set(r["masked"])) and all(0 <= x < r["length"] for x in r["masked"]) and (len(r["masked"]) < r["length"] or not r["length"])
    assert sorted(map(str, rows)) == sorted(map(str, masking.span_mask(df, "row", "n", law=law, other=other, apart=apart).collect()))


def test_mask_ratio(spark):
    df = spark.range(200).select(F.col("id").alias("row"), F.lit(1000).alias("n"))
    ratio = masking.mask_ratio(masking.span_mask(df, "row", "n", p=0.65, span=10)).first()["ratio"]
    assert abs(ratio - masking.expected_ratio(0.65, 10)) < 0.05
    eq = masking.equalised(masking.span_mask(df, "row", "n"), "row", "masked", 1).select(F.size("masked").alias("n")).distinct().collect()
    assert len(eq) == 1


def test_spans_apart_keep_their_space(spark):
    df = spark.range(300).select(F.col("id").alias("row"), (F.col("id") % 97 + 3).alias("n"))
    for r in masking.span_mask(df, "row", "n", span=4, apart=True, space=2, p=0.5).collect():
        runs = np.split(np.array(r["masked"]), np.flatnonzero(np.diff(r["masked"]) > 1) + 1)
        assert all(len(x) <= 4 for x in runs) and all(b[0] - a[-1] > 2 for a, b in zip(runs, runs[1:])) and r["masked"]
    first = [r["masked"][0] for r in masking.span_mask(spark.range(2000).select(F.col("id").alias("row"), F.lit(12).alias("n")), "row", "n", span=3, p=0.5, apart=True).collect()]
    assert set(first) >= {0, 1, 2, 3, 4}  # gaps of all sizes


def test_equalised_upwards_and_thinned(spark):
    df = spark.createDataFrame([(1, 10, [1, 2, 3]), (2, 10, [5]), (3, 2, [0]), (4, 0, [])], "row long, n long, masked array<long>")
    up = {r["row"]: r["masked"] for r in masking.equalised(df, "row", "masked", 1, "n").collect()}
    assert up[1] == [1, 2, 3] and len(up[2]) == 3 and 5 in up[2] and up[3] == [0, 1] and up[4] == [] and up[2] == sorted(set(up[2]))
    thin = {r["row"]: r["masked"] for r in masking.thinned(df, "row", "masked", 1 / 3, 7).collect()}
    assert len(thin[1]) == 2 and set(thin[1]) < {1, 2, 3} and thin[2] == [5] and thin[4] == []
    with pytest.raises(ValueError, match="no law"):
        masking.span_mask(df, "row", "n", law="other")


def test_piecewise_algebra(spark):
    f, g = [(0, 10.0), (1, 0.0)], [(0.5, 15.0), (0.6, 1.0)]
    p = PW.breakpoints(spark, f=f, g=g)
    xs = [-100.0, -1.0, 0.0, 0.25, 0.5, 0.55, 0.575, 0.6, 0.8, 1.0, 3.0]
    made = PW.combined(p, "f", "g", "max", "top").union(PW.combined(p, "f", "g", "min", "low")).union(PW.combined(p, "f", "g", "sum", "sum")).union(PW.scaled(p, "f", 3.0, 1.0, "three"))
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    for name in ("top", "low", "sum", "three"):
        df = PW.evaluate(df, "x", made, name, name)
    rows = {r["x"]: r for r in df.withColumn("f", PW.ramps(F.col("x"), f)).withColumn("g", PW.ramps(F.col("x"), g)).collect()}
    assert [rows[x]["f"] for x in (-100.0, 0.0, 0.25, 1.0, 3.0)] == [10, 10, 7.5, 0, 0]
    for x in xs:
        a, b = np.interp(x, *zip(*f)), np.interp(x, *zip(*g))
        got = rows[x]
        assert [got[k] for k in ("f", "g", "top", "low", "sum", "three")] == pytest.approx([a, b, max(a, b), min(a, b), a + b, 3 * a + 1])
    assert rows[None]["f"] is None and rows[None]["top"] is None
    with pytest.raises(ValueError, match="different places"):
        PW.breakpoints(spark, f=[(0, 1), (0, 2)])


def test_feature_mask_is_nested(spark):
    df = spark.range(500).select(*[masking.feature_mask(F.col("id"), F.lit(d), 1, 2, 0.875, 3).alias(f"d{d}") for d in range(3)])
    rows = df.collect()
    assert all(r["d0"] == 1 and r["d2"] <= r["d1"] for r in rows) and 0 < sum(r["d1"] for r in rows) < 500

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import mathx as M
from corpusloom.functions import plugins, seeded
from corpusloom.functions import text as T
from corpusloom.functions.paths import is_blank, posix_resolve


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


def texts(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_punctuation(spark):
    given = ["", "a", "a.", "a? ", "a ", "a,", "a ", None, "  ", "x!"]
    assert texts(spark, given, T.punctuate) == ["", "a.", "a.", "a? ", "a.", "a,", "a.", None, "  ", "x!"]


def test_reasoning(spark):
    given = ["x", "<think>a</think> b ", "a</think>b</think>\nc", "</think>", None]
    assert texts(spark, given, T.after_reasoning) == ["x", "b", "c", "", None]


def test_replace(spark):
    c = F.lit("a<m>b<m>c<m>")
    assert one(spark, T.replace_first(c, "<m>", "1")) == "a1b<m>c<m>"
    assert one(spark, T.replace_each(c, "<m>", F.array(F.lit("1"), F.lit("2")))) == "a1b2c<m>"
    assert one(spark, T.replace_each(F.lit(""), "<m>", F.array(F.lit("1")))) == ""


def test_labels(spark):
    assert [one(spark, T.option_label(F.lit(i))) for i in (0, 25, 26, 30)] == ["A", "Z", "27", "31"]
    assert one(spark, T.option_label(F.lit(26), bounded=False)) == "["


def test_paths(spark):
    given = ["/a/./b//c.wav", "/a/x/../b.wav", "/../a", "a/../../b", "/a/b", "./a", None, "/a/.b", "/a/b/"]
    assert texts(spark, given, posix_resolve) == ["/a/b/c.wav", "/a/b.wav", "/a", "../b", "/a/b", "a", None, "/a/.b", "/a/b"]
    assert texts(spark, ["", " \t", " ​", None, "x"], is_blank) == [True, True, True, True, False]
    assert texts(spark, ["/a/b.tar.gz", "b", ".hid", "/x/.hid.wav"], T.suffix) == [".gz", "", "", ".wav"]


def test_parse_bool(spark):
    assert texts(spark, ["Yes", "f", None], T.parse_bool) == [True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        texts(spark, ["maybe"], T.parse_bool)


def test_padding_mask_golden(spark):
    df = spark.createDataFrame([(n,) for n in (1, 3, 2, 5)], "n int")
    rows = [r[0] for r in df.select(A.padding_mask(F.col("n"), F.lit(5))).collect()]
    assert rows == [[False, True, True, True, True], [False, False, False, True, True], [False, False, True, True, True], [False] * 5]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 10])
def test_chunks(spark, n):
    a = F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>")
    got = one(spark, A.chunks(a, 5, F.lit(0)))
    flat = [x for c in got for x in c]
    assert len(got) == math.ceil(n / 5) and flat[:n] == list(range(n)) and not any(flat[n:])


def test_ends(spark):
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, A.ends_with(a, F.array(F.lit(2), F.lit(3))))
    assert not one(spark, A.stopped(a, [F.array(F.lit(2)), F.array(*map(F.lit, range(9)))]))
    assert one(spark, A.where_mask(a, F.array(F.lit(True), F.lit(False), F.lit(True)))) == [1, 3]


def test_activations(spark):
    for x in (-30.0, -1.0, 0.0, 2.0, 40.0):
        assert one(spark, M.swoosh_l(F.lit(x))) == pytest.approx(np.logaddexp(0, x - 4) - 0.08 * x - 0.035)
        assert one(spark, M.swoosh_r(F.lit(x))) == pytest.approx(np.logaddexp(0, x - 1) - 0.08 * x - 0.313261687, abs=1e-9)
        assert one(spark, plugins.gelu(F.lit(x))) == pytest.approx(0.5 * x * (1 + math.erf(x / math.sqrt(2))))
    with pytest.raises(ValueError, match="no activation"):
        M.activation("nope")


def test_seeded(spark):
    a = F.array(*map(F.lit, range(20)))
    got = one(spark, seeded.shuffled(a, 1, 2))
    assert sorted(got) == list(range(20)) and got != list(range(20)) and got == one(spark, seeded.shuffled(a, 1, 2))
    assert one(spark, seeded.pick(F.array().cast("array<int>"), 1)) is None
    u = [r[0] for r in spark.range(2000).select(seeded.uniform(5, F.col("id"))).collect()]
    assert abs(np.mean(u) - 0.5) < 0.03 and 0 <= min(u) and max(u) < 1


def test_plugins(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i int, s string")
    assert [r[0] for r in df.select(plugins.tokenize(F.col("s"), "bytes")).collect()] == [[97, 98], None]
    scored = plugins.score(df, lambda: lambda p: p["s"].fillna("").str.len().astype(float), "double")
    assert sorted((r["i"], r["score"]) for r in scored.collect()) == [(1, 2.0), (2, 0.0)]
    rows = spark.createDataFrame([(0, 0, [1]), (0, 1, [2, 3])], "b int, o int, a array<bigint>")
    r = plugins.collate(rows, "b", "o", "a").first()
    assert r["lengths"] == [1, 2] and r["padded"] == [[1, -100], [2, 3]]

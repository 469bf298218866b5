import pytest
from pyspark.sql import functions as F

from corpusloom.operators import frames as W
from corpusloom.session import table
from corpusloom.streaming import keyed as K

ORDER = ["ts", "event_id"]


@pytest.fixture(scope="module")
def parts(spark, data, tmp_path_factory):
    """Events in five files, in the order of time."""
    d = tmp_path_factory.mktemp("events")
    e = table(spark, data, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value").orderBy("ts", "event_id").collect()
    n = -(-len(e) // 5)
    for k in range(5):
        spark.createDataFrame(e[k * n : (k + 1) * n]).coalesce(1).write.mode("append").parquet(str(d))
    return str(d)


def read(spark, parts):
    return K.source(spark, parts, spark.read.parquet(parts).schema)


def batch(spark, parts):
    return W.frame_index(spark.read.parquet(parts), "user_id", "ts", "event_id")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_left_context(spark, parts):
    got = K.drain(K.left_context(read(spark, parts), "user_id", ORDER, "event_id", 3), "t")
    want = W.left_context(batch(spark, parts), "user_id", "t", "event_id", 3)
    assert rows(got, "user_id", "t", "context") == rows(want, "user_id", "t", "context")


def test_fir(spark, parts):
    got = K.drain(K.causal_fir(read(spark, parts), "user_id", ORDER, "value", [0.2, 0.3, 0.5]), "t")
    want = W.fir(batch(spark, parts), "user_id", "t", "value", [0.2, 0.3, 0.5], 2, "y")
    cols = ("user_id", "t", F.round("y", 6))
    assert rows(got, *cols) == rows(want, *cols)


def test_chunks(spark, parts):
    got = K.drain(K.chunks(read(spark, parts), "user_id", ORDER, "value", 4, 1), "t")
    whole = W.chunk_causal(batch(spark, parts), "user_id", "t", "value", 4, 1).where("t % 4 = 3").select("user_id", "chunk", "seen_sum", "seen")
    cols = ("user_id", "chunk", F.round("seen_sum", 6), "seen")
    assert rows(got, *cols) == rows(whole, *cols)


def test_resume(spark, parts, tmp_path):
    first = spark.read.parquet(parts)
    src = str(tmp_path / "src")
    first.where("event_id % 2 = 0").coalesce(1).write.parquet(src)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = lambda: K.cutoff(read(spark, src), "user_id", ORDER, "value", 0.3)
    n = K.drain(stream(), "t", out, state).count()
    assert n == first.where("event_id % 2 = 0").count() and K.drain(stream(), "t", out, state).count() == n
    first.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    assert K.drain(stream(), "t", out, state).count() == first.count()

"""Streaming queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.frames import _EV
from corpusloom.session import table
from corpusloom.streaming import keyed as K

ORDER = ["ts", "event_id"]


def _source(s, d):
    return K.source(s, f"{d}/events.parquet", table(s, d, "events").schema).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def stream_left_context(s, d):
    out = K.drain(K.left_context(_source(s, d), "user_id", ORDER, "event_id", 4), "left-context")
    return out.select("user_id", "t", F.array_join("context", ",").alias("context"))


def stream_causal_fir(s, d):
    out = K.drain(K.causal_fir(_source(s, d), "user_id", ORDER, "value", [0.2, 0.3, 0.5]), "fir")
    return out.select("user_id", "t", F.round("y", 6).alias("y"))


def stream_chunks(s, d):
    out = K.drain(K.chunks(_source(s, d), "user_id", ORDER, "value", 4, 2), "chunks")
    return out.select("user_id", "chunk", F.round("seen_sum", 6).alias("seen_sum"), "seen")


def stream_delayed(s, d):
    out = K.drain(K.delayed(_source(s, d), "user_id", ORDER, "value", 3), "delayed")
    return out.select("user_id", "t", F.round("ahead_sum", 6).alias("ahead_sum"))


def stream_cutoff(s, d):
    return K.drain(K.cutoff(_source(s, d), "user_id", ORDER, "value", 0.3), "cutoff").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("above").alias("above"))


QUERIES = {f.__name__: f for f in (stream_left_context, stream_causal_fir, stream_chunks, stream_delayed, stream_cutoff)}
ORACLE = {
    "stream_left_context": _EV + " SELECT user_id, t, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS context FROM ev",
    "stream_causal_fir": _EV + " SELECT user_id, t, round(0.2 * coalesce(lag(value, 2) OVER w, 0) + 0.3 * coalesce(lag(value) OVER w, 0) + 0.5 * value, 6) AS y FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)",
    "stream_chunks": _EV + ", c AS (SELECT user_id, t // 4 AS chunk, sum(value) AS s FROM ev GROUP BY 1, 2 HAVING count(*) = 4) SELECT user_id, chunk, round(sum(s) OVER w, 6) AS seen_sum, count(*) OVER w * 4 AS seen FROM c WINDOW w AS (PARTITION BY user_id ORDER BY chunk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "stream_delayed": _EV + ", a AS (SELECT user_id, t, sum(value) OVER w AS s, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT user_id, t, round(s, 6) AS ahead_sum FROM a WHERE n = 4",
    "stream_cutoff": """WITH RECURSIVE ev AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
      f(user_id, t, cutoff, n, above) AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT), 0.0::DOUBLE, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ev UNION ALL
        SELECT f.user_id, f.t + 1, CASE WHEN ((above + CAST(value > cutoff AS INT)) / (n + 1) - 0.3::DOUBLE > 0) = (value > cutoff) THEN value * abs((above + CAST(value > cutoff AS INT)) / (n + 1) - 0.3::DOUBLE) + cutoff * (1 - abs((above + CAST(value > cutoff AS INT)) / (n + 1) - 0.3::DOUBLE)) ELSE cutoff END, n + 1, above + CAST(value > cutoff AS INT)
        FROM f JOIN ev ON ev.user_id = f.user_id AND ev.t = f.t + 1)
      SELECT user_id, n, above FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS k FROM f) WHERE k = 1""",
}

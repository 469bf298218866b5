"""Piecewise-linear functions as tables of breakpoints (f, x, y), and their algebra as joins of segments.

A function is straight between its breakpoints and constant beyond them. Tables of breakpoints are parameters: small,
and made by unions; what they are evaluated on may be of any size and meets them by a broadcast join or as an expression.

Edge cases: a breakpoint given twice is an error; null places give null; a table without a function gives no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Points = list[tuple[float, float]]


def checked(points: Points) -> Points:
    p = sorted((float(x), float(y)) for x, y in points)
    if not p or any(a[0] == b[0] for a, b in zip(p, p[1:])):
        raise ValueError("a function needs breakpoints at different places")
    return p


def breakpoints(spark: SparkSession, **functions: Points) -> DataFrame:
    """(f, x, y) of functions by name."""
    return spark.createDataFrame([(f, x, y) for f, p in functions.items() for x, y in checked(p)], "f string, x double, y double")


def ramps(x: Column, points: Points) -> Column:
    """The value at ``x`` as an expression: the first y and, for every segment, its slope times the part passed."""
    p = checked(points)
    passed = [F.lit((b[1] - a[1]) / (b[0] - a[0])) * (F.least(F.greatest(x, F.lit(a[0])), F.lit(b[0])) - a[0]) for a, b in zip(p, p[1:])]
    return F.when(x.isNotNull(), sum(passed, F.lit(p[0][1])))


def segments(points: DataFrame) -> DataFrame:
    """(f, lo, hi, x, y, slope): the stretches of every function, the two endless ones included; hi is exclusive."""
    w, inf = Window.partitionBy("f").orderBy("x"), F.lit(float("inf"))
    inner = points.select("f", F.col("x").alias("lo"), F.coalesce(F.lead("x").over(w), inf).alias("hi"), "x", "y", F.coalesce((F.lead("y").over(w) - F.col("y")) / (F.lead("x").over(w) - F.col("x")), F.lit(0.0)).alias("slope"))
    first = points.groupBy("f").agg(F.min("x").alias("hi"), F.min_by("y", "x").alias("y")).select("f", (-inf).alias("lo"), "hi", F.col("hi").alias("x"), "y", F.lit(0.0).alias("slope"))
    return inner.unionByName(first)


def evaluate(df: DataFrame, at: str, points: DataFrame, f: str, name: str) -> DataFrame:
    """``df`` with the value of function ``f`` at its column ``at``."""
    s = segments(points.where(F.col("f") == f)).select(*[F.col(c).alias(f"_{c}") for c in ("lo", "hi", "x", "y", "slope")])
    joined = df.join(F.broadcast(s), (F.col(at) >= F.col("_lo")) & (F.col(at) < F.col("_hi")), "left")
    return joined.withColumn(name, F.col("_y") + F.col("_slope") * (F.col(at) - F.col("_x"))).drop("_lo", "_hi", "_x", "_y", "_slope")


def scaled(points: DataFrame, f: str, times: float = 1.0, plus: float = 0.0, name: str = "") -> DataFrame:
    """``f`` times a number plus a number."""
    return points.where(F.col("f") == f).select(F.lit(name or f).alias("f"), "x", (F.col("y") * times + plus).alias("y"))


def combined(points: DataFrame, a: str, b: str, how: str, name: str) -> DataFrame:
    """The ``sum``, ``max`` or ``min`` of two functions, exactly: its breakpoints are those of either and, for the last
    two, the places between neighbouring ones at which the difference changes sign."""
    if how not in ("sum", "max", "min"):
        raise ValueError(f"no combination {how!r}")
    places = points.where(F.col("f").isin(a, b)).select("x").distinct()
    both = evaluate(evaluate(places, "x", points, a, "a"), "x", points, b, "b")
    value = {"sum": F.col("a") + F.col("b"), "max": F.greatest("a", "b"), "min": F.least("a", "b")}[how]
    out = both.select(F.lit(name).alias("f"), "x", value.alias("y"))
    if how == "sum":
        return out
    after = Window.orderBy("x")  # a parameter table
    gap = both.select("x", "a", (F.col("a") - F.col("b")).alias("d"), *[F.lead(c).over(after).alias(f"{c}2") for c in ("x", "a")], F.lead(F.col("a") - F.col("b")).over(after).alias("d2"))
    part = F.col("d") / (F.col("d") - F.col("d2"))
    cross = gap.where(F.col("d") * F.col("d2") < 0).select(F.lit(name).alias("f"), (F.col("x") + part * (F.col("x2") - F.col("x"))).alias("x"), (F.col("a") + part * (F.col("a2") - F.col("a"))).alias("y"))
    return out.unionByName(cross)

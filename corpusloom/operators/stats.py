"""Statistics of framed data: masked means, channel balance, whiteness, entropy, losses and moving cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.piecewise import ramps


def masked_mean(df: DataFrame, key: str, value: str, valid: Column) -> DataFrame:
    return df.groupBy(key).agg(F.avg(F.when(valid, F.col(value))).alias("mean"))


def channel_stats(df: DataFrame, channel: str, x: str, lo: float, hi: float) -> DataFrame:
    """Per channel: mean, root mean square, deviation, mean over deviation, and how far that is off a band."""
    v = F.col(x).cast("double")
    g = df.groupBy(channel).agg(F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(1e-20))).alias("std"))
    ratio = F.col("mean") / F.col("std")
    return g.withColumn("ratio", ratio).withColumn("off_band", F.greatest(F.lit(lo) - ratio, F.lit(0.0)) + F.greatest(ratio - F.lit(hi), F.lit(0.0)))


def covariance(df: DataFrame, vec: str, groups: int, n_dims: int) -> DataFrame:
    """(g, i, j, cov): sums of products of centred channels within groups, from one pass of partial sums."""
    per = n_dims // groups
    v = F.transform(vec, lambda x: x.cast("double"))
    pairs = df.select(F.posexplode(v).alias("i", "x"), v.alias("v")).withColumn("g", F.floor(F.col("i") / per))
    y = F.slice("v", (F.col("g") * per + 1).cast("int"), per)
    long = pairs.select("g", "i", "x", F.posexplode(y).alias("k", "y"))
    s = long.groupBy("g", "i", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    return s.select("g", "i", (F.col("g") * per + F.col("k")).alias("j"), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")).alias("cov"))


def whiteness(df: DataFrame, vec: str, groups: int, n_dims: int) -> DataFrame:
    """One row: 1 where all directions within and between groups vary alike, more otherwise."""
    c = covariance(df, vec, groups, n_dims)
    a = c.agg(F.sum(F.col("cov") * F.col("cov")).alias("sq"), F.avg(F.when(F.col("i") == F.col("j"), F.col("cov"))).alias("diag"))
    return a.select((F.col("sq") / n_dims / (F.col("diag") * F.col("diag") + 1e-20)).alias("whiteness"))


def explained(df: DataFrame, vec: str, direction: list[float]) -> DataFrame:
    """Share of the centred variance that lies in a direction."""
    d = F.array(*map(F.lit, direction))
    v = F.transform(vec, lambda x: x.cast("double"))
    along = F.aggregate(F.zip_with(v, d, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = sum(x * x for x in direction)
    one = df.agg((F.var_pop(along) / length).alias("along"))
    total = df.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s")).agg(F.sum("s").alias("total"))
    return one.crossJoin(F.broadcast(total)).select((F.col("along") / F.col("total")).alias("share"))


def entropy(df: DataFrame, key: str, p: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(-F.col(p) * F.ln(F.col(p) + 1e-20)).alias("entropy"))


def bce_with_logits(logit: Column, target: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def weighted_layers(df: DataFrame, key: str, weight: str, value: str) -> DataFrame:
    """Mean over layers with the softmax of their weights."""
    w = F.exp(F.col(weight))
    return df.groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mixed"))


def online_cutoff(values: Column, p: float) -> Column:
    """Fold of the moving cut-off that a share ``p`` of values should exceed: (cutoff, n, above).

    The fold depends on the order, so an array holds a whole sequence; for sequences without bound there is the
    streaming form, which keeps three numbers per key."""
    start = F.struct(F.lit(0.0).alias("cutoff"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("above"))

    def step(s: Column, x: Column) -> Column:
        hit = x > s.cutoff
        n, above = s.n + 1, s.above + F.when(hit, 1).otherwise(0)
        off = above / n - p
        moved = F.when((off > 0) == hit, x * F.abs(off) + s.cutoff * (1 - F.abs(off))).otherwise(s.cutoff)
        return F.struct(moved.alias("cutoff"), n.alias("n"), above.alias("above"))

    return F.aggregate(values, start, step)


def ema_per_key(df: DataFrame, key: str, t: str, value: str, length: str, decay: float) -> DataFrame:
    """Moving average at the end of each sequence, begun with its first value, as a sum of weighted values: partial
    sums instead of a fold, so that no sequence is gathered."""
    weight = F.pow(F.lit(decay), F.col(length) - 1 - F.col(t)) * F.when(F.col(t) == 0, 1.0).otherwise(1 - decay)
    return df.groupBy(key).agg(F.sum(weight * F.col(value)).alias("ema"))


def ema(values: Column, decay: float) -> Column:
    """Moving average of an ordered array, from its first value; null for an empty one."""
    first = F.get(values, F.lit(0))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), first, lambda s, x: s * decay + x * (1 - decay))


def cross_entropy(df: DataFrame, key: str, logit: str, is_target: Column, ignored: Column | None = None) -> DataFrame:
    """Mean of -log softmax of the target over positions (``key``), one row per class; ignored positions drop out."""
    kept = df if ignored is None else df.where(~ignored)
    top = kept.groupBy(key).agg(F.max(logit).alias("_m"))
    from corpusloom.session import lookup_join

    j = lookup_join(kept, top, key, "inner")
    per = j.groupBy(key).agg((F.ln(F.sum(F.exp(F.col(logit) - F.col("_m")))) + F.first("_m") - F.sum(F.when(is_target, F.col(logit)).otherwise(0.0))).alias("_l"))
    return per.agg(F.avg("_l").alias("loss"), F.count(F.lit(1)).alias("n"))


def schedule(step: Column, points: list[tuple[float, float]], default: float, training: bool = True) -> Column:
    """A piecewise-linear function of the step in training, a fixed value otherwise and for null steps."""
    return F.coalesce(ramps(step.cast("double"), points), F.lit(default)) if training else F.lit(default)

"""Array expressions: padding, chunking, splicing, masks. Null arrays give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexes(n: Column) -> Column:
    """0 to n - 1; empty for 0 and less."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


def pad_right(a: Column, width: Column, fill: Column) -> Column:
    """Filled up at the end; longer arrays stay."""
    return F.concat(a, F.array_repeat(fill, F.greatest(width - F.size(a), F.lit(0)).cast("int")))


def pad_left(a: Column, width: Column, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, F.greatest(width - F.size(a), F.lit(0)).cast("int")), a)


def fit_width(a: Column, width: int, fill: Column) -> Column:
    """Cut or filled up to exactly ``width``."""
    return F.slice(pad_right(a, F.lit(width), fill), 1, width)


def truncate(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def chunks(a: Column, size: int, fill: Column) -> Column:
    """Chunks of ``size``, the last one filled up; none for an empty array."""
    n = F.ceil(F.size(a) / F.lit(size)).cast("bigint")
    padded = pad_right(a, n * size, fill)
    return F.transform(indexes(n), lambda i: F.slice(padded, (i * size + 1).cast("int"), size))


def repeat_each(a: Column, k: int) -> Column:
    return F.flatten(F.transform(a, lambda x: F.array_repeat(x, k)))


def gather(a: Column, at: Column) -> Column:
    """Elements at 0-based places; places outside give null."""
    return F.transform(at, lambda i: F.get(a, i.cast("int")))


def scatter_true(n: Column, at: Column) -> Column:
    """Mask of length n that is true at the given places."""
    return F.transform(indexes(n), lambda t: F.array_contains(at, t))


def padding_mask(length: Column, width: Column) -> Column:
    """True where padded: width booleans, false for the first ``length``."""
    return F.transform(indexes(width), lambda t: t >= length)


def attention_mask(length: Column, width: Column) -> Column:
    """The opposite polarity as integers: 1 where valid."""
    return F.transform(indexes(width), lambda t: (t < length).cast("int"))


def where_mask(a: Column, mask: Column) -> Column:
    """Elements whose mask is true."""
    return F.filter(F.zip_with(a, mask, lambda x, m: F.when(m, F.struct(x.alias("v")))), lambda s: s.isNotNull()).getField("v")


def splice_after(a: Column, i: Column, b: Column) -> Column:
    """b inserted behind the element at 0-based place i."""
    return F.concat(F.slice(a, 1, i + 1), b, F.slice(a, i + 2, F.size(a)))


def ends_with(a: Column, tail: Column) -> Column:
    """Whether the array ends in ``tail``; true for an empty tail."""
    n = F.size(tail)
    return (F.size(a) >= n) & (F.when(n == 0, True).otherwise(F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))) == tail))


def stopped(a: Column, stops: list[Column]) -> Column:
    """Whether the array ends in any of the stop sequences."""
    out = F.lit(False)
    for s in stops:
        out = out | ends_with(a, s)
    return out


def ordered(items: Column, value: str = "v") -> Column:
    """Values of an aggregated array of structs, sorted by their leading fields."""
    return F.transform(F.array_sort(items), lambda s: s[value])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column, least: float = 1e-12) -> Column:
    return let(F.greatest(norm(a), F.lit(least)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_channels(chs: Column) -> Column:
    """Down-mix by the mean of equally long channels."""
    n = F.size(chs)
    total = F.aggregate(F.slice(chs, 2, F.greatest(n - 1, F.lit(1))), F.transform(F.get(chs, F.lit(0)), lambda x: x.cast("double")), lambda s, c: F.zip_with(s, c, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def first_channel(chs: Column) -> Column:
    """Down-mix by the first channel."""
    return F.get(chs, F.lit(0))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """Centred and divided by the deviation; null for an empty array."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / n

    def centred(m: Column) -> Column:
        var = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") - m, 2)) / n
        return let(F.sqrt(var + eps), lambda d: F.transform(a, lambda x: (x.cast("double") - m) / d))

    return F.when(n > 0, let(mean, centred))


def bias_norm(a: Column, bias: float, log_scale: float) -> Column:
    """Divided by the root mean square of the distance from a bias, times exp(log_scale)."""
    ms = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") - bias, 2)) / F.size(a)
    return F.when(F.size(a) > 0, let(F.sqrt(ms), lambda d: F.transform(a, lambda x: x.cast("double") / d * F.exp(F.lit(log_scale)))))


def convex(a: Column, b: Column, share: float) -> Column:
    """a + (b - a) * share, element by element."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") + (y.cast("double") - x.cast("double")) * share)

"""Pseudo-random numbers from md5 of a seed and a key: the same for the same row, whatever the partitioning.

Any engine with md5 can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(*keys: Column | str | int) -> Column:
    """A whole number below 2**60."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(*keys: Column | str | int) -> Column:
    """In [0, 1), in steps of a millionth."""
    return F.pmod(hash60(*keys), F.lit(1_000_000)) / 1_000_000.0


def pick(a: Column, *keys: Column | str | int) -> Column:
    """One element of an array; null for an empty one."""
    return F.when(F.size(a) > 0, F.get(a, F.pmod(hash60(*keys), F.greatest(F.size(a), F.lit(1)).cast("bigint")).cast("int")))


def shuffled(a: Column, *keys: Column | str | int) -> Column:
    """A permutation of an array."""
    keyed = F.transform(a, lambda x, i: F.struct(hash60(*keys, i).alias("h"), i.alias("i"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s.v)

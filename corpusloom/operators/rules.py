"""Provenance detection and path rewriting by tables of rules.

A rule belongs to a data set and has a shape; several rules of one data set apply one after the other. Shapes:

``swap``       every occurrence of ``old`` becomes ``new``
``extension``  an ending ``old`` becomes ``new``
``letter``     the base name gets ``new`` in front
``rebuild``    ``new`` + parent folder + "/" + stem + ``old`` as extension
``lookup``     the stem is looked up in a table of (id, path); a miss gives an empty text
``first``      the first of some candidates that exists, else the path as it is (see ``first_existing``)

All shapes but the last two are expressions; the last two are joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import lookup_join


@dataclass(frozen=True)
class Rule:
    dataset: str
    shape: str
    old: str = ""
    new: str = ""

    def apply(self, c: Column) -> Column:
        if self.shape == "swap":
            return T.replace_all(c, self.old, self.new)
        if self.shape == "extension":
            return T.swap_extension(c, self.old, self.new)
        if self.shape == "letter":
            return T.prefix_basename(c, self.new)
        if self.shape == "rebuild":
            return F.concat(F.lit(self.new), T.basename(T.dirname(c)), F.lit("/"), T.stem(c), F.lit(self.old))
        raise ValueError(f"{self.shape} is no expression")


def rewrite(path: Column, dataset: Column, rules: list[Rule]) -> Column:
    """The path by the rules of its data set; unchanged where there is none or the data set is null."""
    out = path
    for name in dict.fromkeys(r.dataset for r in rules):
        c = path
        for r in rules:
            if r.dataset == name:
                c = r.apply(c)
        out = F.when(dataset == name, c).otherwise(out)
    return out


def lookup(df: DataFrame, key: str, mapping: DataFrame, value: str, default: str = "") -> DataFrame:
    """Left join to a table of unique keys, with a default for misses; hot keys don't skew it."""
    return lookup_join(df, mapping.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def first_existing(df: DataFrame, id_col: str, candidates: Column, inventory: DataFrame, fallback: Column) -> DataFrame:
    """Per row the first of its candidate paths that the inventory (column ``path``) holds, else the fallback.

    Null candidates are passed over; a row without candidates takes the fallback.
    """
    there = inventory.select("path").where("path is not null").distinct()
    tried = df.select(id_col, F.posexplode(candidates).alias("prio", "path")).join(there, "path", "left_semi")
    best = tried.groupBy(id_col).agg(F.min_by("path", "prio").alias("_best"))
    return df.join(best, id_col, "left").withColumn("chosen", F.coalesce("_best", fallback)).drop("_best")

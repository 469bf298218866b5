"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """Null, empty or white space only, Unicode spaces and zero-width marks included."""
    return c.isNull() | (F.regexp_replace(c, r"[\s\p{Z}\x{200B}\x{FEFF}\x{85}]+", "") == "")


def posix_resolve(path: Column) -> Column:
    """The path as a POSIX file system resolves it, without links: ``//``, ``/./`` and ``x/..`` vanish, case counts.

    Only paths that hold such a part take the fold; the others pass unchanged. Null stays null.
    """
    absolute = path.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        up = F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.concat(acc, F.array(part)))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    whole = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))
    return F.when(path.rlike(r"//|(^|/)\.{1,2}(/|$)|./$"), whole).otherwise(path)

"""Extension points: registries of tokenizers, scorers and extractors, and the functions that apply them in batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TOKENIZERS: dict[str, Callable[[str], list[int]]] = {
    "bytes": lambda s: list(s.encode()),
    "chars": lambda s: [ord(c) for c in s],
}


def tokenizer(name: str):
    def register(f):
        TOKENIZERS[name] = f
        return f

    return register


def tokenize(text: Column, name: str) -> Column:
    """Token ids by a registered tokenizer; null stays null, an unknown name is an error."""
    if name not in TOKENIZERS:
        raise ValueError(f"no tokenizer {name!r}")
    f = TOKENIZERS[name]

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run(text)


def render_chat(messages: Column, begin: str = "<|turn|>", end: str = "<|/turn|>") -> Column:
    """Chat template: every turn as begin marker, role, line break, content and end marker."""
    one = F.transform(messages, lambda m: F.concat(F.lit(begin), F.coalesce(m.role, F.lit("")), F.lit("\n"), F.coalesce(m.content, F.lit("")), F.lit(end)))
    return F.array_join(one, "\n")


def score(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.Series]], ddl: str, name: str = "score", batch: int = 64) -> DataFrame:
    """Adds the result of a model that is made once per task and called on batches of rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in parts:
            for lo in range(0, len(pdf), batch):
                b = pdf.iloc[lo : lo + batch].reset_index(drop=True)
                yield b.assign(**{name: model(b)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{name}` {ddl}")


def erf(x: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else math.erf(v))

    return run(x)


def gelu(x: Column) -> Column:
    """The exact form with the error function."""
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def collate(df: DataFrame, batch: str, order: str, items: str, fill: int = -100) -> DataFrame:
    """Rows of a batch (fixed-size batches only) as one: the lists in order, padded to the longest, and their lengths."""
    g = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, items))).alias("_r"))
    lists = F.transform("_r", lambda r: r[items])
    width = F.array_max(F.transform(lists, lambda a: F.size(a)))
    return g.select(batch, F.transform(lists, lambda a: F.size(a)).alias("lengths"), F.transform(lists, lambda a: F.concat(a, F.array_repeat(F.lit(fill).cast("bigint"), width - F.size(a)))).alias("padded"))

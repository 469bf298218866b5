"""Columns of the training manifest that several operators read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_turn(messages: Column, role: str) -> Column:
    """Content of the first turn of a role; null where there is none or the list is null."""
    turns = F.filter(messages, lambda m: m.isNotNull() & (m.role == role))
    return F.try_element_at(turns, F.lit(1)).content


def reply(messages: Column | None = None) -> Column:
    return first_turn(F.col("messages") if messages is None else messages, "assistant")


def prompt(messages: Column | None = None) -> Column:
    return first_turn(F.col("messages") if messages is None else messages, "user")

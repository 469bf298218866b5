"""String expressions. All are built-in expressions and propagate null unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a Java character class body.
WHITE = r"\s\p{Z}\x{85}\x{1C}-\x{1F}"
#: Ends of a text after which no full stop is added.
TERMINAL = (".", "?", "!", ",")


def strip(c: Column) -> Column:
    """Without white space, of any Unicode kind, at both ends."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITE}]+$", "")


def strip_char(c: Column, ch: str) -> Column:
    """Without one given character at both ends."""
    return F.trim(c, F.lit(ch))


def replace_all(c: Column, old: str, new: str) -> Column:
    """Every occurrence of a literal, wherever it stands."""
    return F.replace(c, F.lit(old), F.lit(new))


def replace_each(c: Column, marker: str, replacements: Column) -> Column:
    """The k-th occurrence of ``marker`` becomes the k-th element; markers beyond the array stay."""
    parts = F.split(c, _quoted(marker), -1)
    filled = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(replacements, i - 1), F.lit(marker)), p)))
    return F.array_join(filled, "")


def replace_first(c: Column, marker: str, new: str) -> Column:
    """Only the first occurrence of a literal."""
    at = F.instr(c, marker)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(marker), F.length(c)))).otherwise(c)


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def part(c: Column, delimiter: str, n: int) -> Column:
    """The n-th piece between delimiters, from 1, or from the end if negative; empty where there is none."""
    return F.split_part(c, F.lit(delimiter), F.lit(n))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def dirname(c: Column) -> Column:
    """What precedes the last slash; empty without a slash."""
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def stem(c: Column) -> Column:
    """Base name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def suffix(c: Column) -> Column:
    """Last extension with its dot; empty without one."""
    return F.regexp_extract(basename(c), r"(?<=.)(\.[^.]*)$", 1)


def swap_extension(c: Column, old: str, new: str) -> Column:
    """The extension replaced where the text ends in ``old``."""
    return F.when(c.endswith(old), F.concat(F.substring(c, F.lit(1), F.length(c) - len(old)), F.lit(new))).otherwise(c)


def prefix_basename(c: Column, letter: str) -> Column:
    """The base name with a letter in front."""
    d = dirname(c)
    return F.when(c.contains("/"), F.concat(d, F.lit("/" + letter), basename(c))).otherwise(F.concat(F.lit(letter), c))


def ends_with_any(c: Column, ends: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | c.endswith(e)
    return out


def punctuate(c: Column) -> Column:
    """A full stop after a text that ends in none of ``TERMINAL``. White space at the end goes only where a stop is
    added; texts that are blank or end well stay as they are."""
    r = rstrip(c)
    return F.when((F.length(r) > 0) & ~ends_with_any(r, TERMINAL), F.concat(r, F.lit("."))).otherwise(c)


def option_label(i: Column, bounded: bool = True) -> Column:
    """A to Z for 0 to 25, then the number from 27 on; unbounded: the characters that follow A."""
    letter = F.char(F.lit(65) + i)
    return F.when(i < 26, letter).otherwise((i + 1).cast("string")) if bounded else letter


def after_reasoning(c: Column, tag: str = "</think>") -> Column:
    """What follows the last closing reasoning tag, stripped; the whole text, stripped, without a tag."""
    return strip(F.split_part(c, F.lit(tag), F.lit(-1)))


def ints(c: Column) -> Column:
    """"1,2,4" to an array of integers; pieces that are no integer become null."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int"))


def parse_bool(c: Column) -> Column:
    """yes, true, t, y, 1 and no, false, f, n, 0 in any case; anything else is an error, null stays null."""
    low = F.lower(c)
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def slot(template: str, value: Column) -> Column:
    """``{}`` of a template replaced by a value."""
    head, _, tail = template.partition("{}")
    return F.concat(F.lit(head), value, F.lit(tail)) if "{}" in template else F.lit(template)


def detect(c: Column, wanted: list[str]) -> Column:
    """First name, in the order given, that the text contains in any letter case; else null."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for w in reversed(wanted):
        out = F.when(low.contains(w.lower()), F.lit(w)).otherwise(out)
    return out


def dispatch(c: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """Value of the first rule all of whose substrings occur; else the default."""
    out = F.lit(default)
    for needles, value in reversed(rules):
        hit = F.lit(True)
        for n in needles:
            hit = hit & c.contains(n)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out

"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def truncated(c: Column) -> Column:
    """A non-negative double cut to a long, before any sum."""
    return F.floor(c).cast("long")


def over(keys: list[str], *order: str):
    return W.partitionBy(*keys).orderBy(*order)


def latched(value: Column, fire: float, rearm: float, window) -> Column:
    """True where a latch fires: value at ``fire`` or more, and no firing since it was last below ``rearm``."""
    mark = F.when(value >= fire, "F").when(value < rearm, "R")
    before = F.last(mark, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))
    return (mark == "F") & (before.isNull() | (before != "F"))


def glob(pattern: str) -> str:
    """A case-insensitive regular expression of a glob: ``*`` doesn't cross ``/``, ``?`` is one character, ``[...]`` a set."""
    out, i = "(?i)^", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out += pattern[i : end + 1].replace("[!", "[^")
            i = end
        else:
            out += "\\" + c if c in r".^$+{}()|\[]" else c
        i += 1
    return out + "$"

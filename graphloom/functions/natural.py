"""Natural order of strings: runs of digits compare as numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(rb"\d+|\D+")


def natural_key(text: str | None) -> tuple:
    """A sort key on the driver: null first, digit runs by value, then the shorter run first."""
    if text is None:
        return ()
    parts = []
    for run in _RUN.findall(text.encode("utf-8", "surrogatepass")):
        parts.append((1, int(run), len(run), b"") if run[:1].isdigit() else (1, -1, 0, run))
    return ((0,), *_bytewise(parts))


def _bytewise(parts: list[tuple]) -> list[tuple]:
    """Other characters one by one, so that a digit run stands against a single character."""
    out: list[tuple] = []
    for kind, value, size, raw in parts:
        if value >= 0:
            out.append((kind, 48, value, size))
        else:
            out += [(kind, b, 0, 0) for b in raw]
    return out


def natural_order(c: Column) -> Column:
    """A string column that sorts in natural order.

    A run of digits becomes a 0, the length of its number and the number
    without leading zeros, then the length of the run; a length is written
    after the number of its own digits, so that texts compare like lengths.
    """
    pieces = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, "^0+(?=\\d)", "")
    sized = lambda t: F.concat(F.char(F.length(F.length(t).cast("string")) + 48), F.length(t).cast("string"))
    keyed = F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), sized(bare(p)), bare(p), sized(p))).otherwise(p))
    return F.array_join(keyed, "")

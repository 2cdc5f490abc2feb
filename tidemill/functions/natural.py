"""Natural order: runs of digits compare as numbers, before any text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(r"[0-9]+|[^0-9]+")


def natural_key(value: str) -> list[tuple[int, int, str]]:
    """The order of `natural` for driver code, by the same triples: kind of run, length without leading zeros, text."""
    out = []
    for run in _RUN.findall(value):
        bare = run.lstrip("0") or "0"
        out.append((0, len(bare), bare) if "0" <= run[0] <= "9" else (1, 0, run))
    return out


def natural(value: Column) -> Column:
    """An array of structs that orders as the value does naturally.

    A digit run is its length without leading zeros, then its text, so that no number is too long.
    """
    runs = F.regexp_extract_all(value, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def one(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+(?=[0-9])", "")
        digits = x.rlike("^[0-9]")
        return F.struct(
            F.when(digits, 0).otherwise(1).alias("kind"),
            F.when(digits, F.length(bare)).otherwise(0).alias("size"),
            F.when(digits, bare).otherwise(x).alias("text"),
        )

    return F.transform(runs, one)

"""Ordered bands: the first condition that holds gives the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bands(steps: list[tuple[Column, float, str]], score: float, reason: str) -> tuple[Column, Column]:
    """The score (double) and the reason of the first step that holds, else the last two arguments.

    Two columns, so that a query which needs the score only carries no texts.
    """
    s, r = F.lit(float(score)), F.lit(reason)
    for cond, x, y in reversed(steps):
        s, r = F.when(cond, F.lit(float(x))).otherwise(s), F.when(cond, F.lit(y)).otherwise(r)
    return s, r


def first_of(steps: list[tuple[Column, object]], default) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(default)
    for cond, v in reversed(steps):
        out = F.when(cond, F.lit(v)).otherwise(out)
    return out


def messages(steps: list[tuple[Column, Column]]) -> Column:
    """The texts of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, m) for c, m in steps]))

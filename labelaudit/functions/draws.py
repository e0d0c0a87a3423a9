"""Repeatable random draws.

A draw depends on (seed, tag, id) only, never on row order or partitioning, and
any SQL engine with md5 can repeat it."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

_STEPS = float(1 << 52)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def draw(seed, *parts) -> Column:
    """Uniform in [0, 1): the first 52 bits of md5('seed|part|part...')."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in (seed, *parts)])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(_STEPS)


def normal_draw(seed, *parts) -> Column:
    """Standard normal, from two uniform draws (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - draw(seed, *parts, "r")))
    return radius * F.cos(2.0 * F.pi() * draw(seed, *parts, "a"))

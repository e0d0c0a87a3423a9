"""Array-of-double arithmetic."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .draws import draw, normal_draw


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalize(v) -> Column:
    """Unit vector; an all-zero vector stays as it is. The size is worked out once for a row, not for each place."""
    v = as_double(v)
    scaled = F.transform(F.array(norm(v)), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v))
    return scaled[0]


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def argmax(p) -> Column:
    """Index of the first largest value."""
    return (F.array_position(_col(p), F.array_max(_col(p))) - 1).cast("int")


def threshold(p, t: float = 0.5) -> Column:
    return (_col(p) >= t).cast("int")


def entropy(p) -> Column:
    return -total(F.transform(as_double(p), lambda x: x * F.log(x + 1e-12)))


def zscore(v, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + 1e-8), place by place."""
    centred = F.zip_with(as_double(v), mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / (s + 1e-8))


def jitter(v, seed, view, key: Column, drop: float = 0.15, spread: float = 0.05) -> Column:
    """A vector view: each value zeroed with chance `drop`, plus normal noise."""
    return F.transform(as_double(v), lambda x, i: (
        F.when(draw(seed, "drop", view, key, i) < drop, F.lit(0.0)).otherwise(x)
        + spread * normal_draw(seed, "noise", view, key, i)))

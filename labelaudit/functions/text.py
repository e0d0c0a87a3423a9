"""Text helpers: slug, name keys, datetime text, report cuts."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def slug(name) -> Column:
    """Lower-case words joined by '-'; 'unknown' if nothing is left."""
    dashed = F.regexp_replace(F.lower(F.trim(F.col(name) if isinstance(name, str) else name)),
                              "[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(bare == "", F.lit("unknown")).otherwise(bare)


def name_key(name) -> Column:
    return F.lower(F.trim(name))


def datetime_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def count_char(text, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def cut(text, n: int) -> Column:
    """The first n characters, for report fields only."""
    return F.substring(text, 1, n)

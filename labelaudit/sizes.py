"""Size checks: what may be broadcast, and how hot keys are set apart."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SMALL_ROWS = 10_000          # rows of a table that may be broadcast
HOT_SHARE = 64               # a key is hot above 1/64 of all rows


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """`df` as a broadcast table if it has at most `limit` rows, else unchanged
    (Spark then joins it by shuffle). Never reads more than `limit` + 1 rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def class_counts(df: DataFrame, label: str = "y", limit: int = SMALL_ROWS) -> dict:
    """{class: rows}, in class order. Labels with more than `limit` values are
    not class labels and raise."""
    rows = df.groupBy(label).count().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"column {label!r} has more than {limit} classes")
    return {r[0]: r[1] for r in sorted(rows, key=lambda r: r[0])}


def hot_values(df: DataFrame, column: str) -> list:
    """Values that more than 1/64 of the rows share: fewer than 64, whatever the
    data. Counted with partial sums, so a hot value costs nothing here."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.select(F.count("*").alias("n")).scalar()
    return [r[0] for r in counts.where(F.col("n") * HOT_SHARE > total).select(column).collect()]


def join_split(rows: DataFrame, lookup: DataFrame, on: list[str], column: str) -> DataFrame:
    """Inner join to a `lookup` unique on the keys. Rows with a hot value in
    `column` (one of the keys) meet a broadcast of those few; the rest is shuffled."""
    hot = hot_values(rows, column)
    if not hot:
        return rows.join(lookup, on)
    is_hot = F.col(column).isin(hot)
    return rows.where(is_hot).join(small_table(lookup.where(is_hot)), on).unionByName(
        rows.where(~is_hot).join(lookup.where(~is_hot), on))


def join_hot(rows: DataFrame, lookup: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """Inner join of `rows` to a `lookup` that is unique on `on` and knows in
    `count` how many rows each key has.

    Keys with more than 1/64 of all rows are joined by broadcast: there are
    fewer than 64 of them, whatever the data. The rest is shuffled."""
    hot = F.col(count) * HOT_SHARE > total
    hot_side = F.broadcast(lookup.where(hot)).drop(count)
    cold_side = lookup.where(~hot).drop(count)
    keys = F.broadcast(lookup.where(hot).select(on))
    return rows.join(hot_side, on).unionByName(
        rows.join(keys, on, "left_anti").join(cold_side, on))

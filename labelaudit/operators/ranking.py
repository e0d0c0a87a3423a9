"""Exact global ranks, cuts, running sums and medians without a one-task window.

A window over a whole class would put that class in one task. Ranks and sums come
from ranges of rows (`running`). For cuts the draw is bucketed: a small table of
counts per (group, bucket) finds the bucket of the cut, and only its rows are sorted.
A median is found bit by bit from counts."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .running import running

BUCKETS = 1 << 14


def draw_bucket(u: Column) -> Column:
    """Bucket of a uniform draw; hash draws fill the buckets evenly."""
    return F.floor(u * BUCKETS).cast("int")


def _bucket_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bucket, before, upto): rows before and up to each bucket."""
    counts = df.groupBy(*keys, draw_bucket(F.col("u")).alias("bucket")).count()
    order = Window.partitionBy(*keys).orderBy("bucket")
    return (counts.withColumn("upto", F.sum("count").over(order))
            .withColumn("before", F.col("upto") - F.col("count")).drop("count"))


def quota_cuts(df: DataFrame, keys: Sequence[str], quotas: DataFrame,
               id_col: str = "id") -> DataFrame:
    """The (u, id) of the last row inside each quota.

    `df` has the keys, the draw `u` and an id. `quotas` is a small table of the
    keys, a `quota`, and any further columns (one ranking can serve many quotas).
    The result has at most one row per quota: cut_u and cut_id."""
    extra = [c for c in quotas.columns if c not in (*keys, "quota")]
    quotas = F.broadcast(quotas)
    edge = (_bucket_counts(df, keys).join(quotas, list(keys))
            .where((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("upto")))
            .select(*keys, *extra, "bucket", (F.col("quota") - F.col("before")).alias("need")))
    pool = (df.select(*keys, "u", id_col, draw_bucket(F.col("u")).alias("bucket"))
            .join(F.broadcast(edge), [*keys, "bucket"]))
    order = Window.partitionBy(*keys, *extra).orderBy("u", id_col)
    return (pool.withColumn("rn", F.row_number().over(order))
            .where(F.col("rn") == F.col("need"))
            .select(*keys, *extra, F.col("u").alias("cut_u"), F.col(id_col).alias("cut_id")))


def inside_cut(id_col: str = "id") -> Column:
    """True for rows at or before their cut; false where a quota is empty."""
    return F.coalesce((F.col("u") < F.col("cut_u")) |
                      ((F.col("u") == F.col("cut_u")) & (F.col(id_col) <= F.col("cut_id"))),
                      F.lit(False))


def rank_within(df: DataFrame, keys: Sequence[str], out: str = "pos",
                id_col: str = "id") -> DataFrame:
    """Zero-based exact rank by (u, id) within the keys."""
    return running(df, keys, ["u", id_col]).withColumnRenamed("_at", out)


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """Adds `<c>_upto` for each long column: its sum over rows of the group with an
    order value at or below the row's. `df` holds one row per (keys, order); a NaN
    is above all numbers, a null below."""
    return running(df, keys, [order], sums).drop("_at")


def _digits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    bits = (x + 0.0).view("uint64")
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _value(digits: int) -> float:
    bits = digits ^ (1 << 63) if digits >> 63 else digits ^ ((1 << 64) - 1)
    return float(np.array([bits], "uint64").view("float64")[0])


def exact_median(df: DataFrame, column: str) -> float:
    """The median as numpy gives it (mean of the two middle values), NaN and null
    aside; NaN without rows.

    Four passes, each of which counts the next 16 bits of the values that begin
    like a middle value: at most 2 * 65536 counts a pass, whatever the values."""
    x = F.col(column).cast("double")
    data = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    found: list[int] = []
    ranks: list[int] = []
    for step in range(4):
        shift, known = 48 - 16 * step, sorted(set(found))

        def count(batches, shift=shift, known=known):
            for batch in batches:
                bits = _digits(batch.column(0).to_numpy(zero_copy_only=False))
                if known:
                    bits = bits[np.isin(bits >> np.uint64(shift + 16), np.array(known, "uint64"))]
                prefix, n = np.unique(bits >> np.uint64(shift), return_counts=True)
                yield pa.record_batch({"prefix": prefix.view("int64"), "n": n})

        rows = data.mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n")).collect()
        counts = sorted((p % (1 << 64), n) for p, n in rows)
        if step == 0:
            total = sum(n for _, n in counts)
            if total == 0:
                return float("nan")
            found, ranks = [0, 0], [(total - 1) // 2, total // 2]
        for i, rank in enumerate(ranks):
            for prefix, n in counts:
                if step and prefix >> 16 != found[i]:
                    continue
                if rank < n:
                    found[i], ranks[i] = prefix, rank
                    break
                rank -= n
    return (_value(found[0]) + _value(found[1])) / 2


def medians(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(keys, median) by the same rule for any number of groups: equal values
    become one row, whose running count says whether it holds a middle place."""
    x = F.col(column).cast("double")
    data = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, (x + 0.0).alias("x")).agg(F.count("*").alias("n"))
    run = stored(running_sums(data, keys, "x", ["n"]), "counts")
    total = run.groupBy(*keys).agg(F.max("n_upto").alias("total"))
    places = F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))).alias("place")
    middle = run.join(total, list(keys)).select(*keys, "x", "n", "n_upto", places)
    return (middle.where((F.col("n_upto") - F.col("n") <= F.col("place")) & (F.col("place") < F.col("n_upto")))
            .groupBy(*keys).agg((F.sum("x") / 2).alias("median")))


def top_k(df: DataFrame, keys: Sequence[str], score: str, k: int, id_col: str = "id") -> DataFrame:
    """The k highest scores per group with `rank` from 1; ties by id. Spark trims
    each map task to k rows per group before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

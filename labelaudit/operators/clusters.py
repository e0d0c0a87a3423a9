"""Cluster quality from one small contingency table."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import stored


def contingency(df: DataFrame, cluster: str = "cluster", label: str = "y",
                by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, label, n): the only pass over the rows."""
    return df.groupBy(*by, cluster, label).agg(F.count("*").alias("n"))


def _pairs(n):
    n = n.cast("double")
    return n * (n - 1) / 2


def _margins(table: DataFrame, column: str, by):
    return table.groupBy(*by, column).agg(F.sum("n").alias("m"))


def _with_group(table: DataFrame, by):
    return (table, list(by)) if by else (table.withColumn("all_rows", F.lit(1)), ["all_rows"])


def adjusted_rand(table: DataFrame, cluster: str = "cluster", label: str = "y",
                  by: Sequence[str] = ()) -> DataFrame:
    """(by, ari) of a contingency table; 1 where both sides are trivial."""
    table, keys = _with_group(table, by)
    both = table.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("same"), F.sum("n").alias("total"))
    rows = _margins(table, cluster, keys).groupBy(*keys).agg(F.sum(_pairs(F.col("m"))).alias("a"))
    cols = _margins(table, label, keys).groupBy(*keys).agg(F.sum(_pairs(F.col("m"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    expected = F.when(_pairs(F.col("total")) > 0, a * b / _pairs(F.col("total"))).otherwise(0.0)
    top, low = F.col("same") - expected, (a + b) / 2 - expected
    return both.join(rows, keys).join(cols, keys).select(
        *by, F.when(low == 0, 1.0).otherwise(top / F.when(low != 0, low)).alias("ari"))


def normalized_mutual_info(table: DataFrame, cluster: str = "cluster", label: str = "y",
                           by: Sequence[str] = ()) -> DataFrame:
    """(by, nmi): mutual information over the mean of the two entropies; 1 where
    both sides have one group."""
    table, keys = _with_group(table, by)
    total = table.groupBy(*keys).agg(F.sum("n").alias("total"))
    rows = _margins(table, cluster, keys).withColumnRenamed("m", "a")
    cols = _margins(table, label, keys).withColumnRenamed("m", "b")
    n, t = F.col("n"), F.col("total")
    mi = table.join(rows, [*keys, cluster]).join(cols, [*keys, label]).join(total, keys).groupBy(*keys).agg(
        F.sum(n / t * F.log(n * t / (F.col("a").cast("double") * F.col("b")))).alias("mi"),
        F.count_distinct(cluster).alias("clusters"), F.count_distinct(label).alias("classes"))

    def entropy(margin, column, name):
        share = F.col(column) / F.col("total")
        return margin.join(total, keys).groupBy(*keys).agg((-F.sum(share * F.log(share))).alias(name))
    out = mi.join(entropy(rows, "a", "ha"), keys).join(entropy(cols, "b", "hb"), keys)
    mean = (F.col("ha") + F.col("hb")) / 2
    value = (F.when((F.col("clusters") == 1) & (F.col("classes") == 1), 1.0)
             .when((mean <= 0) | (F.col("mi") <= 2.220446049250313e-16), 0.0)
             .otherwise(F.col("mi") / F.when(mean > 0, mean)))
    return out.select(*by, value.alias("nmi"))


def _best_matching(gain: np.ndarray) -> float:
    """Largest total of a one-to-one matching of rows and columns: a shortest augmenting path
    per row, under prices that keep every matched cell tight."""
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    rows, columns = gain.shape
    price_row, price_column = np.zeros(rows), np.zeros(columns)
    partner = np.full(columns, -1)                    # the row a column is matched to
    for start in range(rows):
        reach, via = np.full(columns, np.inf), np.full(columns, -1)
        done, row, last, far = np.zeros(columns, bool), start, -1, 0.0
        visited = [start]
        while True:
            step = far - gain[row] - price_row[row] - price_column
            closer = ~done & (step < reach)
            reach[closer], via[closer] = step[closer], last
            last = int(np.argmin(np.where(done, np.inf, reach)))
            far = reach[last]
            done[last] = True
            if partner[last] < 0:
                break
            row = int(partner[last])
            visited.append(row)
        settled = done.copy()
        settled[last] = False
        price_row[start] += far
        price_row[partner[settled]] += far - reach[settled]
        price_column[settled] -= far - reach[settled]
        while last >= 0:                              # turn the path round
            before = via[last]
            partner[last] = start if before < 0 else partner[before]
            last = before
    matched = np.flatnonzero(partner >= 0)
    return float(gain[partner[matched], matched].sum())


def cluster_accuracy(table: DataFrame, cluster: str = "cluster", label: str = "y",
                     by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster_acc): accuracy under the best one-to-one matching of clusters
    and classes, of any number and any names. A group's counts are matched in one task."""
    table, keys = _with_group(table, by)

    def match(group: pd.DataFrame) -> pd.DataFrame:   # one row per (cluster, label)
        row, clusters = pd.factorize(group[cluster], use_na_sentinel=False)
        column, labels = pd.factorize(group[label], use_na_sentinel=False)
        gain = np.zeros((len(clusters), len(labels)))
        gain[row, column] = group["n"]
        return group[keys].head(1).assign(cluster_acc=_best_matching(gain) / group["n"].sum())

    kinds = ", ".join(f"{k} {table.schema[k].dataType.simpleString()}" for k in keys)
    return table.groupBy(*keys).applyInPandas(match, f"{kinds}, cluster_acc double").select(
        *by, "cluster_acc")


def cluster_sizes(table: DataFrame, cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """(by, cluster, size, fraction)."""
    table, keys = _with_group(table, by)
    sizes = _margins(table, cluster, keys).withColumnRenamed("m", "size")
    total = sizes.groupBy(*keys).agg(F.sum("size").alias("total"))
    return sizes.join(total, keys).select(
        *by, cluster, "size", (F.col("size") / F.col("total")).alias("fraction"))


def cluster_distribution(table: DataFrame, cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """(by, entropy, n_nonempty) of the cluster sizes."""
    share = F.col("fraction")
    return cluster_sizes(table, cluster, by).groupBy(*by).agg(
        (-F.sum(share * F.log(share + 1e-12))).alias("entropy"), F.count("*").alias("n_nonempty"))


def clustering_metrics(df: DataFrame, cluster: str = "cluster", label: str = "y",
                       by: Sequence[str] = ()) -> DataFrame:
    """(by, ari, nmi, cluster_acc, entropy, n_nonempty) from one contingency table,
    which is kept so that the rows are read once."""
    table, keys = _with_group(contingency(df, cluster, label, by), by)
    table = stored(table, "contingency")
    out = adjusted_rand(table, cluster, label, keys)
    for part in (normalized_mutual_info(table, cluster, label, keys),
                 cluster_accuracy(table, cluster, label, keys),
                 cluster_distribution(table, cluster, keys)):
        out = out.join(part, keys)
    return out if by else out.drop("all_rows")

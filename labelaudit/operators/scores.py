"""Suspicion scores: higher is more doubtful; none is a probability of noise."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import as_double, distance, entropy
from ..sizes import class_counts, small_table

# The scores an ensemble averages.
ENSEMBLE_MEMBERS = ("confident_learning", "knn_raw", "knn_cc", "cluster_entropy",
                    "view_instability", "centroid_relative_distance")


def per_class_mean(df: DataFrame, label: str = "y", proba: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by, label, threshold): mean P(class) over the rows given that class."""
    return df.groupBy(*by, label).agg(
        F.avg(F.element_at(proba, F.col(label) + 1)).alias("threshold"))


def confident_learning(df: DataFrame, label: str = "y", proba: str = "p",
                       by: Sequence[str] = ()) -> DataFrame:
    """Adds `score` = largest P - P(given label) and `flag`: the likeliest class
    among those at or above their threshold is not the given one.

    Classes are 0..n-1, places of the probability array."""
    n_classes = len(class_counts(df, label))
    means = per_class_mean(df, label, proba, by)
    limits = means.groupBy(*by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(label, "threshold"))), lambda e: e["threshold"]).alias("limits"))
    if by:
        df = df.join(small_table(limits), list(by))
    else:
        df = df.withColumn("limits", limits.scalar())
    p = F.slice(proba, 1, n_classes)
    eligible = F.zip_with(p, "limits", lambda x, t: F.when(x >= t, x).otherwise(-1.0))
    best = F.col("eligible_max")
    return (df.withColumn("eligible", eligible).withColumn("eligible_max", F.array_max("eligible"))
            .withColumn("score", F.array_max(proba) - F.element_at(proba, F.col(label) + 1))
            .withColumn("flag", (best >= 0) & (F.array_position("eligible", best) - 1 != F.col(label)))
            .drop("limits", "eligible", "eligible_max"))


def cluster_entropy(proba) -> Column:
    """Entropy of the cluster probabilities."""
    return entropy(proba)


def cluster_label_mismatch(df: DataFrame, cluster: str = "cluster", label: str = "y",
                           by: Sequence[str] = ()) -> DataFrame:
    """Adds `score`: 1 - share of the row's cluster that has its label. Counted by
    (cluster, label) first; the join back is to that small table."""
    pairs = df.groupBy(*by, cluster, label).agg(F.count("*").alias("same"))
    sizes = pairs.groupBy(*by, cluster).agg(F.sum("same").alias("size"))
    share = pairs.join(sizes, [*by, cluster]).select(
        *by, cluster, label, (1.0 - F.col("same") / F.col("size")).alias("score"))
    return df.join(small_table(share), [*by, cluster, label])


def centroids(df: DataFrame, vec: str = "v", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(by, label, centroid): mean vector per class, partial sums on each task."""
    return df.groupBy(*by, label).agg(
        Summarizer.mean(array_to_vector(as_double(vec))).alias("m")).select(
        *by, label, vector_to_array("m").alias("centroid"))


def centroid_distances(df: DataFrame, vec: str = "v", label: str = "y",
                       by: Sequence[str] = ()) -> DataFrame:
    """Adds own_distance, opposite_distance (nearest other class, own if there is
    none) and relative_distance = own - opposite."""
    means = centroids(df, vec, label, by).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(label, "centroid"))).alias("centroids"))
    if by:
        df = df.join(small_table(means), list(by))
    else:
        df = df.withColumn("centroids", means.scalar())
    far = F.transform("centroids", lambda c: F.struct(
        c[label].alias("c"), distance(as_double(vec), c["centroid"]).alias("d")))
    own = F.filter("far", lambda e: e["c"] == F.col(label))[0]["d"]
    others = F.array_min(F.transform(F.filter("far", lambda e: e["c"] != F.col(label)), lambda e: e["d"]))
    return (df.withColumn("far", far).withColumn("own_distance", own)
            .withColumn("opposite_distance", F.coalesce(others, F.col("own_distance")))
            .withColumn("relative_distance", F.col("own_distance") - F.col("opposite_distance"))
            .drop("centroids", "far"))


def _bounds(df: DataFrame, scores: Sequence[str]) -> list[Column]:
    # NaN is skipped, as numpy's nanmin and nanmax do
    out = []
    for s in scores:
        seen = F.when(~F.isnan(s), F.col(s))
        out += [F.min(seen).alias(f"{s}_lo"), F.max(seen).alias(f"{s}_hi")]
    return out


def normalize01(df: DataFrame, scores: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Replaces each score by its min-max value in [0, 1]; a flat score, or one
    with an infinite bound, becomes 0. All bounds come from one aggregate."""
    if by:
        df = df.join(small_table(df.groupBy(*by).agg(*_bounds(df, scores))), list(by))
        lo, hi = (lambda s: F.col(f"{s}_lo")), (lambda s: F.col(f"{s}_hi"))
    else:
        row = df.agg(F.struct(*_bounds(df, scores)).alias("b"))
        df = df.withColumn("bounds", row.scalar())
        lo, hi = (lambda s: F.col("bounds")[f"{s}_lo"]), (lambda s: F.col("bounds")[f"{s}_hi"])
    inf = float("inf")
    scaled = {}
    for s in scores:
        span = hi(s) - lo(s)
        usable = (lo(s) > -inf) & (hi(s) < inf) & (span >= 1e-12)
        scaled[s] = F.when(usable, (F.col(s) - lo(s)) / span).otherwise(0.0)
    out = df.withColumns(scaled).drop("bounds")
    return out.drop(*[f"{s}_{e}" for s in scores for e in ("lo", "hi")]) if by else out


def ensemble(df: DataFrame, scores: Sequence[str] = ENSEMBLE_MEMBERS,
             weights: Sequence[float] | None = None, by: Sequence[str] = (),
             out: str = "ensemble") -> DataFrame:
    """Adds the (weighted) mean of the min-max scores."""
    weights = list(weights) if weights is not None else [1.0] * len(scores)
    total = float(sum(weights))
    copies = df.withColumns({f"{s}_01": F.col(s).cast("double") for s in scores})
    scaled = normalize01(copies, [f"{s}_01" for s in scores], by)
    parts = [F.col(f"{s}_01") * (w / total) for s, w in zip(scores, weights)]
    mean = parts[0]
    for part in parts[1:]:
        mean = mean + part
    return scaled.withColumn(out, mean).drop(*[f"{s}_01" for s in scores])


def view_instability(views: DataFrame, proba: str = "p", id_col: str = "id") -> DataFrame:
    """(id, score): variance over the views of each cluster probability, averaged
    over the clusters. `views` has one row per (id, view)."""
    long = views.select(id_col, F.posexplode(proba).alias("cluster", "x"))
    spread = long.groupBy(id_col, "cluster").agg(F.var_pop("x").alias("var"))
    return spread.groupBy(id_col).agg(F.avg("var").alias("score"))

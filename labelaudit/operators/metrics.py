"""Ranking and classification metrics, exact, with any number of group columns.

One plan grades a whole grid of (score, rate, seed): groups are columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sizes import small_table
from .ranking import running_sums, top_k

NAN = float("nan")


def _grouped(df: DataFrame, by: Sequence[str]):
    """A group column is always there, so the plans need one form only."""
    return (df, list(by)) if by else (df.withColumn("all_rows", F.lit(1)), ["all_rows"])


def _tally(df: DataFrame, keys, score: str, positive: str) -> DataFrame:
    """Positives and negatives per distinct score: a hot score is one row."""
    hit = F.col(positive).cast("int")
    return df.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.sum(hit).cast("long").alias("pos"), F.sum(1 - hit).cast("long").alias("neg"))


def area_metrics(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc (ties count half), auprc (average precision over distinct scores)
    and the class totals, one row per group. NaN where one class is missing. A NaN
    score ranks above all numbers, a null one below."""
    df, keys = _grouped(df, by)
    run = running_sums(_tally(df, keys, score, positive), keys, "s", ["pos", "neg"])
    totals = run.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    run = run.join(small_table(totals), keys)
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    above = F.col("p") - F.col("pos_upto") + F.col("pos")
    below_neg = F.col("n") - F.col("neg_upto") + F.col("neg")
    out = run.groupBy(*keys).agg(
        F.sum(wins).alias("wins"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * above / (above + below_neg))
              .otherwise(0.0)).alias("gain"),
        F.max("p").alias("p"), F.max("n").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(
        *[c for c in keys if c in by], F.col("p").alias("positives"), F.col("n").alias("negatives"),
        F.when(both, F.col("wins") / (F.col("p").cast("double") * F.col("n")))
        .otherwise(NAN).alias("roc_auc"),
        F.when(both, F.col("gain") / F.col("p")).otherwise(NAN).alias("auprc"))


def at_k_metrics(df: DataFrame, score: str, positive: str, ks: Sequence[int] = (50, 100, 200),
                 by: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """precision_at_<k> and recall_at_<k> per group; k is capped at the group's
    rows, k <= 0 gives 0, no positives give recall 0. Ties by id."""
    df, keys = _grouped(df, by)
    hit = F.col(positive).cast("int")
    totals = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(hit).alias("hits"))
    best = top_k(df.select(*keys, score, id_col, hit.alias("hit")), keys, score,
                 max([*ks, 1]), id_col)
    taken = best.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"top_{i}")
        for i, k in enumerate(ks)])
    out = totals.join(taken, keys)
    cols = []
    for i, k in enumerate(ks):
        size = F.least(F.lit(k), F.col("rows"))
        cols.append(F.when(size > 0, F.col(f"top_{i}") / size).otherwise(0.0)
                    .alias(f"precision_at_{k}"))
        cols.append(F.when(F.col("hits") > 0, F.col(f"top_{i}") / F.col("hits")).otherwise(0.0)
                    .alias(f"recall_at_{k}"))
    return out.select(*[c for c in keys if c in by], *cols)


def noise_detection_metrics(df: DataFrame, score: str = "score", mask: str = "mask",
                            ks: Sequence[int] = (50, 100, 200), by: Sequence[str] = (),
                            id_col: str = "id") -> DataFrame:
    """How well a score ranks the known flips: areas, base rate, top-k."""
    work, keys = _grouped(df, by)
    area = area_metrics(work, score, mask, keys)
    base = F.col("positives") / (F.col("positives") + F.col("negatives"))
    tops = at_k_metrics(work, score, mask, ks, keys, id_col)
    out = (area.withColumn("base_rate", base).drop("positives", "negatives").join(tops, keys))
    return out if by else out.drop("all_rows")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def classification_metrics(df: DataFrame, truth: str = "y", proba: str = "p",
                           threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """f1, auc, acc, precision and recall of P(class 1), one row per group."""
    work, keys = _grouped(df, by)
    pred = F.col(proba) >= threshold
    true = F.col(truth) == 1
    counts = work.groupBy(*keys).agg(
        F.count_if(pred & true).alias("tp"), F.count_if(pred & ~true).alias("fp"),
        F.count_if(~pred & true).alias("fn"), F.count_if(~pred & ~true).alias("tn"))
    hits = work.withColumn("is_one", true.cast("int"))
    auc = area_metrics(hits, proba, "is_one", keys).select(*keys, F.col("roc_auc").alias("auc"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.join(auc, keys).select(
        *by, _ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"), "auc",
        ((tp + tn) / (tp + fp + fn + tn)).alias("acc"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"))


def topk_overlap(df: DataFrame, score_a: str, score_b: str, k: int, id_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Intersection and Jaccard of the two top-k sets, a row per group."""
    def best(score):
        if by:
            return top_k(df.select(*by, id_col, score), by, score, k, id_col).select(*by, id_col)
        return df.orderBy(F.col(score).desc(), id_col).limit(k).select(id_col)
    return set_overlap(best(score_a), best(score_b), id_col, by)


def set_overlap(a: DataFrame, b: DataFrame, id_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Intersection and Jaccard of two id sets, a row per group that has an id."""
    key = [*by, id_col]
    both = a.select(*key, F.lit(1).alias("in_a")).join(b.select(*key, F.lit(1).alias("in_b")), key, "full")
    inter, union = F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()), F.count("*")
    cells = [inter.alias("intersection"), F.when(union > 0, inter / union).otherwise(0.0).alias("jaccard")]
    return both.groupBy(*by).agg(*cells) if by else both.agg(*cells)

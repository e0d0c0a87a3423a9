"""Report tables: balances, mean and std over seeds, pivots, histograms, audits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .metrics import set_overlap, topk_overlap


def _number(c: str):
    """A metric value with NaN read as missing."""
    return F.when(~F.isnan(c), F.col(c))


def anchor_agreement(df: DataFrame, flag: str, label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """How far the anchors reach and agree with the labels, per group."""
    hit, n = F.col(flag), F.count("*")
    fired = F.count_if(hit)
    return df.groupBy(*by).agg(
        n.alias("n"), (100.0 * fired / n).alias("coverage"),
        F.count_if(hit & (F.col(label) == 0)).alias("contradictions"),
        F.when(fired > 0, 100.0 * F.count_if(hit & (F.col(label) == 1)) / fired).alias("agreement"))


def flag_counts(df: DataFrame, flag: str, label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Flagged rows, their rate, and the flags of each class."""
    hit, n = F.col(flag), F.count("*")
    return df.groupBy(*by).agg(
        n.alias("n"), F.count_if(hit).alias("flagged"), (F.count_if(hit) / n).alias("rate"),
        F.count_if(hit & (F.col(label) == 1)).alias("flagged_bot"),
        F.count_if(hit & (F.col(label) == 0)).alias("flagged_human"))


def balance_sheet(df: DataFrame, label: str = "y", split: str = "split",
                  features: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows and class counts per split, and the feature width."""
    extra = [F.max(F.size(features)).alias("feature_dim")] if features else []
    return df.groupBy(*by, split).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("human"),
        F.count_if(F.col(label) == 1).alias("bot"), *extra)


def mean_std(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population std of a long metric table; NaN is skipped."""
    v = _number(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def metric_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str],
                   std_of: Sequence[str] = ("roc_auc",), places: int = 4) -> DataFrame:
    """`<m>_mean` (and `<m>_std`) of wide metric columns, NaN skipped, rounded."""
    cols = []
    for m in metrics:
        cols.append(F.round(F.avg(_number(m)), places).alias(f"{m}_mean"))
        if m in std_of:
            cols.append(F.round(F.stddev_pop(_number(m)), places).alias(f"{m}_std"))
    return df.groupBy(*by).agg(*cols)


def noise_summary(df: DataFrame, ks: Sequence[int] = (100,)) -> DataFrame:
    """One row per (score, rate) over the seeds."""
    return metric_summary(df, ["score", "rate"],
                          ["roc_auc", "auprc", *[f"precision_at_{k}" for k in ks]])


def knn_summary(df: DataFrame) -> DataFrame:
    """One row per KNN variant over the seeds."""
    return metric_summary(df, ["variant"], ["roc_auc", "auprc"])


def metric_pivot(df: DataFrame, row: str, column: str, values: Sequence, metric: str = "roc_auc",
                 spread: bool = False) -> DataFrame:
    """Mean of a metric: one row per `row`, one column per listed value. With
    `spread` also the sample std."""
    out = df.groupBy(row).pivot(column, list(values))
    v = _number(metric)
    return out.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")) if spread else out.agg(F.avg(v))


def histogram(df: DataFrame, score: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, left, n): equal-width bins over the range of all rows, the last
    one closed; empty bins have no row."""
    bounds = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("b"))
    row = df.select(*by, F.col(score).alias("s")).withColumn("b", bounds.scalar())
    width = (F.col("b.hi") - F.col("b.lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("s") - F.col("b.lo")) / width),
                                      F.lit(bins - 1))).otherwise(0).cast("int")
    return row.select(*by, place.alias("bin"), (F.col("b.lo") + place * width).alias("left")).groupBy(
        *by, "bin", "left").agg(F.count("*").alias("n"))


def top_suspects(df: DataFrame, score: str = "ensemble", n: int = 100, id_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The n rows of highest score (of each group) with `rank` from 1 (Spark keeps n per task)."""
    if by:
        from .ranking import top_k
        return top_k(df, by, score, n, id_col)
    best = df.orderBy(F.col(score).desc(), id_col).limit(n)
    packed = best.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col(score)).alias("o"), F.col(id_col).alias("i"), F.struct(*df.columns).alias("row")))).alias("a"))
    return packed.select(F.posexplode("a").alias("pos", "e")).select(
        (F.col("pos") + 1).alias("rank"), "e.row.*")


def gold_candidates(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Flagged rows by suspicion, for review by hand. Needs y, p array, score,
    flag, user_agent and has_template."""
    name = F.when(F.col("y") == 1, "bots").otherwise("unsafe")
    return df.where("flag").orderBy(F.col("score").desc(), id_col).select(
        F.col(id_col).alias("index"), name.alias("given_label"), F.round(F.col("p")[0], 3).alias("p_human"),
        F.round(F.col("p")[1], 3).alias("p_bot"), F.round("score", 3).alias("suspicion"),
        F.substring("user_agent", 1, 70).alias("user_agent"), "has_template")


def unsafe_audit(df: DataFrame, by: str = "source", score: str = "ensemble", k: int = 100,
                 first: int = 10, id_col: str = "id") -> DataFrame:
    """Per source: class sizes, label-0 rows among the k most suspicious, label-0
    flags, and the ids of the first label-0 suspects. Needs cl_flag and
    heuristic_bot_flag."""
    from .ranking import top_k
    human = F.col("y") == 0
    sizes = df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(human).alias("unsafe"), F.count_if(~human).alias("bot"),
        F.count_if(human & F.col("cl_flag")).alias("unsafe_cl_flags"),
        F.count_if(human & F.col("heuristic_bot_flag")).alias("unsafe_heuristic_flags"))
    slim = df.select(by, id_col, "y", score)
    in_top = top_k(slim, [by], score, k, id_col).groupBy(by).agg(F.count_if(human).alias("top_unsafe"))
    ids = top_k(slim.where(human), [by], score, first, id_col).groupBy(by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", F.col(id_col).cast("string").alias("i")))),
        lambda e: e["i"]).alias("top_unsafe_ids"))
    return sizes.join(in_top, by).join(ids, by, "left")


def overlap_report(df: DataFrame, k: int = 100, id_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """(by, pair, intersection, jaccard) of top-k sets, the last against all anchor
    rows. Needs knn_raw, knn_cc, confident_learning, ensemble and
    heuristic_bot_flag."""
    ensemble = top_suspects(df, "ensemble", k, id_col, by).select(*by, id_col)
    parts = {"knn_raw_vs_knn_cc": topk_overlap(df, "knn_raw", "knn_cc", k, id_col, by),
             "knn_cc_vs_confident_learning": topk_overlap(df, "knn_cc", "confident_learning", k, id_col, by),
             "ensemble_vs_heuristic": set_overlap(
                 ensemble, df.where("heuristic_bot_flag").select(*by, id_col), id_col, by)}
    out = None
    for name, part in parts.items():
        part = part.select(*by, F.lit(name).alias("pair"), "intersection", F.round("jaccard", 4).alias("jaccard"))
        out = part if out is None else out.unionByName(part)
    return out


def audit_flags(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rate of confident-learning flags, and of anchor rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("cl_flag").alias("confident_learning_flags"),
                               (F.count_if("cl_flag") / F.count("*")).alias("confident_learning_flag_rate"),
                               F.count_if("heuristic_bot_flag").alias("heuristic_bot_flags"))


def study_summary(metrics: DataFrame, noise: DataFrame, knn: DataFrame, audit: DataFrame) -> DataFrame:
    """One headline row per source.

    `metrics`: (source, method, metric, seed, value) of classifiers, clusterings
    and the probe; `noise`: (source, score, rate, seed, roc_auc); `knn`: (source,
    variant, seed, roc_auc); `audit`: (source, confident_learning_flag_rate,
    heuristic_bot_flags)."""
    # Method names of the tables.
    classifiers = ["LogReg", "RandomForest", "Triplet + probe", "SSL + probe"]
    table = mean_std(metrics, ["source", "method", "metric"])
    f1 = table.where((F.col("metric") == "f1") & F.col("method").isin(classifiers))
    best = f1.groupBy("source").agg(
        F.max_by("method", F.struct("mean", F.col("method"))).alias("best_method"), F.max("mean").alias("best_f1"))

    def one(method, metric):
        return F.max(F.when((F.col("method") == method) & (F.col("metric") == metric), F.col("mean")))
    heads = table.groupBy("source").agg(
        one("RandomForest", "f1").alias("rf_f1"), one("Embedding + probe", "f1").alias("probe_f1"),
        one("Soft clusters", "ari").alias("cluster_ari"),
        one("Soft clusters", "n_nonempty").alias("nonempty_clusters"))
    auc = _number("roc_auc")
    ens = noise.where("score = 'ensemble'").groupBy("source").agg(
        F.avg(auc).alias("ensemble_auc_mean"), F.stddev_pop(auc).alias("ensemble_auc_std"))
    raw = lambda name: F.when(F.col("variant") == name, auc)
    near = knn.groupBy("source").agg(
        F.avg(raw("KNN raw")).alias("knn_raw_auc_mean"), F.stddev_pop(raw("KNN raw")).alias("knn_raw_auc_std"),
        F.avg(raw("KNN CC")).alias("knn_cc_auc_mean"), F.stddev_pop(raw("KNN CC")).alias("knn_cc_auc_std"))
    return best.join(heads, "source").join(ens, "source", "left").join(near, "source", "left").join(
        audit.select("source", "confident_learning_flag_rate", "heuristic_bot_flags"), "source", "left")

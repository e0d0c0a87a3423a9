"""X1-X9 and Q11: whole jobs over the whole corpus, at smoke size of the models."""
from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.operators import reports as rp
from labelaudit.session import stored
from labelaudit.plans import audit as au, baselines as bl, noise as nz, scoring as scg, source_study as ss

from .q_knn import rounded
from .registry import register
from .views import corpus

SMOKE = scg.Settings(svd_dim=16, max_features=1000, embedding_dims=4, views=3, knn_k=15, trees=20,
                     max_depth=10, baseline_trees=30, restarts=3)
# for all sources at once: the fits of each are many small jobs
LIGHT = scg.Settings(svd_dim=8, max_features=500, embedding_dims=4, views=2, knn_k=15, folds=2, trees=10,
                     max_depth=5, baseline_trees=20, restarts=1)
SEEDS = (42, 7)
STUDY_RATES = (0.05, 0.10, 0.20)


def _rows(spark, sf):
    return stored(corpus(spark, sf), "corpus")


@register("score_table")
def _(spark, sf):
    rows = _rows(spark, sf)
    space = scg.fit_space(rows, SMOKE, 42)
    table = scg.score_table(space, rows.select("id", "y"))
    return rounded(table.select("id", "y", "cl_flag", *scg.SCORES), ["id", "y", "cl_flag"])


@register("baselines")
def _(spark, sf):
    long = bl.run_baselines(_rows(spark, sf), SEEDS, SMOKE)
    return rounded(rp.mean_std(long, ["method", "metric"]), ["method", "metric"])


@register("label_efficiency")
def _(spark, sf):
    long = bl.label_efficiency(_rows(spark, sf), (42,), (0.05, 0.25, 1.0), SMOKE)
    return rounded(rp.mean_std(long, ["method", "fraction", "metric"]), ["method", "fraction", "metric"])


@register("cluster_study")
def _(spark, sf):
    _, table = bl.cluster_study(_rows(spark, sf), 42, SMOKE)
    return rounded(table, ["part", "metric"])


@register("cluster_assignments")
def _(spark, sf):
    assigned, _ = bl.cluster_study(_rows(spark, sf), 42, SMOKE)
    return assigned.select("id", "split", "y", "cluster")


@register("synthetic_noise")
def _(spark, sf):
    graded = nz.synthetic_noise_study(_rows(spark, sf), seeds=(42,), settings=SMOKE)
    return rounded(graded, ["score", "rate", "seed"])


@register("knn_comparison")
def _(spark, sf):
    return rounded(nz.knn_study(_rows(spark, sf), SEEDS, settings=SMOKE), ["variant", "seed"])


@register("label_audit")
def _(spark, sf):
    return au.audit_labels(_rows(spark, sf), 42, SMOKE)


@register("audit_overlap")
def _(spark, sf):
    return au.audit_reports(au.audit_labels(_rows(spark, sf), 42, SMOKE))["overlap"]


@register("source_study")
def _(spark, sf):
    """One source, all seeds, rates and tables, as (table, row, column, value)."""
    study = ss.source_study(_rows(spark, sf), 7, seeds=SEEDS, rates=STUDY_RATES, settings=SMOKE)
    named = {
        "summary": study["summary"].drop("best_method"),
        "balance": study["balance"].drop("source"),
        "classification": study["classification"].select(F.concat_ws(" ", "method", "metric").alias("row"), "mean", "std"),
        "clustering": study["clustering"].select(F.concat_ws(" ", "method", "metric").alias("row"), "mean", "std"),
        "synthetic_noise": study["synthetic_noise"].select(F.concat_ws(" ", "score", "rate", "seed").alias("row"), "roc_auc", "auprc", "base_rate"),
        "knn_comparison": study["knn_comparison"].select(F.concat_ws(" ", "variant", "seed").alias("row"), "roc_auc"),
        "real_audit": study["real_audit"],
        "top_suspects": study["top_suspects"].select("rank", "id", "y", "ensemble", "confident_learning", "knn_cc"),
    }
    return rounded(ss.long_tables(named), ["table", "row", "column"])


@register("cross_source_tables")
def _(spark, sf):
    """All sources side by side: the five report tables as (table, row, column, value)."""
    rows = _rows(spark, sf)
    sources = [r[0] for r in rows.select("source").distinct().orderBy("source").collect()]
    study = ss.cross_source_study(rows, seeds=SEEDS[:1], rates=STUDY_RATES, settings=LIGHT)
    return rounded(ss.long_tables(ss.cross_source_tables(study, sources)), ["table", "row", "column"])


@register("feature_ablation")
def _(spark, sf):
    long = bl.ablation(_rows(spark, sf), 42, SMOKE, ("full", "canon_no_manual"))
    return rounded(long.where("method = 'RandomForest'").select("variant", "metric", "value"),
                   ["variant", "metric"])

"""The study of all traffic sources side by side: one grid, eight tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.heuristics import with_flags
from ..functions.text import cut
from ..operators import knn, reports as rp
from ..operators.clusters import clustering_metrics
from ..operators.metrics import classification_metrics, noise_detection_metrics
from ..session import stored
from ..sizes import SMALL_ROWS
from .baselines import CLASS_METRICS, CLUSTER_METRICS
from .grid import GROUP, REAL, fit_grid, grid_graphs, grid_scores
from .scoring import Settings, long_scores

# The scores this study grades, in table order.
STUDY_SCORES = ("confident_learning", "knn_raw", "knn_cc", "cluster_entropy", "view_instability",
                "centroid_relative_distance", "ensemble")
KNN_RATE = 0.10              # of the comparison of neighbour scores


def _long(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(*GROUP, "method", F.explode(pairs).alias("m")).select(*GROUP, "method", "m.metric", "m.value")


def cross_source_study(df: DataFrame, sources: Sequence | None = None, seeds=(42, 7), rates=(0.05, 0.10, 0.20),
                       settings: Settings = Settings(views=3), subsample: int | None = None, top: int = 100) -> dict[str, DataFrame]:
    """All tables of all sources (or those listed), each with a `source` column: summary, balance,
    classification, clustering, synthetic_noise, knn_comparison, real_audit, top_suspects.

    `df`: (source, id, y, headers, request). `subsample` is a class-balanced study size per source and
    seed; without it all rows are studied. Real labels are audited with the first seed."""
    if sources is not None:
        df = df.where(F.col("source").isin(list(sources)))
    rates = [float(r) for r in rates]
    wanted = rates if KNN_RATE in rates else [*rates, KNN_RATE]
    grid = fit_grid(df, seeds, wanted, settings, subsample, audit_seed=int(seeds[0]))
    graphs = grid_graphs(grid)
    table = stored(grid_scores(grid, graphs), "scores")
    by = [*GROUP, "rate"]

    graded = stored(grid.graded, "graded")
    classes = classification_metrics(graded.where("proba IS NOT NULL"), "y", "proba", by=[*GROUP, "method"])
    clusters = clustering_metrics(graded.where("cluster IS NOT NULL"), by=[*GROUP, "method"])
    long = stored(_long(classes, CLASS_METRICS).unionByName(_long(clusters, CLUSTER_METRICS)), "metrics")
    noisy = table.where((F.col("rate") > REAL) & F.col("rate").isin(rates))
    noise = noise_detection_metrics(long_scores(noisy, by, STUDY_SCORES), "score", "mask", (50, 100, 200), [*by, "score_name"])
    noise = stored(noise.withColumnRenamed("score_name", "score"), "noise")
    labels = stored(grid.labels.where(F.col("rate") == KNN_RATE).select(*GROUP, "id", "y", "mask"), "labels")
    near = None
    for name, graph in graphs.items():
        for variant, score in ((name, knn.knn_disagreement), (f"{name} (weighted)", knn.knn_weighted)):
            part = score(graph, labels, by=GROUP).withColumn("variant", F.lit(variant))
            near = part if near is None else near.unionByName(part)
    near = near.join(labels.select(*GROUP, "id", "mask"), [*GROUP, "id"])
    near = stored(noise_detection_metrics(near, "score", "mask", (100,), [*GROUP, "variant"]).select(*GROUP, "variant", "roc_auc"), "near")

    first = F.col("seed") == F.lit(int(seeds[0]))
    flags = with_flags(grid.rows.where(first).select("source", "id", "headers", "request")).drop("headers", "request")
    scored = stored(table.where(first & (F.col("rate") == REAL)).drop("seed", "rate").join(flags, ["source", "id"]), "scored")
    pairs = ("knn_raw_vs_knn_cc", "knn_cc_vs_confident_learning", "ensemble_vs_heuristic")
    overlaps = rp.overlap_report(scored, by=["source"]).groupBy("source").pivot("pair", list(pairs)).agg(F.first("intersection"))
    audit = stored(rp.audit_flags(scored, ["source"]).join(overlaps, "source", "left").fillna(0, list(pairs)), "audit")
    suspects = rp.top_suspects(scored, "ensemble", top, by=["source"]).select(
        "source", "rank", "id", "y", "ensemble", "confident_learning", "knn_cc", "has_template",
        "has_crawler_ua", "has_script_ua", cut("user_agent", 80).alias("user_agent"))
    by_method = rp.mean_std(long, ["source", "method", "metric"])
    clusterings = ("KMeans (raw)", "PCA + KMeans", "Soft clusters")
    balance = rp.balance_sheet(grid.rows.where(first), by=["source"]).withColumn("feature_dim", F.lit(settings.svd_dim + 4))
    return {
        "summary": rp.study_summary(long, noise, near, audit), "balance": balance,
        "classification": by_method.where(~F.col("method").isin(*clusterings)),
        "clustering": by_method.where(F.col("method").isin(*clusterings)),
        "synthetic_noise": noise, "knn_comparison": near,
        "real_audit": audit, "top_suspects": suspects,
    }


def source_study(df: DataFrame, source, **options) -> dict[str, DataFrame]:
    """All tables of one source."""
    return cross_source_study(df, [source], **options)


def cross_source_tables(study: dict[str, DataFrame], sources: Sequence) -> dict[str, DataFrame]:
    """Report tables: method x source F1, score x source and score x rate ROC-AUC,
    KNN variants x source, and the audit counts."""
    f1 = study["classification"].where("metric = 'f1'")
    rates = [r[0] for r in study["synthetic_noise"].select("rate").distinct().orderBy("rate").limit(SMALL_ROWS + 1).collect()]
    if len(rates) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} rates cannot be columns")
    return {
        "f1": rp.metric_pivot(f1, "method", "source", sources, "mean"),
        "noise_by_source": rp.metric_pivot(study["synthetic_noise"], "score", "source", sources),
        "noise_by_rate": rp.metric_pivot(study["synthetic_noise"], "score", "rate", rates),
        "knn_by_source": rp.metric_pivot(study["knn_comparison"], "variant", "source", sources),
        "audit": study["real_audit"].select("source", "confident_learning_flag_rate", "heuristic_bot_flags"),
    }


def long_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row, column, value) of report tables, whose first columns name the rows."""
    out = None
    for name, table in tables.items():
        row, *cells = table.columns
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in cells])
        part = table.select(F.lit(name).alias("table"), F.col(row).cast("string").alias("row"), F.explode(pairs).alias("c")).select(
            "table", "row", "c.column", "c.value")
        out = part if out is None else out.unionByName(part)
    return out

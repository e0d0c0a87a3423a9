"""Whole jobs at a tiny size: shapes, invariants and quality floors."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.views import corpus
from labelaudit.operators import knn
from labelaudit.operators.metrics import noise_detection_metrics
from labelaudit.operators.sampling import inject_label_noise
from labelaudit.plans import audit as au, baselines as bl, scoring as scg, source_study as ss
from labelaudit.session import stored
from labelaudit.sources import tables

TINY = scg.Settings(svd_dim=6, max_features=200, embedding_dims=3, views=2, knn_k=5, folds=2, trees=5,
                    max_depth=5, baseline_trees=5, restarts=1, clusters=3)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return stored(corpus(spark, sf).withColumn("source", F.col("source") % 2))


def test_neighbours_find_flips_in_blobs(spark):
    rng = np.random.default_rng(8)
    y = np.arange(400) % 2
    df = spark.createDataFrame(pd.DataFrame({
        "id": np.arange(400), "y": y, "v": list(rng.standard_normal((400, 8)) + 3.0 * (2 * y[:, None] - 1))}))
    noisy = stored(inject_label_noise(df, 0.1).select("id", F.col("y_noisy").alias("y"), "mask"))
    score = knn.knn_disagreement(knn.knn_graph(df, 10), noisy)
    assert noise_detection_metrics(noisy.join(score, "id")).first()["roc_auc"] > 0.95


def test_audit(rows):
    audit = stored(au.audit_labels(rows, 42, TINY))
    assert audit.columns == list(au.AUDIT_COLUMNS) and audit.count() == rows.count()
    assert audit.where("ensemble < 0 OR ensemble > 1 OR knn_raw < 0 OR knn_raw > 1").count() == 0
    reports = au.audit_reports(audit, tops=(7,), k=20)
    top = reports["top_7_suspects"].collect()
    assert [r["rank"] for r in top] == list(range(1, 8))
    assert [r["ensemble"] for r in top] == sorted((r["ensemble"] for r in top), reverse=True)
    assert reports["overlap"].where("intersection > 20 OR jaccard > 1").count() == 0
    assert reports["flags"].first()["n"] == audit.count()


def test_cross_source_study(spark, rows, tmp_path):
    study = ss.cross_source_study(rows, [0, 1], seeds=(42,), subsample=200, rates=(0.1, 0.2), settings=TINY)
    assert study["summary"].count() == 2
    assert study["synthetic_noise"].count() == 2 * 2 * len(ss.STUDY_SCORES)
    assert study["top_suspects"].groupBy("source").count().where("count <> 100").count() == 0
    balance = study["balance"].where("split = 'train'").collect()
    assert all(r["human"] == r["bot"] == 70 for r in balance)
    root = str(tmp_path / "study")
    tables.save_study({n: study[n] for n in tables.STUDY_TABLES}, root)
    assert tables.load_study(spark, root, "0")["summary"].count() == 1
    report = ss.cross_source_tables(study, [0, 1])
    assert set(report["noise_by_source"].columns) == {"score", "0", "1"}


def test_label_efficiency_and_clusters(rows):
    long = bl.label_efficiency(rows, (42,), (0.2, 1.0), TINY, ("logreg", "embedding_probe"))
    assert long.count() == 2 * 2 * len(bl.CLASS_METRICS)
    assert long.where("metric = 'auc' AND (value < 0 OR value > 1)").count() == 0
    assigned, table = bl.cluster_study(rows, 42, TINY)
    assert assigned.count() == rows.count() and assigned.select("id").distinct().count() == rows.count()
    assert {r["part"] for r in table.select("part").distinct().collect()} == {
        "clustering_train", "clustering_test", "representation_probe"}

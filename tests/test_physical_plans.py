"""What the plans must look like at scale."""
import re

import numpy as np
from pyspark.sql import functions as F

from checks.views import corpus, requests, texts
from labelaudit.operators import features as ft, ngrams as ng, sampling as sp, views as vw
from labelaudit.operators.ranking import top_k
from labelaudit.session import stored
from labelaudit.sources import requests as rq


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def saved_requests(spark, sf, tmp_path):
    path = str(tmp_path / "requests")
    requests(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(spark, sf, tmp_path, capsys):
    log = saved_requests(spark, sf, tmp_path)
    rq.fetch_by_source(log, 7, ["bot"], 10, "2024-01-02 00:00:00").select("id", "decision").explain("formatted")
    text = capsys.readouterr().out
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "traffic_source_id" in pushed and "datetime" in pushed and "decision" in pushed
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "headers" not in schema and "params" not in schema
    assert "TakeOrderedAndProject" in text


def test_newest_trims_before_the_shuffle(spark, sf, tmp_path):
    text = plan(rq.fetch_for_sources(saved_requests(spark, sf, tmp_path), [1, 2], None, 5))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_top_k_trims_before_the_shuffle(spark, sf):
    text = plan(top_k(corpus(spark, sf).select("id", "source", "y"), ["source"], "y", 5))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_terms_and_features_move_no_text(spark, sf, tmp_path):
    path = str(tmp_path / "texts")
    texts(spark, sf).write.parquet(path)
    t = spark.read.parquet(path)
    vocabulary = spark.createDataFrame([(0, "th"), (1, "he")], "idx int, gram string")
    pre = ft.Preprocessor(svd_dim=2, max_features=30, headers="text", request="text")
    pre.vocabulary, pre.idf, pre.components = ["th", "he"], np.ones(2), np.eye(2)
    pre.mean, pre.std = np.zeros(6), np.ones(6)
    for df in (ng.char_ngrams(t), ng.row_terms(t, vocabulary), pre.transform(t)):
        assert "Exchange" not in plan(df)


def test_flips_do_not_shuffle_the_rows(spark, sf, tmp_path):
    """The pass over the rows is one broadcast join with the cut."""
    path = str(tmp_path / "corpus")
    corpus(spark, sf).write.parquet(path)
    text = plan(sp.inject_label_noise(spark.read.parquet(path), 0.1))
    rows = text.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in rows and "headers" in rows
    assert "Exchange" not in rows and "Window" not in rows
    assert "headers" not in text.split("BroadcastExchange", 1)[1]


def test_views_are_projections(spark, sf, tmp_path):
    path = str(tmp_path / "corpus")
    corpus(spark, sf).write.parquet(path)
    text = plan(vw.view_pool(spark.read.parquet(path), 2))
    assert "Exchange" not in text and "Python" not in text


def test_packed_files_are_no_reason_to_broadcast(spark):
    """A label grid of 3 million rows lies in some MB of files and takes hundreds in memory."""
    labels = stored(spark.range(0, 120_000, 1, 1).selectExpr("id", "explode(sequence(1, 25)) AS rate", "id % 2 AS y"), "grid")
    graph = spark.range(0, 5_000_000, 1, 1).selectExpr("id", "id % 25 + 1 AS rate", "id AS nbr_id")
    assert "BroadcastHashJoin" not in plan(graph.join(labels, ["id", "rate"]))

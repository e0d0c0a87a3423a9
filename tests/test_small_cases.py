"""Hand-worked cases."""
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelaudit.functions import heuristics as hr, jsontext as js
from labelaudit.functions.draws import draw
from labelaudit.functions.text import slug
from labelaudit.operators import (clusters as cl, features as ft, metrics as mt, models as md, ngrams as ng,
                                  ranking as rk, sampling as sp, scores as sc, views as vw)
from labelaudit.operators.svd import svd_apply, svd_fit


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()["x"]


def labels(spark, zeros, ones):
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(zeros + ones), "y": [0] * zeros + [1] * ones}), "id long, y int")


@pytest.mark.parametrize("text, want", [
    (" Foo & Bar! ", "foo-bar"), ("--", "unknown"), ("", "unknown"), ("A_b  C", "a-b-c")])
def test_slug(spark, text, want):
    assert one(spark, slug("t"), t=text) == want


@pytest.mark.parametrize("text, want", [
    ('{"uSeR-aGeNt":"x"}', "x"), ("[1,2]", ""), ("not json", ""), ("{'User-Agent': 'y'}", "y"),
    ('{"user-agent":"b","User-Agent":"a"}', "a"), ('{"User-Agent":"a","User-Agent":"z"}', "z"), (None, "")])
def test_user_agent(spark, text, want):
    assert one(spark, js.user_agent("h"), h=text) == want


@pytest.mark.parametrize("text, want", [("{{cpc}}", True), ("{{cpc}", False), ("a{{b}}c", True), (None, False)])
def test_template(spark, text, want):
    assert one(spark, hr.has_template(F.col("r")), r=text) is want


def test_mask_versions(spark):
    assert one(spark, js.mask_versions(F.col("t")), t="Win64 Chrome/120.0.1 v2") == "Win64 Chrome/XXX.X.X v2"


@pytest.mark.parametrize("text, want", [
    ('{"b": 1, "a": {"d": 2, "c": "é"}}', '{"a":{"c":"é","d":2},"b":1}'), ("[1, 2]", "[1,2]"),
    ("not json", "not json")])
def test_canonical(spark, text, want):
    assert one(spark, js.canonical("t"), t=text) == want


def test_vary_case(spark):
    for pick, want in ((0.1, "accept-language"), (0.5, "ACCEPT-LANGUAGE"), (0.9, "Accept-Language")):
        assert one(spark, js.vary_case(F.col("k"), F.lit(pick)), k="aCCEPT-language") == want


def test_equal_keys_keep_the_last_value(spark):
    got = one(spark, vw.serialise(js.last_of_equal_keys(F.array(
        F.struct(F.lit("a").alias("key"), F.lit("1").alias("json")),
        F.struct(F.lit("b").alias("key"), F.lit("2").alias("json")),
        F.struct(F.lit("a").alias("key"), F.lit("3").alias("json")))), F.lit(False)), t="")
    assert got == '{"a":3,"b":2}'


def test_view_keeps_value_types_and_text(spark):
    cfg = {"order": False, "spacing": False}
    raw = '{"n":5,"s":"q\\"z","o":{"a":true}}'
    assert one(spark, vw.augment_headers(F.col("h"), cfg, 1, F.lit(1), F.lit(1)), h=raw) == raw
    assert one(spark, vw.augment_headers(F.col("h"), cfg, 1, F.lit(1), F.lit(1)), h="no json") == "no json"
    hide = {"template": 1}
    assert one(spark, vw.augment_request(F.col("r"), hide, 1, F.lit(1), F.lit(1)), r="x={{a}}") == "x=<MASK>"


def test_strong_view_drops_unstable_headers(spark):
    raw = json.dumps({"cf-ray": "1", "cookie": "2", "accept": "a"})
    got = one(spark, vw.augment_headers(F.col("h"), "strong_http_aug", 1, F.lit(1), F.lit(1)), h=raw)
    assert {k.lower(): v for k, v in json.loads(got).items()} == {"accept": "a"}


def test_unknown_names_raise(spark):
    with pytest.raises(KeyError):
        vw.chances("nope")
    with pytest.raises(ValueError):
        sp.inject_label_noise(labels(spark, 2, 2), 0.1, "nope")
    with pytest.raises(RuntimeError):
        ft.Preprocessor().transform(None)


@pytest.mark.parametrize("n", [20, 80])
def test_balanced_subsample(spark, n):
    got = sp.balanced_subsample(labels(spark, 90, 10), n).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 10, 1: 10}


def test_balanced_subsample_edges(spark):
    with pytest.raises(ValueError):
        sp.balanced_subsample(labels(spark, 5, 5), 1)
    assert sp.balanced_subsample(labels(spark, 9, 0), 4).count() == 4
    assert sp.balanced_subsample(labels(spark, 9, 0), 40).count() == 9


def test_flip_count_is_half_even(spark):
    got = sp.inject_label_noise(labels(spark, 10, 15), 0.1)
    assert got.where("mask").count() == 2
    assert got.where("mask <> (y <> y_noisy)").count() == 0


def test_split_and_folds(spark):
    df = labels(spark, 70, 31)
    split = {(r["split"], r["y"]): r["count"] for r in sp.stratified_split(df).groupBy("split", "y").count().collect()}
    assert sum(n for (s, _), n in split.items() if s == "test") == math.ceil(0.3 * 101)
    folds = {r["fold"]: r["count"] for r in sp.stratified_folds(df).groupBy("fold").count().collect()}
    assert sorted(folds.values()) == [25, 25, 25, 26]


def test_same_on_any_partitioning(spark):
    df = labels(spark, 300, 200)
    def run(d):
        return sorted(map(tuple, sp.noise_grid(d, [0.1], [1, 2]).select("id", "seed", "mask").collect()))
    assert run(df.repartition(1)) == run(df.repartition(7, "y"))


def test_largest_remainder():
    assert sp.largest_remainder({0: 50, 1: 30, 2: 20}, 7) == {0: 4, 1: 2, 2: 1}


@pytest.mark.parametrize("n", [10, 20_000])
def test_areas_at_any_size(spark, n):
    """One plan for few and many scores; a score that a third of the rows share, a NaN
    (above all numbers), infinite ones."""
    rng = np.random.default_rng(1)
    s = np.round(rng.standard_normal(n), 5)
    s[rng.permutation(n)[:n // 3]] = 0.5
    s[1], s[2], s[4] = np.nan, np.inf, -np.inf
    m = rng.random(n) < 0.4
    m[[0, 1, 2]], m[[3, 4, 5]] = True, False
    rows = [(i, i % 3, float(x), bool(hit)) for i, (x, hit) in enumerate(zip(s, m))]     # pandas would make NaN a null
    df = spark.createDataFrame(rows, "id long, g long, s double, mask boolean").repartition(5)
    order = np.argsort(np.argsort(np.unique(s)))          # NaN comes last
    rank = order[np.searchsorted(np.unique(s), s)]
    for r in mt.area_metrics(df, "s", "mask", ["g"]).collect():
        own = np.arange(n) % 3 == r["g"]
        neg = np.sort(rank[own & ~m])
        wins = (np.searchsorted(neg, rank[own & m], "left") + np.searchsorted(neg, rank[own & m], "right")) / 2
        assert r["roc_auc"] == pytest.approx(wins.sum() / (len(neg) * (own & m).sum()))


MEDIANS = [[1.0], [2.0, 1.0], [1.5e308, -1.5e308] * 49 + [48.0, 49.0], [np.inf, -np.inf, 3.0], [np.inf] * 3 + [1.0],
           [-1.0, -2.0, -3.0, -4.0], [5e-324, 0.0, -5e-324, -0.0], [0.5] * 300 + list(range(100)), [np.nan, 1.0, 4.0]]


@pytest.mark.parametrize("case", range(len(MEDIANS)))
def test_median_is_numpys(spark, case):
    values = MEDIANS[case]
    df = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(3)
    assert rk.exact_median(df, "s") == np.nanmedian(values)


def test_medians_of_groups(spark):
    rows = [(g, float(v)) for g, values in enumerate(MEDIANS) for v in values] + [(99, None), (0, None)]
    df = spark.createDataFrame(rows, "g long, s double").repartition(3)
    got = {r["g"]: r["median"] for r in rk.medians(df, "s", ["g"]).collect()}
    assert got == {g: np.nanmedian(v) for g, v in enumerate(MEDIANS)}
    assert np.isnan(rk.exact_median(df.where("g = 99"), "s"))


def brute_auc(s, m):
    pos, neg = s[m], s[~m]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(2)
    s, m = np.round(rng.random(300), 1), rng.random(300) < 0.3
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "s": s, "mask": m}))
    assert mt.area_metrics(df, "s", "mask").first()["roc_auc"] == pytest.approx(brute_auc(s, m))


def test_metric_edges(spark):
    df = spark.createDataFrame([(i, 0.5, i % 2 == 0) for i in range(10)], "id int, score double, mask boolean")
    row = mt.noise_detection_metrics(df, ks=(0, 3, 50)).first()
    assert row["roc_auc"] == 0.5 and row["precision_at_0"] == 0 and row["recall_at_0"] == 0
    assert row["precision_at_3"] == pytest.approx(2 / 3) and row["precision_at_50"] == 0.5
    clean = mt.noise_detection_metrics(df.withColumn("mask", F.lit(False))).first()
    assert math.isnan(clean["roc_auc"]) and math.isnan(clean["auprc"])
    assert clean["base_rate"] == 0 and clean["recall_at_50"] == 0
    none = mt.classification_metrics(df.select("id", F.lit(1).alias("y"), F.lit(0.0).alias("p"))).first()
    assert none["f1"] == 0 and none["precision"] == 0 and none["recall"] == 0


def test_score_edges(spark):
    df = spark.createDataFrame([(1, 2.0, float("nan")), (2, 2.0, 1.0), (3, 2.0, 3.0)], "id int, a double, b double")
    got = sc.normalize01(df, ["a", "b"]).orderBy("id").collect()
    assert [r["a"] for r in got] == [0, 0, 0] and [r["b"] for r in got][1:] == [0, 1]
    v = spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [2.0, 1.0], 1)], "id int, v array<double>, y int")
    assert [r["relative_distance"] for r in sc.centroid_distances(v).collect()] == [0, 0]
    p = spark.createDataFrame([(1, 0, [0.9, 0.1]), (2, 0, [0.2, 0.8]), (3, 1, [0.3, 0.7])], "id int, y int, p array<double>")
    flags = {r["id"]: (r["flag"], round(r["score"], 9)) for r in sc.confident_learning(p).collect()}
    assert flags == {1: (False, 0.0), 2: (True, 0.6), 3: (False, 0.0)}


def test_cluster_edges(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "cluster int, y int")
    row = cl.clustering_metrics(df).first()
    assert row["cluster_acc"] == 1 and row["ari"] == 1 and row["nmi"] == pytest.approx(1)
    assert row["entropy"] == pytest.approx(math.log(2)) and row["n_nonempty"] == 2
    flat = cl.clustering_metrics(spark.createDataFrame([(0, 0), (0, 0)], "cluster int, y int")).first()
    assert flat["ari"] == 1 and flat["nmi"] == 1
    wide = spark.createDataFrame([(c, (c + 3) % 9) for c in range(9) for _ in range(c + 1)], "cluster int, y int")
    assert cl.cluster_accuracy(cl.contingency(wide)).first()["cluster_acc"] == 1


def plain_grams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (2, 3, 4):
            grams = [w[i:i + n] for i in range(max(1, len(w) - n + 1))]
            out += grams
            if len(w) <= n:
                break
    return out


def test_char_ngrams(spark):
    text = "A  Bé cd\U0001f600efgh\tI"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = {r["gram"]: r["tf"] for r in ng.char_ngrams(df).collect()}
    want = {}
    for g in plain_grams(text):
        want[g] = want.get(g, 0) + 1
    assert got == want


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.random((120, 40)) * (rng.random((120, 40)) < 0.3) * np.linspace(3, 0.1, 40)
    rows = [(i, [int(j) for j in np.nonzero(r)[0]], [float(x) for x in r[np.nonzero(r)[0]]]) for i, r in enumerate(a)]
    df = spark.createDataFrame(rows, "id int, idx array<int>, val array<double>").repartition(3)
    components, values = svd_fit(df, 40, 5, rounds=30)
    assert np.allclose(values, np.linalg.svd(a)[1][:5], rtol=1e-6)
    assert np.allclose(components @ components.T, np.eye(5), atol=1e-8)
    x = np.array([r["x"] for r in svd_apply(df, components).orderBy("id").collect()])
    assert np.allclose(x, a @ components.T)


def test_features_are_scaled_on_train_rows(spark):
    texts = [(i, '{"a":"%s"}' % ("xyz" * (i % 7) + str(i)), "r:%d" % i) for i in range(60)] + [(60, "", "")]
    df = spark.createDataFrame(texts, "id int, headers string, request string")
    pre = ft.Preprocessor(svd_dim=4, max_features=50)
    x = np.array([r["features"] for r in pre.fit_transform(df).orderBy("id").collect()])
    assert x.shape == (61, 8)
    assert np.allclose(x.mean(0), 0, atol=1e-4) and np.allclose(x.std(0), 1, atol=1e-3)


def test_models_tell_blobs_apart(spark):
    rng = np.random.default_rng(4)
    y = np.arange(120) % 2
    x = rng.standard_normal((120, 6)) + 4.0 * y[:, None]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "y": y, "v": list(x)}))
    oof = md.oof_probabilities(df, "v", trees=10, max_depth=5)
    assert oof.count() == 120 and oof.select("id").distinct().count() == 120
    graded = mt.classification_metrics(oof.select("id", "y", F.col("p")[1].alias("p"))).first()
    assert graded["auc"] > 0.98
    assert cl.clustering_metrics(md.kmeans(df, df, "v", restarts=2)).first()["cluster_acc"] > 0.95
    soft = md.SoftClusters(2, 2).fit(df, "v").transform(df, "v")
    assert soft.where(F.abs(F.col("cluster_p")[0] + F.col("cluster_p")[1] - 1) > 1e-9).count() == 0


def test_forests_are_fitted_on_a_bounded_sample_and_score_every_row(spark):
    df = spark.range(20_000).selectExpr("id", "int(id % 4 = 0) AS y", "array(double(id % 4), double(id % 7)) AS v")
    some = md.fit_rows(df, 2_000, 1)
    n, share = some.agg(F.count("*"), F.avg("y")).first()
    assert 1_800 < n < 2_200 and abs(share - 0.25) < 0.04
    assert some.select("id").collect() == md.fit_rows(df.repartition(7), 2_000, 1).orderBy("id").select("id").collect()
    assert md.fit_rows(df, 20_000).count() == md.fit_rows(df, None).count() == 20_000
    oof = md.oof_probabilities(df, "v", trees=5, max_depth=4, most=2_000)
    assert oof.count() == 20_000 and oof.where("(p[1] > 0.5) <> (y = 1)").count() == 0


def test_draw_is_uniform(spark):
    row = spark.range(20000).select(draw(42, "t", F.col("id")).alias("u")).agg(
        F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(row[0] - 0.5) < 0.01 and row[1] >= 0 and row[2] < 1


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (6, 6), (7, 3)])
def test_best_matching_against_all(shape):
    from itertools import permutations
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        gain = rng.integers(0, 9, shape).astype(float)
        small, large = sorted(shape)
        wide = gain if shape[0] <= shape[1] else gain.T
        best = max(sum(wide[i, j] for i, j in enumerate(order)) for order in permutations(range(large), small))
        assert cl._best_matching(gain) == best


def test_matching_of_many_sparse_labels(spark):
    """Twenty classes with far-apart numbers, named otherwise as clusters, and a few strays."""
    rows = [(1000 * c, -7 * c, 10 + c) for c in range(20)] + [(1000 * c, -7 * ((c + 3) % 20), 2) for c in range(20)]
    table = spark.createDataFrame([("a", *r) for r in rows] + [("b", None, 5, 3)], "g string, cluster long, y long, n long")
    got = {r["g"]: r["cluster_acc"] for r in cl.cluster_accuracy(table, by=["g"]).collect()}
    right = sum(10 + c for c in range(20))
    assert got == {"a": right / (right + 40), "b": 1.0}


def test_large_forests_are_fitted_in_parts(spark, monkeypatch):
    """No more nodes at a time than allowed; the parts' mean over trees is the answer, repeated ids included."""
    from labelaudit.operators import models as md
    df = spark.range(600).selectExpr("id % 500 AS id", "array(sin(id * 7), cos(id * id), sin(id * id * 3)) AS v",
                                     "cast(sin(id * 7) + cos(id * 5) > 0 AS int) AS y").localCheckpoint()
    models, real = [], md.fit_forest
    monkeypatch.setattr(md, "fit_forest", lambda *a, **b: models.append(real(*a, **b)) or models[-1])
    got = md.forest_proba(df, df, "v", trees=9, max_depth=12, nodes=2_500)
    assert got.count() == 600 and sum(m.getNumTrees for m in models) == 9 and len(models) > 1
    assert all(m.totalNumNodes <= 2_500 for m in models)
    mean = {}
    for m in models:
        for r in md.predict_proba(m, df, "v").collect():
            mean[tuple(r["v"])] = mean.get(tuple(r["v"]), 0) + r["p"][1] * m.getNumTrees / 9
    assert all(abs(mean[tuple(r["v"])] - r["p"][1]) < 1e-9 for r in got.collect())
    models.clear()
    oof = md.oof_probabilities(df, "v", trees=6, max_depth=12, nodes=4_000)
    assert oof.count() == 600 and len(models) > 4 and max(m.totalNumNodes for m in models) <= 1_000


def test_rare_places_of_rows_get_no_dense_column():
    from labelaudit.operators.svd import pieces
    rng = np.random.default_rng(8)
    rows = [np.unique(np.r_[np.arange(20), rng.integers(20, 5000, int(n))]) for n in rng.integers(0, 40, 1500)] + [np.zeros(0, "int64")]
    offsets, place = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
    value, idf, q = rng.integers(1, 9, len(place)), rng.random(5000) + 1, rng.standard_normal((5000, 6))
    a = np.zeros((len(rows), 5000))
    a[np.repeat(np.arange(len(rows)), np.diff(offsets)), place] = value
    a *= idf
    a /= np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-300)
    total, seen = np.zeros((5000, 6)), 0
    for first, last, piece in pieces(offsets, place, value, 5000, idf):
        assert piece.block.shape[1] <= 20
        y = piece.times(q)
        assert np.allclose(y, a[first:last] @ q, atol=1e-12)
        piece.add_back(y, total)
        seen += last - first
    assert seen == len(rows) and np.allclose(total, a.T @ (a @ q), atol=1e-10)

"""A2-A12, Q4-Q10, E1, E7-E10, W2, W3, W6, U4 on given scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions.draws import draw
from labelaudit.functions.heuristics import with_flags
from labelaudit.operators import clusters as cl, metrics, ranking, reports as rp, sampling, scores as sc

from .q_knn import ranking_sql, rounded
from .q_text import _FLAGS
from .registry import register
from .views import corpus, doc_labels, probs2, probs4, sql, sql_draw, vectors, views4

# ---- confident learning and cluster scores --------------------------------

_CL = """@t AS (SELECT avg(CASE WHEN y = 0 THEN p0 END) AS t0, avg(CASE WHEN y = 1 THEN p1 END) AS t1 FROM probs2),
  cl AS (SELECT id, y, p0, p1, greatest(p0, p1) - CASE WHEN y = 1 THEN p1 ELSE p0 END AS score,
    (p0 >= t0 OR p1 >= t1) AND (CASE WHEN CASE WHEN p1 >= t1 THEN p1 ELSE -1 END >
      CASE WHEN p0 >= t0 THEN p0 ELSE -1 END THEN 1 ELSE 0 END) <> y AS flag FROM probs2, t)"""


@register("confident_learning", sql("probs2", _CL + " SELECT id, round(score, 9) AS score, flag FROM cl"))
def _(spark, sf):
    return sc.confident_learning(probs2(spark, sf)).select("id", F.round("score", 9).alias("score"), "flag")


@register("class_thresholds", sql("probs2", """SELECT y, round(avg(CASE WHEN y = 1 THEN p1 ELSE p0 END), 9) AS threshold
  FROM probs2 GROUP BY y"""))
def _(spark, sf):
    return rounded(sc.per_class_mean(probs2(spark, sf)), ["y"])


_ENTROPY = "-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12)))"


@register("cluster_entropy", sql("probs4", f"SELECT id, round({_ENTROPY}, 9) AS score FROM probs4"))
def _(spark, sf):
    return probs4(spark, sf).select("id", F.round(sc.cluster_entropy("p"), 9).alias("score"))


_MISMATCH = """SELECT id, 1 - count(*) OVER (PARTITION BY cluster, y) / count(*) OVER (PARTITION BY cluster)::DOUBLE
  AS score FROM vectors"""


@register("cluster_label_mismatch", sql("vectors", f"SELECT id, round(score, 9) AS score FROM ({_MISMATCH})"))
def _(spark, sf):
    return rounded(sc.cluster_label_mismatch(vectors(spark, sf)).select("id", "score"), ["id"])


_CENTROIDS = """@long AS (SELECT id, y10 AS y, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM vectors),
  cents AS (SELECT y, pos, avg(x) AS m FROM long GROUP BY y, pos),
  dists AS (SELECT id, long.y, c.y AS c, sqrt(sum((x - m) * (x - m))) AS d FROM long JOIN cents c USING (pos)
    GROUP BY id, long.y, c.y),
  rel AS (SELECT id, max(CASE WHEN c = y THEN d END) AS own, min(CASE WHEN c <> y THEN d END) AS opp
    FROM dists GROUP BY id)"""


@register("centroids", sql("vectors", _CENTROIDS +
          " SELECT y, CAST(pos - 1 AS INTEGER) AS pos, round(m, 9) AS x FROM cents"))
def _(spark, sf):
    c = sc.centroids(vectors(spark, sf).withColumn("y", F.col("y10")))
    return c.select("y", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 9))


@register("centroid_distances", sql("vectors", _CENTROIDS + """ SELECT id, round(own, 9) AS own_distance,
  round(opp, 9) AS opposite_distance, round(own - opp, 9) AS relative_distance FROM rel"""))
def _(spark, sf):
    d = sc.centroid_distances(vectors(spark, sf).withColumn("y", F.col("y10")))
    return rounded(d.select("id", "own_distance", "opposite_distance", "relative_distance"), ["id"])


_SCORES = _CL + f""", s AS (SELECT id, cl.y, cl.flag, cl.score AS confident_learning, {_ENTROPY} AS cluster_entropy,
    {sql_draw(42, "'view'", 'id')} AS view_instability FROM cl JOIN probs4 USING (id)),
  n AS (SELECT *, (confident_learning - min(confident_learning) OVER ()) /
      (max(confident_learning) OVER () - min(confident_learning) OVER ()) AS a,
    (cluster_entropy - min(cluster_entropy) OVER ()) / (max(cluster_entropy) OVER () - min(cluster_entropy) OVER ()) AS b,
    (view_instability - min(view_instability) OVER ()) /
      (max(view_instability) OVER () - min(view_instability) OVER ()) AS c FROM s),
  e AS (SELECT *, round((a + b + c) / 3, 12) AS ensemble FROM n)"""
_THREE = ["confident_learning", "cluster_entropy", "view_instability"]


def three_scores(spark, sf):
    cls = sc.confident_learning(probs2(spark, sf)).select(
        "id", "y", "flag", "p", F.col("score").alias("confident_learning"))
    ent = probs4(spark, sf).select("id", sc.cluster_entropy("p").alias("cluster_entropy"))
    return cls.join(ent, "id").withColumn("view_instability", draw(42, "view", F.col("id")))


def with_ensemble(spark, sf):
    return sc.ensemble(three_scores(spark, sf), _THREE).withColumn("ensemble", F.round("ensemble", 12))


@register("normalize01", sql("probs2 probs4", _SCORES + """ SELECT id, round(a, 9) AS confident_learning,
  round(b, 9) AS cluster_entropy, round(c, 9) AS view_instability FROM n"""))
def _(spark, sf):
    return rounded(sc.normalize01(three_scores(spark, sf), _THREE).select("id", *_THREE), ["id"])


@register("ensemble", sql("probs2 probs4", _SCORES + " SELECT id, round(ensemble, 9) AS ensemble FROM e"))
def _(spark, sf):
    return rounded(with_ensemble(spark, sf).select("id", "ensemble"), ["id"])


@register("ensemble_weighted", sql("probs2 probs4", _SCORES +
          " SELECT id, round((3 * a + 2 * b + c) / 6, 9) AS ensemble FROM n"))
def _(spark, sf):
    return rounded(sc.ensemble(three_scores(spark, sf), _THREE, [3, 2, 1]).select("id", "ensemble"), ["id"])


@register("view_instability", sql("views4", """SELECT id, round(avg(v), 9) AS score FROM (
  SELECT id, c, var_pop(x) AS v FROM (SELECT id, generate_subscripts(p, 1) AS c, unnest(p) AS x FROM views4)
  GROUP BY id, c) GROUP BY id"""))
def _(spark, sf):
    return rounded(sc.view_instability(views4(spark, sf)), ["id"])


# ---- cluster metrics --------------------------------------------------------

_TABLE = "@k AS (SELECT cluster, y, count(*) AS n FROM vectors GROUP BY ALL)"
_ARI = """a AS (SELECT cluster, sum(n)::DOUBLE AS m FROM k GROUP BY cluster),
  b AS (SELECT y, sum(n)::DOUBLE AS m FROM k GROUP BY y),
  q AS (SELECT (SELECT sum(n::DOUBLE * (n - 1) / 2) FROM k) AS s, (SELECT sum(m * (m - 1) / 2) FROM a) AS ra,
    (SELECT sum(m * (m - 1) / 2) FROM b) AS rb, (SELECT sum(n)::DOUBLE FROM k) AS t),
  ari AS (SELECT (s - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2)) AS ari FROM q),
  nmi AS (SELECT (SELECT sum(n / t * ln(n * t / (a.m * b.m))) FROM k JOIN a USING (cluster) JOIN b USING (y)) /
    (((SELECT -sum(m / t * ln(m / t)) FROM a) + (SELECT -sum(m / t * ln(m / t)) FROM b)) / 2) AS nmi FROM q),
  dist AS (SELECT -sum(m / t * ln(m / t + 1e-12)) AS entropy, count(*) AS n_nonempty FROM a, q),
  acc AS (SELECT max(coalesce(i.n, 0) + coalesce(j.n, 0)) / any_value(t) AS cluster_acc
    FROM q, (SELECT * FROM k WHERE y = 0) i JOIN (SELECT * FROM k WHERE y = 1) j ON i.cluster <> j.cluster)"""


def contingency(spark, sf):
    return cl.contingency(vectors(spark, sf))


@register("contingency", sql("vectors", _TABLE + " SELECT * FROM k"))
def _(spark, sf):
    return contingency(spark, sf)


@register("cluster_distribution", sql("vectors", _TABLE + ", " + _ARI +
          " SELECT round(entropy, 9) AS entropy, n_nonempty FROM dist"))
def _(spark, sf):
    return rounded(cl.cluster_distribution(contingency(spark, sf)), ["n_nonempty"])


@register("cluster_sizes", sql("vectors", """SELECT cluster, count(*) AS size,
  round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS fraction FROM vectors GROUP BY cluster"""))
def _(spark, sf):
    return rounded(cl.cluster_sizes(contingency(spark, sf)), ["cluster", "size"])


@register("ari", sql("vectors", _TABLE + ", " + _ARI + " SELECT round(ari, 9) AS ari FROM ari"))
def _(spark, sf):
    return rounded(cl.adjusted_rand(contingency(spark, sf)))


@register("nmi", sql("vectors", _TABLE + ", " + _ARI + " SELECT round(nmi, 9) AS nmi FROM nmi"))
def _(spark, sf):
    return rounded(cl.normalized_mutual_info(contingency(spark, sf)))


@register("cluster_accuracy", sql("vectors", _TABLE + ", " + _ARI +
          " SELECT round(cluster_acc, 9) AS cluster_acc FROM acc"))
def _(spark, sf):
    return rounded(cl.cluster_accuracy(contingency(spark, sf)))


@register("clustering_metrics", sql("vectors", _TABLE + ", " + _ARI + """ SELECT round(ari, 9) AS ari,
  round(nmi, 9) AS nmi, round(cluster_acc, 9) AS cluster_acc, round(entropy, 9) AS entropy, n_nonempty
  FROM ari, nmi, acc, dist"""))
def _(spark, sf):
    return rounded(cl.clustering_metrics(vectors(spark, sf)), ["n_nonempty"])


@register("classification_metrics", sql("probs2", """@c AS (SELECT count(*) FILTER (p1 >= 0.5 AND y = 1)::DOUBLE AS tp,
    count(*) FILTER (p1 >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p1 < 0.5 AND y = 1)::DOUBLE AS fn,
    count(*) AS n FROM probs2), s AS (SELECT id, p1 AS score, y = 1 AS mask FROM probs2)""" + ranking_sql("s") + """
  SELECT round(2 * tp / (2 * tp + fp + fn), 9) AS f1, roc_auc AS auc, round((n - fp - fn) / n, 9) AS acc,
    round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM c, area"""))
def _(spark, sf):
    d = probs2(spark, sf).select("id", "y", F.col("p")[1].alias("p"))
    return rounded(metrics.classification_metrics(d))


# ---- metric tables ----------------------------------------------------------

METRICS_LONG = f"""metrics_long AS (SELECT source, score, rate, seed,
    CASE WHEN source = 3 AND seed = 7 AND score = 'knn_raw' THEN 'nan'::DOUBLE ELSE
      {sql_draw('seed', 'source', 'score', 'rate')} END AS roc_auc,
    {sql_draw('seed', 'source', 'score', 'rate', "'ap'")} AS auprc,
    {sql_draw('seed', 'source', 'score', 'rate', "'p'")} AS precision_at_100
  FROM (SELECT DISTINCT traffic_source_id AS source FROM requests),
    (SELECT unnest(['ensemble', 'knn_raw', 'confident_learning']) AS score),
    (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS rate), (SELECT unnest([42, 7, 123]) AS seed))"""


def metrics_long(spark, sf):
    """A metric table: source x score x rate x seed, one cell group NaN."""
    from .views import requests
    each = lambda *xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    grid = (requests(spark, sf).select(F.col("traffic_source_id").alias("source")).distinct()
            .withColumn("score", each("ensemble", "knn_raw", "confident_learning"))
            .withColumn("rate", each(0.05, 0.1, 0.2)).withColumn("seed", each(42, 7, 123)))
    key = [F.col("source"), F.col("score"), F.col("rate")]
    odd = (F.col("source") == 3) & (F.col("seed") == 7) & (F.col("score") == "knn_raw")
    return grid.select("*", F.when(odd, float("nan")).otherwise(draw(F.col("seed"), *key)).alias("roc_auc"),
                       draw(F.col("seed"), *key, "ap").alias("auprc"),
                       draw(F.col("seed"), *key, "p").alias("precision_at_100"))


_CLEAN = "CASE WHEN NOT isnan(roc_auc) THEN roc_auc END"


@register("mean_std", sql("requests", "@" + METRICS_LONG + f""" SELECT score, source,
  round(avg({_CLEAN}), 9) AS mean, round(stddev_pop({_CLEAN}), 9) AS std FROM metrics_long GROUP BY ALL"""))
def _(spark, sf):
    return rounded(rp.mean_std(metrics_long(spark, sf), ["score", "source"], "roc_auc"), ["score", "source"])


@register("noise_summary", sql("requests", "@" + METRICS_LONG + f""" SELECT score, rate,
  round(avg({_CLEAN}), 4) AS roc_auc_mean, round(stddev_pop({_CLEAN}), 4) AS roc_auc_std,
  round(avg(auprc), 4) AS auprc_mean, round(avg(precision_at_100), 4) AS precision_at_100_mean
  FROM metrics_long GROUP BY ALL"""))
def _(spark, sf):
    return rp.noise_summary(metrics_long(spark, sf))


@register("knn_summary", sql("requests", "@" + METRICS_LONG + f""" SELECT score AS variant,
  round(avg({_CLEAN}), 4) AS roc_auc_mean, round(stddev_pop({_CLEAN}), 4) AS roc_auc_std,
  round(avg(auprc), 4) AS auprc_mean FROM metrics_long GROUP BY ALL"""))
def _(spark, sf):
    return rp.knn_summary(metrics_long(spark, sf).withColumnRenamed("score", "variant"))


@register("noise_pivot", sql("requests", "@" + METRICS_LONG + f""" SELECT source,
  round(avg({_CLEAN}) FILTER (score = 'ensemble'), 9) AS ensemble,
  round(avg({_CLEAN}) FILTER (score = 'knn_raw'), 9) AS knn_raw FROM metrics_long GROUP BY source"""))
def _(spark, sf):
    return rounded(rp.metric_pivot(metrics_long(spark, sf), "source", "score", ["ensemble", "knn_raw"]), ["source"])


@register("rate_pivot", sql("requests", "@" + METRICS_LONG + f""" SELECT score,
  round(avg({_CLEAN}) FILTER (rate = 0.05), 9) AS r05_mean, round(stddev_samp({_CLEAN}) FILTER (rate = 0.05), 9) AS r05_std,
  round(avg({_CLEAN}) FILTER (rate = 0.2), 9) AS r20_mean, round(stddev_samp({_CLEAN}) FILTER (rate = 0.2), 9) AS r20_std
  FROM metrics_long GROUP BY score"""))
def _(spark, sf):
    out = rp.metric_pivot(metrics_long(spark, sf), "score", "rate", [0.05, 0.2], spread=True)
    return rounded(out.toDF("score", "r05_mean", "r05_std", "r20_mean", "r20_std"), ["score"])


@register("balance_sheet", sql("doc_labels vectors", f"""@r AS (SELECT id, y, row_number() OVER (PARTITION BY y
    ORDER BY {sql_draw(42, "'split'", 'id')}, id) AS rn, count(*) OVER (PARTITION BY y) AS c, count(*) OVER () AS n
    FROM vectors),
  g AS (SELECT DISTINCT y, c, n, n - ceil(0.3 * n) AS total FROM r),
  quota AS (SELECT y, floor(1.0 * total * c / n) + CASE WHEN row_number() OVER (ORDER BY
    floor(1.0 * total * c / n) - 1.0 * total * c / n, y) <= total - sum(floor(1.0 * total * c / n)) OVER ()
    THEN 1 ELSE 0 END AS q FROM g),
  s AS (SELECT r.y, CASE WHEN rn <= c - q THEN 'test' ELSE 'train' END AS split FROM r JOIN quota USING (y))
  SELECT split, count(*) AS n, count(*) FILTER (y = 0) AS human, count(*) FILTER (y = 1) AS bot,
    64 AS feature_dim FROM s GROUP BY split"""))
def _(spark, sf):
    return rp.balance_sheet(sampling.stratified_split(vectors(spark, sf)), features="v")


@register("score_histogram", sql("probs2 probs4", _SCORES + """, b AS (SELECT min(ensemble) AS lo, max(ensemble) AS hi FROM e)
  SELECT bin, round(lo + bin * (hi - lo) / 50, 9) AS left, count(*) AS n FROM (
    SELECT CAST(least(floor((ensemble - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, lo, hi FROM e, b) GROUP BY ALL"""))
def _(spark, sf):
    return rounded(rp.histogram(with_ensemble(spark, sf), "ensemble", 50), ["bin", "n"])


@register("label_histogram", sql("probs2", """@b AS (SELECT min(p1) AS lo, max(p1) AS hi FROM probs2)
  SELECT y, bin, round(lo + bin * (hi - lo) / 40, 9) AS left, count(*) AS n FROM (
    SELECT y, CAST(least(floor((p1 - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, lo, hi FROM probs2, b) GROUP BY ALL"""))
def _(spark, sf):
    d = probs2(spark, sf).withColumn("p1", F.col("p")[1])
    return rounded(rp.histogram(d, "p1", 40, ["y"]), ["y", "bin", "n"])


# ---- suspects ---------------------------------------------------------------

@register("top_suspects", sql("probs2 probs4", _SCORES + """ SELECT id, y, round(ensemble, 9) AS ensemble,
  CAST(row_number() OVER (ORDER BY ensemble DESC, id) AS INTEGER) AS rank FROM e ORDER BY ensemble DESC, id LIMIT 100"""))
def _(spark, sf):
    top = rp.top_suspects(with_ensemble(spark, sf).select("id", "y", "ensemble"), "ensemble", 100)
    return rounded(top, ["id", "y", "rank"])


def audit_rows(spark, sf):
    """Anchors of the corpus next to given probabilities, scores and flags."""
    u = lambda tag: draw(42, tag, F.col("id"))
    rows = with_flags(corpus(spark, sf))
    truth = F.when(u("given") < 0.1, 1 - F.col("y")).otherwise(F.col("y"))
    p1 = 0.6 * truth + 0.4 * u("proba")
    rows = rows.withColumn("p", F.array(1 - p1, p1))
    rows = sc.confident_learning(rows).withColumnRenamed("flag", "cl_flag")
    return rows.withColumns({"ensemble": u("ensemble"), "knn_raw": u("raw"), "knn_cc": u("cc")}).withColumn(
        "confident_learning", F.col("score"))


_AUDIT = _FLAGS + f""", truth AS (SELECT *, CASE WHEN {sql_draw(42, "'given'", 'id')} < 0.1 THEN 1 - y ELSE y END AS t
    FROM anchors),
  given AS (SELECT *, 1 - (0.6 * t + 0.4 * {sql_draw(42, "'proba'", 'id')}) AS p0,
    0.6 * t + 0.4 * {sql_draw(42, "'proba'", 'id')} AS p1, {sql_draw(42, "'ensemble'", 'id')} AS ensemble,
    {sql_draw(42, "'raw'", 'id')} AS knn_raw, {sql_draw(42, "'cc'", 'id')} AS knn_cc FROM truth),
  lim AS (SELECT avg(p0) FILTER (y = 0) AS t0, avg(p1) FILTER (y = 1) AS t1 FROM given),
  audit AS (SELECT *, greatest(p0, p1) - CASE WHEN y = 1 THEN p1 ELSE p0 END AS score,
    (p0 >= t0 OR p1 >= t1) AND (CASE WHEN CASE WHEN p1 >= t1 THEN p1 ELSE -1 END >
      CASE WHEN p0 >= t0 THEN p0 ELSE -1 END THEN 1 ELSE 0 END) <> y AS cl_flag FROM given, lim)"""


@register("gold_candidates", sql("corpus", _AUDIT + """ SELECT id AS index,
  CASE WHEN y = 1 THEN 'bots' ELSE 'unsafe' END AS given_label, round(p0, 3) AS p_human, round(p1, 3) AS p_bot,
  round(score, 3) AS suspicion, substr(user_agent, 1, 70) AS user_agent, has_template FROM audit WHERE cl_flag"""))
def _(spark, sf):
    return rp.gold_candidates(audit_rows(spark, sf).withColumnRenamed("cl_flag", "flag"))


@register("unsafe_audit", sql("corpus", _AUDIT + """, ranked AS (SELECT *,
    row_number() OVER (PARTITION BY source ORDER BY ensemble DESC, id) AS r,
    row_number() OVER (PARTITION BY source, y ORDER BY ensemble DESC, id) AS ry FROM audit)
  SELECT source, count(*) AS n, count(*) FILTER (y = 0) AS unsafe, count(*) FILTER (y = 1) AS bot,
    count(*) FILTER (y = 0 AND cl_flag) AS unsafe_cl_flags, count(*) FILTER (y = 0 AND flag) AS unsafe_heuristic_flags,
    count(*) FILTER (y = 0 AND r <= 100) AS top_unsafe,
    string_agg(id::VARCHAR, ',' ORDER BY ry) FILTER (y = 0 AND ry <= 10) AS top_unsafe_ids FROM ranked GROUP BY source"""))
def _(spark, sf):
    out = rp.unsafe_audit(audit_rows(spark, sf))
    return out.withColumn("top_unsafe_ids", F.array_join("top_unsafe_ids", ","))


_TOP = lambda s: f"(SELECT id FROM audit ORDER BY {s} DESC, id LIMIT 100)"
_OVER = lambda name, a, b: f"""SELECT '{name}' AS pair, (SELECT count(*) FROM {a} JOIN {b} USING (id)) AS intersection,
  round((SELECT count(*) FROM {a} JOIN {b} USING (id)) / (SELECT count(*) FROM (SELECT id FROM {a} UNION SELECT id FROM {b}))::DOUBLE, 4) AS jaccard"""


@register("overlap_report", sql("corpus", _AUDIT + " " + " UNION ALL ".join([
    _OVER("knn_raw_vs_knn_cc", _TOP("knn_raw"), _TOP("knn_cc")),
    _OVER("knn_cc_vs_confident_learning", _TOP("knn_cc"), _TOP("round(score, 12)")),
    _OVER("ensemble_vs_heuristic", _TOP("ensemble"), "(SELECT id FROM audit WHERE flag)")])))
def _(spark, sf):
    return rp.overlap_report(audit_rows(spark, sf).withColumn(
        "confident_learning", F.round("confident_learning", 12)))


@register("audit_flags", sql("corpus", _AUDIT + """ SELECT count(*) AS n, count(*) FILTER (cl_flag) AS confident_learning_flags,
  round(count(*) FILTER (cl_flag) / count(*)::DOUBLE, 9) AS confident_learning_flag_rate,
  count(*) FILTER (flag) AS heuristic_bot_flags FROM audit"""))
def _(spark, sf):
    return rp.audit_flags(audit_rows(spark, sf)).withColumn(
        "confident_learning_flag_rate", F.round("confident_learning_flag_rate", 9))


@register("joined_scores", sql("probs2 probs4 vectors", _SCORES + """ SELECT e.id, e.y, v.y10, round(ensemble, 9) AS ensemble,
  round(list_max(q.p), 9) AS best FROM e JOIN vectors v ON v.id = e.id JOIN probs4 q ON q.id = e.id"""))
def _(spark, sf):
    out = (with_ensemble(spark, sf).select("id", "y", "ensemble")
           .join(vectors(spark, sf).select("id", "y10"), "id")
           .join(probs4(spark, sf).select("id", F.array_max("p").alias("best")), "id"))
    return rounded(out, ["id", "y", "y10"])


@register("study_summary", sql("requests", "@" + METRICS_LONG + f""", m AS (SELECT source, method, metric, seed,
    {sql_draw('seed', 'source', 'method', 'metric')} AS value
    FROM (SELECT DISTINCT traffic_source_id AS source FROM requests), (SELECT unnest([42, 7]) AS seed),
      (VALUES ('LogReg', 'f1'), ('RandomForest', 'f1'), ('Embedding + probe', 'f1'), ('Soft clusters', 'ari'),
        ('Soft clusters', 'n_nonempty')) t(method, metric)),
  a AS (SELECT source, method, metric, avg(value) AS v FROM m GROUP BY ALL),
  ens AS (SELECT source, avg(roc_auc) AS x, stddev_pop(roc_auc) AS s FROM metrics_long WHERE score = 'ensemble' GROUP BY source),
  kn AS (SELECT source, avg({_CLEAN}) AS x, stddev_pop({_CLEAN}) AS s FROM metrics_long WHERE score = 'knn_raw' GROUP BY source)
  SELECT a.source, max_by(method, v) FILTER (metric = 'f1' AND method IN ('LogReg', 'RandomForest')) AS best_method,
    round(max(v) FILTER (metric = 'f1' AND method IN ('LogReg', 'RandomForest')), 9) AS best_f1,
    round(max(v) FILTER (method = 'RandomForest'), 9) AS rf_f1, round(max(v) FILTER (method = 'Embedding + probe'), 9) AS probe_f1,
    round(max(v) FILTER (metric = 'ari'), 9) AS cluster_ari, round(max(v) FILTER (metric = 'n_nonempty'), 9) AS nonempty_clusters,
    round(any_value(ens.x), 9) AS ensemble_auc_mean, round(any_value(ens.s), 9) AS ensemble_auc_std,
    round(any_value(kn.x), 9) AS knn_raw_auc_mean, round(any_value(kn.s), 9) AS knn_raw_auc_std
  FROM a JOIN ens ON ens.source = a.source JOIN kn ON kn.source = a.source GROUP BY a.source"""))
def _(spark, sf):
    grid = metrics_long(spark, sf)
    pairs = [("LogReg", "f1"), ("RandomForest", "f1"), ("Embedding + probe", "f1"),
             ("Soft clusters", "ari"), ("Soft clusters", "n_nonempty")]
    m = (grid.select("source").distinct().withColumn("seed", F.explode(F.array(F.lit(42), F.lit(7))))
         .withColumn("t", F.explode(F.array(*[F.struct(F.lit(a).alias("method"), F.lit(b).alias("metric"))
                                              for a, b in pairs]))).select("source", "seed", "t.*"))
    m = m.withColumn("value", draw(F.col("seed"), F.col("source"), F.col("method"), F.col("metric")))
    knn = grid.where("score = 'knn_raw'").withColumn("variant", F.lit("KNN raw"))
    audit = grid.select("source").distinct().select(
        "source", F.lit(0.0).alias("confident_learning_flag_rate"), F.lit(0).alias("heuristic_bot_flags"))
    out = rp.study_summary(m, grid, knn, audit)
    keep = ["source", "best_method", "best_f1", "rf_f1", "probe_f1", "cluster_ari", "nonempty_clusters",
            "ensemble_auc_mean", "ensemble_auc_std", "knn_raw_auc_mean", "knn_raw_auc_std"]
    return rounded(out.select(*keep), ["source", "best_method"])

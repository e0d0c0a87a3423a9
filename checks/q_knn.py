"""J3, J4, Q1, Q2, A13, E2-E6, U3."""
from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions.draws import draw
from labelaudit.operators import knn, metrics
from labelaudit.operators.ranking import exact_median
from labelaudit.operators.sampling import inject_label_noise, noise_groups
from labelaudit.session import stored

from .registry import register
from .views import probs2, sql, sql_draw, vectors

K = 20

_UNIT = """unit AS (SELECT id, y, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS w
  FROM vectors), """
GRAPH = "@" + _UNIT + f"""graph AS (SELECT * FROM (
  SELECT id, nbr_id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS rank FROM (
    SELECT a.id, b.id AS nbr_id,
      round(greatest(1 - list_dot_product(a.w, b.w), 0), 12) AS dist
    FROM unit a JOIN unit b ON a.id <> b.id)) WHERE rank <= {K})"""


def graph(spark, sf):
    return knn.knn_graph(vectors(spark, sf), K)


def flipped(spark, sf):
    return inject_label_noise(vectors(spark, sf), 0.1).select("id", F.col("y_noisy").alias("y"), "mask")


FLIPPED = f""", flipped AS (SELECT id, CASE WHEN rn <= round_even(0.1::DOUBLE * c, 0) THEN 1 - y ELSE y END AS y,
    rn <= round_even(0.1::DOUBLE * c, 0) AS mask FROM (SELECT id, y, count(*) OVER () AS c,
    row_number() OVER (ORDER BY {sql_draw(42, "'flip'", 'id')}, id) AS rn FROM vectors))"""
DISAGREE = GRAPH + FLIPPED + """, scored AS (
  SELECT g.id, any_value(a.mask) AS mask, avg(CASE WHEN a.y <> b.y THEN 1.0::DOUBLE ELSE 0 END) AS score
  FROM graph g JOIN flipped a ON a.id = g.id JOIN flipped b ON b.id = g.nbr_id GROUP BY g.id)"""


def scored(spark, sf):
    labels = stored(flipped(spark, sf), "labels")
    score = knn.knn_disagreement(graph(spark, sf), labels)
    return stored(labels.select("id", "mask").join(score, "id"), "scored")


@register("knn_graph", sql("vectors", GRAPH +
          " SELECT id, nbr_id, round(dist, 9) AS dist, CAST(rank AS INTEGER) AS rank FROM graph"))
def _(spark, sf):
    return graph(spark, sf).withColumn("dist", F.round("dist", 9))


@register("neighbour_labels", sql("vectors", GRAPH + """
  SELECT g.id, g.nbr_id, a.y, b.y AS nbr_y FROM graph g JOIN vectors a ON a.id = g.id
  JOIN vectors b ON b.id = g.nbr_id"""))
def _(spark, sf):
    labels = vectors(spark, sf).select("id", "y")
    return knn.with_labels(graph(spark, sf), labels).select("id", "nbr_id", "y", "nbr_y")


@register("knn_disagreement", sql("vectors", DISAGREE +
          " SELECT id, mask, round(score, 9) AS score FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("id", "mask", F.round("score", 9).alias("score"))


@register("knn_weighted", sql("vectors", GRAPH + FLIPPED + """, t AS (SELECT median(dist) + 1e-9 AS t FROM graph),
  w AS (SELECT g.id, exp(-g.dist / (SELECT t FROM t)) AS w, a.y <> b.y AS differs FROM graph g
    JOIN flipped a ON a.id = g.id JOIN flipped b ON b.id = g.nbr_id)
  SELECT id, round(sum(CASE WHEN differs THEN w ELSE 0 END) / (sum(w) + 1e-12), 9) AS score
  FROM w GROUP BY id"""))
def _(spark, sf):
    return knn.knn_weighted(graph(spark, sf), flipped(spark, sf)).select(
        "id", F.round("score", 9).alias("score"))


@register("global_median", sql("vectors", GRAPH + " SELECT round(median(dist), 9) AS temperature FROM graph"))
def _(spark, sf):
    g = graph(spark, sf)
    return spark.createDataFrame([(round(exact_median(g, "dist"), 9),)], "temperature double")


def ranking_sql(scored: str, ks=(50, 100, 200), by: str = "") -> str:
    """Areas and top-k shares from a (by.., id, score, mask) clause."""
    part = f"PARTITION BY {by}" if by else ""
    sel, comma = (f"{by}, ", ", " + by) if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    on = "USING (" + by + ")" if by else "ON true"
    tops = ", ".join(
        f"round(sum(CASE WHEN rk <= {k} THEN hit ELSE 0 END) / least({k}, count(*)), 9) AS precision_at_{k}, "
        f"round(CASE WHEN sum(hit) = 0 THEN 0 ELSE sum(CASE WHEN rk <= {k} THEN hit ELSE 0 END) / sum(hit) END, 9)"
        f" AS recall_at_{k}" for k in ks)
    return f""", h AS (SELECT {sel}id, score, CAST(mask AS INTEGER)::DOUBLE AS hit,
    row_number() OVER ({part} ORDER BY score DESC, id) AS rk FROM {scored}),
  t AS (SELECT {sel}score, sum(hit) AS p, sum(1 - hit) AS n FROM h GROUP BY score{comma}),
  r AS (SELECT *, sum(n) OVER ({part} ORDER BY score) AS n_le, sum(p) OVER ({part} ORDER BY score DESC) AS p_ge,
    sum(n) OVER ({part} ORDER BY score DESC) AS n_ge FROM t),
  area AS (SELECT {sel}round(sum(p * (n_le - n / 2)) / (sum(p) * sum(n)), 9) AS roc_auc,
    round(sum(p * p_ge / (p_ge + n_ge)) / sum(p), 9) AS auprc, round(sum(p) / (sum(p) + sum(n)), 9) AS base_rate
    FROM r {group}),
  tops AS (SELECT {sel}{tops} FROM h {group})
  """


def rounded(df, keep=()):
    return df.select(*[c if c in keep else F.round(c, 9).alias(c) for c in df.columns])


@register("noise_detection_metrics", sql("vectors", DISAGREE + ranking_sql("scored") +
          "SELECT * FROM area JOIN tops ON true"))
def _(spark, sf):
    return rounded(metrics.noise_detection_metrics(scored(spark, sf)))


@register("roc_auc", sql("probs2", "@s AS (SELECT id, p1 AS score, y = 1 AS mask FROM probs2)" +
          ranking_sql("s") + "SELECT roc_auc FROM area"))
def _(spark, sf):
    d = probs2(spark, sf).select("id", F.col("p")[1].alias("score"), (F.col("y") == 1).alias("mask"))
    return rounded(metrics.area_metrics(d, "score", "mask").select("roc_auc"))


@register("average_precision", sql("probs2", "@s AS (SELECT id, p1 AS score, y = 1 AS mask FROM probs2)" +
          ranking_sql("s") + "SELECT auprc FROM area"))
def _(spark, sf):
    d = probs2(spark, sf).select("id", F.col("p")[1].alias("score"), (F.col("y") == 1).alias("mask"))
    return rounded(metrics.area_metrics(d, "score", "mask").select("auprc"))


@register("precision_at_k", sql("vectors", DISAGREE + ranking_sql("scored") +
          "SELECT precision_at_50, precision_at_100, precision_at_200 FROM tops"))
def _(spark, sf):
    m = metrics.at_k_metrics(scored(spark, sf), "score", "mask")
    return rounded(m.select("precision_at_50", "precision_at_100", "precision_at_200"))


@register("recall_at_k", sql("vectors", DISAGREE + ranking_sql("scored") +
          "SELECT recall_at_50, recall_at_100, recall_at_200 FROM tops"))
def _(spark, sf):
    m = metrics.at_k_metrics(scored(spark, sf), "score", "mask")
    return rounded(m.select("recall_at_50", "recall_at_100", "recall_at_200"))


@register("topk_overlap", sql("probs2", f"""@s AS (SELECT id, p1 AS a, {sql_draw(42, "'b'", 'id')} AS b FROM probs2),
  x AS (SELECT id FROM s ORDER BY a DESC, id LIMIT 100), z AS (SELECT id FROM s ORDER BY b DESC, id LIMIT 100),
  i AS (SELECT count(*) AS i FROM x JOIN z USING (id)), u AS (SELECT count(*) AS u FROM (SELECT * FROM x UNION SELECT * FROM z))
  SELECT i AS intersection, round(i / u, 9) AS jaccard FROM i, u"""))
def _(spark, sf):
    d = probs2(spark, sf).select("id", F.col("p")[1].alias("a"), draw(42, "b", F.col("id")).alias("b"))
    return rounded(metrics.topk_overlap(d, "a", "b", 100))


RATES, SEEDS = (0.01, 0.03, 0.05, 0.10, 0.20), (42, 7, 123, 2024, 999)


@register("grid_noise", sql("vectors", "@" + f"""unit AS (SELECT id, y, y10 AS source,
    list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS w FROM vectors WHERE y10 IS NOT NULL),
  graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS rank FROM (
    SELECT a.source, a.id, b.id AS nbr_id, round(greatest(1 - list_dot_product(a.w, b.w), 0), 12) AS dist
    FROM unit a JOIN unit b ON a.source = b.source AND a.id <> b.id)) WHERE rank <= {K}),
  drawn AS (SELECT source, seed, id, y, count(*) OVER (PARTITION BY source, seed) AS c,
    row_number() OVER (PARTITION BY source, seed ORDER BY {sql_draw('seed', "'flip'", 'id')}, id) AS rn
    FROM unit, (SELECT unnest({list(SEEDS)}) AS seed)),
  flips AS (SELECT source, seed, rate, id, rn <= round_even(rate * c, 0) AS mask,
    CASE WHEN rn <= round_even(rate * c, 0) THEN 1 - y ELSE y END AS y
    FROM drawn, (SELECT unnest({list(RATES)}::DOUBLE[]) AS rate)),
  scored AS (SELECT a.source, a.seed, a.rate, a.id, any_value(a.mask) AS mask,
    avg(CASE WHEN a.y <> b.y THEN 1.0::DOUBLE ELSE 0 END) AS score
    FROM graph g JOIN flips a ON a.source = g.source AND a.id = g.id
    JOIN flips b ON b.source = a.source AND b.seed = a.seed AND b.rate = a.rate AND b.id = g.nbr_id
    GROUP BY a.source, a.seed, a.rate, a.id)""" + ranking_sql("scored", by="source, seed, rate") +
    "SELECT * REPLACE (CASE WHEN isnan(roc_auc) OR roc_auc IS NULL THEN 'nan'::DOUBLE ELSE roc_auc END AS roc_auc, "
    "CASE WHEN isnan(auprc) OR auprc IS NULL THEN 'nan'::DOUBLE ELSE auprc END AS auprc) "
    "FROM area JOIN tops USING (source, seed, rate)"))
def _(spark, sf):
    """Neighbours within each source, flips of every (source, seed, rate), one plan for all of them."""
    v = vectors(spark, sf).where("y10 IS NOT NULL").withColumnRenamed("y10", "source")
    near = knn.knn_graph(v, K, by=["source"])
    seeded = v.select("source", "id", "y").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    flips = noise_groups(stored(seeded, "seeded"), ["source", "seed"], RATES)
    labels = stored(flips.select("source", "seed", "rate", "id", F.col("y_noisy").alias("y"), "mask"), "labels")
    by = ["source", "seed", "rate"]
    score = knn.knn_disagreement(near, labels, by=by).join(labels.drop("y"), [*by, "id"])
    return rounded(metrics.noise_detection_metrics(score, by=by), by)

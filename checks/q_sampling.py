"""M1-M8, M18, J6, W5."""
from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.operators import sampling as sp
from labelaudit.operators.ranking import rank_within
from labelaudit.functions.draws import draw

from .registry import register
from .views import corpus, doc_labels, sql, sql_draw, vectors

_RANKED = lambda tag: (f"@ranked AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY "
                       f"{sql_draw(42, repr(tag), 'id')}, id) AS rn, count(*) OVER (PARTITION BY y) AS c, "
                       "count(*) OVER () AS n FROM doc_labels), ")

# quotas by largest remainder of a total over the classes
_QUOTA = lambda total: (
    f"shares AS (SELECT y, c, n, {total} AS total FROM (SELECT DISTINCT y, c, n FROM ranked)), "
    "quota AS (SELECT y, c, floor(1.0 * total * c / n) + CASE WHEN row_number() OVER (ORDER BY "
    "floor(1.0 * total * c / n) - 1.0 * total * c / n, y) <= total - sum(floor(1.0 * total * c / n)) "
    "OVER () THEN 1 ELSE 0 END AS q FROM shares) ")


@register("stratified_split", sql("doc_labels", _RANKED("split") + _QUOTA("n - ceil(0.3 * n)") +
          "SELECT id, r.y, CASE WHEN rn <= r.c - q THEN 'test' ELSE 'train' END AS split "
          "FROM ranked r JOIN quota USING (y)"))
def _(spark, sf):
    return sp.stratified_split(doc_labels(spark, sf), 0.3).select("id", "y", "split")


@register("balanced_subsample", sql("doc_labels", _RANKED("subsample") +
          "k AS (SELECT least(40 // count(DISTINCT y), min(c)) AS k FROM ranked) "
          "SELECT id, y FROM ranked WHERE rn <= (SELECT k FROM k)"))
def _(spark, sf):
    return sp.balanced_subsample(doc_labels(spark, sf), 40).select("id", "y")


@register("label_subset", sql("doc_labels", _RANKED("subset") + _QUOTA("floor(0.25 * n)") +
          "SELECT id, r.y FROM ranked r JOIN quota USING (y) WHERE rn <= q"))
def _(spark, sf):
    return sp.label_subset(doc_labels(spark, sf), 0.25).select("id", "y")


@register("stratified_folds", sql("doc_labels", f"""
  SELECT id, y, CAST((row_number() OVER (ORDER BY y, {sql_draw(42, "'fold'", 'id')}, id) - 1) % 4
    AS INTEGER) AS fold FROM doc_labels"""))
def _(spark, sf):
    return sp.stratified_folds(doc_labels(spark, sf), 4).select("id", "y", "fold")


@register("rank_within_class", sql("doc_labels", f"""
  SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_draw(42, "'flip'", 'id')}, id) - 1 AS pos
  FROM doc_labels"""))
def _(spark, sf):
    drawn = doc_labels(spark, sf).withColumn("u", draw(42, "flip", F.col("id")))
    return rank_within(drawn, ["y"]).select("id", "y", "pos")


def _noise_sql(group: str, rate: str) -> str:
    return sql("corpus", f"""@r AS (
      SELECT id, y, {group} AS g, {rate} AS rate, row_number() OVER (PARTITION BY {group}
        ORDER BY {sql_draw(42, "'flip'", 'id')}, id) AS rn, count(*) OVER (PARTITION BY {group}) AS c
      FROM corpus)
      SELECT id, y, CASE WHEN rn <= round_even(rate * c, 0) THEN 1 - y ELSE y END AS y_noisy,
        rn <= round_even(rate * c, 0) AS mask FROM r""")


for _mode, _group, _rate in (
        ("symmetric", "0", "0.1::DOUBLE"),
        ("bot_to_human", "y", "CASE WHEN y = 1 THEN 0.1::DOUBLE ELSE 0 END"),
        ("human_to_bot", "y", "CASE WHEN y = 0 THEN 0.1::DOUBLE ELSE 0 END"),
        ("class_conditional", "y", "CASE WHEN y = 1 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END")):
    def _noise(spark, sf, mode=_mode):
        return sp.inject_label_noise(corpus(spark, sf), 0.1, mode).select("id", "y", "y_noisy", "mask")
    register(f"noise_{_mode}", _noise_sql(_group, _rate))(_noise)


@register("noise_grid", sql("corpus", f"""@r AS (
  SELECT id, y, seed, rate, row_number() OVER (PARTITION BY seed, rate
    ORDER BY {sql_draw('seed', "'flip'", 'id')}, id) AS rn, count(*) OVER (PARTITION BY seed, rate) AS c
  FROM corpus, (SELECT unnest([42, 7]) AS seed), (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS rate))
  SELECT id, seed, rate, CASE WHEN rn <= round_even(rate * c, 0) THEN 1 - y ELSE y END AS y_noisy,
    rn <= round_even(rate * c, 0) AS mask FROM r"""))
def _(spark, sf):
    return sp.noise_grid(corpus(spark, sf), [0.05, 0.1, 0.2], [42, 7]).select(
        "id", "seed", "rate", "y_noisy", "mask")


@register("triplets", sql("vectors", f"""@r AS (
  SELECT id, y10 AS y, row_number() OVER (PARTITION BY y10 ORDER BY {sql_draw(42, "'order'", 'id')}, id) - 1
    AS pos, count(*) OVER (PARTITION BY y10) AS n FROM vectors),
  c AS (SELECT DISTINCT y, n FROM r),
  o AS (SELECT a.y, b.y AS oy, b.n AS o_n, row_number() OVER (PARTITION BY a.y ORDER BY b.y) - 1 AS i,
    count(*) OVER (PARTITION BY a.y) AS k FROM c a JOIN c b ON a.y <> b.y),
  a AS (SELECT id, r.y, oy, floor({sql_draw(42, "'positive'", 'id')} * (n - 1)) AS p0, pos,
    floor({sql_draw(42, "'negative'", 'id')} * o_n) AS q
    FROM r JOIN o ON o.y = r.y AND o.i = floor({sql_draw(42, "'class'", 'id')} * o.k) WHERE n > 1)
  SELECT a.id AS anchor, p.id AS positive, g.id AS negative, a.y, a.oy AS neg_y
  FROM a JOIN r p ON p.y = a.y AND p.pos = a.p0 + CASE WHEN a.p0 >= a.pos THEN 1 ELSE 0 END
    JOIN r g ON g.y = a.oy AND g.pos = a.q"""))
def _(spark, sf):
    return sp.triplets(vectors(spark, sf).select("id", F.col("y10").alias("y")))


@register("select_by_split", sql("corpus", f"""@kept AS (SELECT id FROM (SELECT id,
    row_number() OVER (PARTITION BY y ORDER BY {sql_draw(42, "'subsample'", 'id')}, id) AS rn,
    min(c) OVER () AS c FROM (SELECT *, count(*) OVER (PARTITION BY y) AS c FROM corpus))
    WHERE rn <= least(1000, c))
  SELECT id, source, y FROM corpus WHERE id IN (SELECT id FROM kept)"""))
def _(spark, sf):
    c = corpus(spark, sf)
    kept = sp.balanced_subsample(c.select("id", "y"), 2000).select("id")
    return c.join(kept, "id", "left_semi").select("id", "source", "y")

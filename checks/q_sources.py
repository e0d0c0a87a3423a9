"""S1-S13, P1-P5, P10, P11, P17, J1, J2, A1, W1, W4, U1, U2."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelaudit.functions import jsontext as js
from labelaudit.functions.text import cut, datetime_text, slug
from labelaudit.session import scratch_path
from labelaudit.sources import dumps, export as ex, requests as rq, tables, traffic_sources as ts

from .registry import register
from .views import corpus, requests, sources, sql, sub_sources

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
_SPAN = f"datetime >= TIMESTAMP '{START}' AND datetime < TIMESTAMP '{END}'"
_ITEM = ("headers, request, decision, campaign_id, traffic_source_id, "
         "strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, body")


@register("requests_by_source", sql("shaped", f"""SELECT id, {_ITEM} FROM shaped
  WHERE traffic_source_id = 7 AND decision IN ('bot', 'offer') AND {_SPAN} AND NOT duplicated
  ORDER BY shaped.datetime DESC, id LIMIT 50"""))
def _(spark, sf):
    rows = rq.fetch_by_source(requests(spark, sf), 7, ["bot", "offer"], 50, START, END)
    return rq.pipeline_items(rows, F.col("id"))


@register("requests_for_sources", sql("shaped", f"""SELECT id, {_ITEM} FROM (SELECT *, row_number() OVER (
    PARTITION BY traffic_source_id ORDER BY datetime DESC, id) AS rn FROM shaped
  WHERE traffic_source_id IN (1, 7, 24) AND NOT duplicated) WHERE rn <= 20"""))
def _(spark, sf):
    return rq.pipeline_items(rq.fetch_for_sources(requests(spark, sf), [1, 7, 24], None, 20), F.col("id"))


@register("filter_requests", sql("requests", f"""SELECT id FROM requests
  WHERE decision IN ('bot') AND {_SPAN} AND NOT duplicated"""))
def _(spark, sf):
    return rq.filter_requests(requests(spark, sf), ["bot"], START, END).select("id")


@register("sources_find", sql("sources", """SELECT id, name, active FROM sources
  WHERE active AND lower(trim(name)) IN ('nation_3', 'nation_7', 'nation_0') ORDER BY id"""))
def _(spark, sf):
    return ts.find_all(sources(spark, sf), names=[" Nation_3", "NATION_7 ", "nation_0"])


@register("sources_children", sql("sources sub_sources", """
  SELECT c.id, c.name, true AS active, parent_id, s.name AS parent_name
  FROM sub_sources c LEFT JOIN sources s ON s.id = parent_id ORDER BY c.id"""))
def _(spark, sf):
    return ts.find_children(sub_sources(spark, sf), sources(spark, sf))


@register("sources_by_id", sql("sources", "SELECT id, name, active FROM sources WHERE id IN (3, 5, 8)"))
def _(spark, sf):
    return ts.find_all(sources(spark, sf), active_only=False, ids=[3, 5, 8])


@register("source_names", sql("requests sources", """SELECT traffic_source_id, s.name AS source_name,
  count(*) AS n FROM requests JOIN sources s ON s.id = traffic_source_id GROUP BY ALL"""))
def _(spark, sf):
    named = ts.with_source_name(requests(spark, sf), sources(spark, sf))
    return named.groupBy("traffic_source_id", "source_name").agg(F.count("*").alias("n"))


@register("source_ids", sql("requests sources", """SELECT s.name AS source_name, s.id AS traffic_source_id,
  count(*) AS n FROM requests JOIN sources s ON s.id = traffic_source_id GROUP BY ALL"""))
def _(spark, sf):
    named = ts.with_source_name(requests(spark, sf), sources(spark, sf)).drop("traffic_source_id")
    return ts.with_source_id(named, sources(spark, sf)).groupBy("source_name", "traffic_source_id").agg(
        F.count("*").alias("n"))


@register("source_requests_join", sql("requests sources", """SELECT r.id, s.name AS source_name
  FROM requests r JOIN sources s ON s.id = r.traffic_source_id WHERE s.active"""))
def _(spark, sf):
    active = ts.find_all(sources(spark, sf))
    return ts.with_source_name(requests(spark, sf), active).select("id", "source_name")


@register("membership_semi_join", sql("requests sources", """SELECT id, decision FROM requests
  WHERE traffic_source_id IN (SELECT id FROM sources WHERE active)"""))
def _(spark, sf):
    active = ts.find_all(sources(spark, sf)).select(F.col("id").alias("traffic_source_id"))
    return requests(spark, sf).join(active, "traffic_source_id", "left_semi").select("id", "decision")


@register("label_groups", sql("requests", """SELECT id, CASE decision WHEN 'offer' THEN 'unsafe'
  ELSE decision END AS label_group FROM requests"""))
def _(spark, sf):
    return rq.with_label_group(requests(spark, sf)).select("id", "label_group")


@register("shape_request", sql("shaped", "SELECT id, headers, request, body FROM shaped"))
def _(spark, sf):
    return rq.shape_requests(requests(spark, sf)).select("id", "headers", "request", "body")


@register("pipeline_items", sql("shaped", f"SELECT {_ITEM} FROM shaped"))
def _(spark, sf):
    return rq.pipeline_items(rq.shape_requests(requests(spark, sf)))


@register("slug", sql("sources", r"""SELECT DISTINCT x AS name,
  CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (
  SELECT x, trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (
    SELECT unnest(['  ' || name || ' & Bar! ', url, regexp_replace(name, '[A-Z0-9]', '-', 'g')]) AS x
    FROM pages, sources WHERE sources.id = page_id % 25))"""))
def _(spark, sf):
    named = ts.with_source_name(
        spark.read.parquet(f"{sf}/pages.parquet").withColumn("traffic_source_id", (F.col("page_id") % 25)),
        sources(spark, sf))
    texts = named.select(F.explode(F.array(
        F.concat(F.lit("  "), "source_name", F.lit(" & Bar! ")), F.col("url"),
        F.regexp_replace("source_name", "[A-Z0-9]", "-"))).alias("name"))
    return texts.distinct().select("name", slug("name").alias("slug"))


@register("datetime_text", sql("requests",
          "SELECT id, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS text FROM requests"))
def _(spark, sf):
    return requests(spark, sf).select("id", datetime_text("datetime").alias("text"))


@register("report_fields", sql("corpus", """SELECT id, substr(headers, 1, 500) AS headers_raw,
  substr(request, 1, 300) AS request_raw, round(length(headers) / 7.0::DOUBLE, 4) AS share FROM corpus"""))
def _(spark, sf):
    return corpus(spark, sf).select(
        "id", cut("headers", 500).alias("headers_raw"), cut("request", 300).alias("request_raw"),
        F.round(F.length("headers") / 7.0, 4).alias("share"))


@register("counts_by_decision", sql("requests", """SELECT traffic_source_id, decision, count(*) AS n
  FROM requests GROUP BY ALL"""))
def _(spark, sf):
    return rq.counts_by_decision(requests(spark, sf))


@register("newest_per_group", sql("requests", """SELECT id, traffic_source_id, decision FROM (
  SELECT *, row_number() OVER (PARTITION BY traffic_source_id, decision ORDER BY datetime DESC, id) AS rn
  FROM requests) WHERE rn <= 10"""))
def _(spark, sf):
    return rq.newest(requests(spark, sf), ["traffic_source_id", "decision"], 10).select(
        "id", "traffic_source_id", "decision")


@register("sorted_sources", sql("sources", "SELECT id, name FROM sources ORDER BY name, id"))
def _(spark, sf):
    return sources(spark, sf).orderBy("name", "id").select("id", "name")


def _exported(spark, sf, limit=None):
    root = scratch_path(spark, "export")
    active = ts.find_all(sources(spark, sf))
    return root, ex.export(requests(spark, sf), active, root, limit_per_group=limit)


_ACTIVE = "traffic_source_id IN (SELECT id FROM sources WHERE active)"


@register("export_groups", sql("shaped sources", f"""SELECT {_ITEM}, replace(lower(s.name), '_', '-')
  AS traffic_source, CASE decision WHEN 'offer' THEN 'unsafe' ELSE decision END AS label_group
  FROM shaped JOIN sources s ON s.id = traffic_source_id WHERE s.active AND NOT duplicated"""))
def _(spark, sf):
    root, _ = _exported(spark, sf)
    return spark.read.schema(dumps.ITEM_SCHEMA + ", traffic_source string, label_group string").json(
        f"{root}/datasets")


@register("export_manifest", sql("requests sources", """@grid AS (SELECT s.id, s.name, g.label_group, g.decision
    FROM sources s, (VALUES ('bot','bot'), ('unsafe','offer'), ('safe','safe')) g(label_group, decision)
    WHERE s.active)
  SELECT 'traffic_source' AS scope, '2024-01-01 00:00:00' AS start_inclusive, NULL::VARCHAR AS end_exclusive,
    id AS traffic_source_id, name AS traffic_source_name, label_group, decision AS decisions,
    least(40, (SELECT count(*) FROM requests r WHERE r.traffic_source_id = grid.id
      AND r.decision = grid.decision AND NOT duplicated AND datetime >= '2024-01-01')) AS rows,
    'datasets/traffic_source=' || replace(lower(name), '_', '-') || '/label_group=' || label_group AS path FROM grid"""))
def _(spark, sf):
    root, active = scratch_path(spark, "export"), ts.find_all(sources(spark, sf))
    ex.export(requests(spark, sf), active, root, limit_per_group=40, start="2024-01-01 00:00:00", write_empty=True)
    written = ex.read_manifest(spark, root)
    return written.select(
        "scope", "interval.*", "traffic_source_id", "traffic_source_name", "label_group",
        F.array_join("decisions", ",").alias("decisions"), "rows", F.replace("path", F.lit(f"{root}/"), F.lit("")).alias("path"))


@register("load_labelled", sql("shaped sources", f"""SELECT headers, request,
  CAST(decision = 'bot' AS INTEGER) AS y FROM shaped
  WHERE decision IN ('bot', 'offer') AND NOT duplicated AND {_ACTIVE}"""))
def _(spark, sf):
    root, _ = _exported(spark, sf)
    folder = f"{root}/datasets/traffic_source=*"
    return dumps.load_labelled(spark, f"{folder}/label_group=unsafe", f"{folder}/label_group=bot",
                               json_lines=True).select("headers", "request", "y")


# a source for each layout of dump names, and one without an unsafe dump
_LAYOUTS = {"nation-7": "{s}-{g}.json", "nation-8": "{s}-{g}-2024-07.json", "nation-9": "{s}/{s}-{g}.json", "nation-12": "{s}/{s}-{g}-2.json"}


def _dumps(spark, sf):
    """Two folders of dumps, with names that are no plain words."""
    root, _ = _exported(spark, sf)
    folders = [f"{root}/dumps.v1+x", f"{root}/raw dumps/raw"]
    for k, (source, layout) in enumerate([*_LAYOUTS.items(), ("nation-11", "{s}-{g}.json")]):
        for group in ("bot", "unsafe") if source in _LAYOUTS else ("bot",):
            rows = spark.read.schema(dumps.ITEM_SCHEMA).json(f"{root}/datasets/traffic_source={source}/label_group={group}")
            rows.write.json(f"{folders[k % 2]}/{layout.format(s=source, g=group)}")
    return folders


_NAMED = "s.name IN ('NATION_7', 'NATION_8', 'NATION_9', 'NATION_12') AND s.active"


@register("load_source", sql("shaped sources", f"""SELECT replace(lower(s.name), '_', '-') AS source, headers, request,
  CAST(decision = 'bot' AS INTEGER) AS y FROM shaped JOIN sources s ON s.id = traffic_source_id
  WHERE decision IN ('bot', 'offer') AND NOT duplicated AND {_NAMED}"""))
def _(spark, sf):
    folders = _dumps(spark, sf)
    return reduce(DataFrame.unionByName, [
        dumps.load_source(spark, s, folders, json_lines=True).select(F.lit(s).alias("source"), "headers", "request", "y") for s in _LAYOUTS])


@register("load_exported_source", sql("shaped sources", """SELECT headers, request,
  CAST(decision = 'bot' AS INTEGER) AS y FROM shaped JOIN sources s ON s.id = traffic_source_id
  WHERE decision IN ('bot', 'offer') AND NOT duplicated AND s.name = 'NATION_7' AND s.active"""))
def _(spark, sf):
    root, _ = _exported(spark, sf)
    return dumps.load_export(spark, root, "nation-7").select("headers", "request", "y")


@register("list_sources", sql("sources", f"SELECT replace(lower(s.name), '_', '-') AS source FROM sources s WHERE {_NAMED}"))
def _(spark, sf):
    return dumps.list_sources(spark, _dumps(spark, sf))


@register("list_exported_sources", sql("requests sources", """SELECT DISTINCT replace(lower(s.name), '_', '-') AS source
  FROM sources s WHERE s.active
  AND EXISTS (SELECT 1 FROM requests WHERE traffic_source_id = s.id AND decision = 'bot' AND NOT duplicated)
  AND EXISTS (SELECT 1 FROM requests WHERE traffic_source_id = s.id AND decision = 'offer' AND NOT duplicated)"""))
def _(spark, sf):
    root, _ = _exported(spark, sf)
    return dumps.list_export_sources(dumps.load_export(spark, root))


@register("union_label_groups", sql("requests", """SELECT id, 0 AS y FROM requests WHERE decision = 'offer'
  UNION ALL SELECT id, 1 AS y FROM requests WHERE decision = 'bot'"""))
def _(spark, sf):
    r = requests(spark, sf).select("id", "decision")
    return (r.where("decision = 'offer'").select("id", F.lit(0).alias("y"))
            .unionByName(r.where("decision = 'bot'").select("id", F.lit(1).alias("y"))))


@register("intersect_sources", sql("requests", """SELECT traffic_source_id FROM requests WHERE decision = 'bot'
  INTERSECT SELECT traffic_source_id FROM requests WHERE decision = 'offer'"""))
def _(spark, sf):
    r = requests(spark, sf)
    return r.where("decision = 'bot'").select("traffic_source_id").intersect(
        r.where("decision = 'offer'").select("traffic_source_id"))


def _report(spark, sf):
    return corpus(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("bot_share"),
        F.max("headers").alias("sample"))


_REPORT = sql("corpus", """SELECT source, count(*) AS n, round(avg(y), 9) AS bot_share,
  max(headers) AS sample FROM corpus GROUP BY source""")


@register("csv_table", _REPORT.replace("SELECT source, count(*)", "SELECT source::DOUBLE AS source, count(*)::DOUBLE"))
def _(spark, sf):
    path = scratch_path(spark, "report")
    tables.save_csv(_report(spark, sf), path, ["source", "n", "bot_share", "sample"])
    return tables.read_table(spark, path)


@register("json_table", _REPORT)
def _(spark, sf):
    path, report = scratch_path(spark, "report"), _report(spark, sf)
    tables.save_json(report, path)
    return tables.load_json(spark, path, report.schema)


@register("array_table", """SELECT vec_id AS id, i AS pos, embedding[i + 1]::DOUBLE AS x
  FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)""")
def _(spark, sf):
    path = scratch_path(spark, "arrays")
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    tables.save_arrays(emb, path, ["embedding"])
    return spark.read.parquet(path).select("id", F.posexplode("embedding").alias("pos", "x")).withColumn(
        "x", F.col("x").cast("double")).withColumn("pos", F.col("pos").cast("long"))


@register("load_study", sql("corpus", """SELECT 'nation-7' AS source, count(*) AS n, round(avg(y), 9) AS bot_share
  FROM corpus WHERE source = 7"""))
def _(spark, sf):
    root = scratch_path(spark, "study")
    report = (_report(spark, sf).drop("sample")
              .withColumn("source", F.concat(F.lit("nation-"), F.col("source").cast("string"))))
    tables.save_study({name: report for name in tables.STUDY_TABLES}, root)
    return tables.load_study(spark, root, "nation-7")["summary"]

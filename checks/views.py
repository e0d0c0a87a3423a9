"""Input views derived from the test tables by the same rule in Spark and SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelaudit.functions.draws import draw
from labelaudit.functions.jsontext import map_text, with_user_agent
from labelaudit.session import configure

SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def sources(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        (F.col("n_regionkey") != 0).alias("active"))


def sub_sources(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("parent_id"))


def requests(spark, sf) -> DataFrame:
    # one small file is read by one task; the texts made of it deserve all cores
    e = table(spark, sf, "events").repartition(spark.sparkContext.defaultParallelism, "event_id")
    n, user = F.col("event_id"), F.col("user_id")
    bot = F.col("event_type").isin("error", "view")
    agent = (F.when(bot & (n % 3 == 0), F.lit("curl/8.4.0"))
             .when(bot & (n % 3 == 1), F.lit("facebookexternalhit/1.1"))
             .otherwise(F.concat(F.lit("Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/"),
                                 (n % 15 + 110).cast("string"), F.lit(".0.0.0 Safari/537.36"))))

    def entry(key, value, cond=F.lit(True)):
        return F.when(cond, F.struct(F.lit(key).alias("key"), value.alias("value")))

    headers = F.map_from_entries(F.array_compact(F.array(
        entry("host", F.concat(F.lit("h"), (user % 7).cast("string"), F.lit(".example.org"))),
        entry("accept", F.lit("*/*")),
        entry("accept-language", F.lit("en-US,en;q=0.9"), n % 2 == 0),
        entry("cf-ray", F.substring(F.md5(n.cast("string")), 1, 12)),
        entry("dnt", F.lit("1"), n % 5 == 0),
        entry("user-agent", agent, n % 11 == 0))))
    cpc = (F.when(n % 6 == 0, F.lit("{{cpc}}")).when(n % 6 == 1, F.lit("{{cpc}"))
           .otherwise(F.col("value").cast("string")))
    params = F.map_from_entries(F.array(
        entry("k", F.get_json_object("props", "$.k")), entry("src", F.col("event_type")),
        entry("cpc", cpc)))
    empty = F.create_map().cast("map<string,string>")
    return e.select(
        n.alias("id"), F.col("ts").alias("datetime"), user.alias("campaign_id"),
        (user % 25).alias("traffic_source_id"),
        F.when(bot, "bot").when(F.col("event_type").isin("click", "purchase"), "offer")
        .otherwise("safe").alias("decision"),
        (n % 10 == 0).alias("duplicated"), agent.alias("user_agent"), headers.alias("headers"),
        params.alias("params"), F.when(n % 13 != 0, empty).alias("body"))


REQUESTS = """requests AS (
  SELECT event_id AS id, ts AS datetime, user_id AS campaign_id,
    user_id % 25 AS traffic_source_id,
    CASE WHEN event_type IN ('error','view') THEN 'bot'
         WHEN event_type IN ('click','purchase') THEN 'offer' ELSE 'safe' END AS decision,
    event_id % 10 = 0 AS duplicated, agent AS user_agent,
    map_from_entries(list_filter([
      {'key': 'host', 'value': 'h' || (user_id % 7) || '.example.org'},
      {'key': 'accept', 'value': '*/*'},
      CASE WHEN event_id % 2 = 0 THEN {'key': 'accept-language', 'value': 'en-US,en;q=0.9'} END,
      {'key': 'cf-ray', 'value': substr(md5(event_id::VARCHAR), 1, 12)},
      CASE WHEN event_id % 5 = 0 THEN {'key': 'dnt', 'value': '1'} END,
      CASE WHEN event_id % 11 = 0 THEN {'key': 'user-agent', 'value': agent} END],
      lambda x: x IS NOT NULL)) AS headers,
    map_from_entries([
      {'key': 'k', 'value': json_extract_string(props, '$.k')},
      {'key': 'src', 'value': event_type},
      {'key': 'cpc', 'value': CASE event_id % 6 WHEN 0 THEN '{{cpc}}' WHEN 1 THEN '{{cpc}'
                                 ELSE value::VARCHAR END}]) AS params,
    event_id % 13 = 0 AS null_body
  FROM (SELECT *, CASE WHEN event_type IN ('error','view') AND event_id % 3 = 0 THEN 'curl/8.4.0'
      WHEN event_type IN ('error','view') AND event_id % 3 = 1 THEN 'facebookexternalhit/1.1'
      ELSE 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/' || (110 + event_id % 15)
        || '.0.0.0 Safari/537.36' END AS agent FROM events))"""


def _json_sql(m: str) -> str:
    return (f"'{{' || array_to_string(list_transform(map_entries({m}), "
            "lambda e: to_json(e.key)::VARCHAR || ': ' || to_json(e.value)::VARCHAR), ', ') || '}'")


SHAPED = f"""shaped AS (
  SELECT id, datetime, campaign_id, traffic_source_id, decision, duplicated,
    {_json_sql("full_headers")} AS headers, {_json_sql("params")} AS request, '{{}}' AS body
  FROM (SELECT *, CASE WHEN user_agent <> '' AND NOT map_contains(headers, 'User-Agent')
                        AND NOT map_contains(headers, 'user-agent')
          THEN map_from_entries(list_concat(map_entries(headers),
                 [{{'key': 'User-Agent', 'value': user_agent}}]))
          ELSE headers END AS full_headers FROM requests))"""


def corpus(spark, sf) -> DataFrame:
    """Labelled requests, with a few broken texts."""
    n = F.col("id")
    r = requests(spark, sf).where("decision IN ('bot', 'offer') AND NOT duplicated")
    return r.select(
        "id", F.col("traffic_source_id").alias("source"),
        F.when(n % 97 == 0, F.lit("not json")).when(n % 101 == 0, F.lit("[1,2]"))
        .when(n % 103 == 0, F.lit("{'User-Agent': 'x'}"))
        .when(n % 109 == 0, F.lit('{"User-Agent": "curl"} tail'))
        .otherwise(map_text(with_user_agent(F.col("headers"), F.col("user_agent")))).alias("headers"),
        F.when(n % 107 == 0, F.lit("{}")).otherwise(map_text("params")).alias("request"),
        (F.col("decision") == "bot").cast("int").alias("y"))


CORPUS = """corpus AS (
  SELECT id, traffic_source_id AS source,
    CASE WHEN id % 97 = 0 THEN 'not json' WHEN id % 101 = 0 THEN '[1,2]'
         WHEN id % 103 = 0 THEN '{''User-Agent'': ''x''}'
         WHEN id % 109 = 0 THEN '{"User-Agent": "curl"} tail' ELSE headers END AS headers,
    CASE WHEN id % 107 = 0 THEN '{}' ELSE request END AS request,
    CAST(decision = 'bot' AS INTEGER) AS y
  FROM shaped WHERE decision IN ('bot','offer') AND NOT duplicated)"""


def texts(spark, sf) -> DataFrame:
    """Whole document texts with a binary label; a small file is read by few tasks."""
    documents = table(spark, sf, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return documents.select(
        F.col("doc_id").alias("id"), "text", (F.col("lang") != "en").cast("int").alias("y"))


TEXTS = """texts AS (
  SELECT doc_id AS id, text, CAST(lang <> 'en' AS INTEGER) AS y FROM documents)"""


def doc_labels(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))


DOC_LABELS = "doc_labels AS (SELECT doc_id AS id, quality AS y FROM labels)"


def vectors(spark, sf) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    head = F.aggregate(F.slice(v, 1, 8), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), v.alias("v"), (head > 0).cast("int").alias("y"),
        F.col("label").alias("y10"), (F.col("label") % 4).alias("cluster"))


VECTORS = """vectors AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v,
    CAST(list_sum(list_slice(embedding::DOUBLE[], 1, 8)) > 0 AS INTEGER) AS y,
    label AS y10, label % 4 AS cluster FROM embeddings)"""


def sql_draw(seed, *parts: str) -> str:
    """The draw as SQL; `parts` are SQL expressions."""
    joined = " || '|' || ".join([f"'{seed}'" if isinstance(seed, int) else f"({seed})::VARCHAR",
                                 *[f"({p})::VARCHAR" for p in parts]])
    return f"(('0x' || substr(md5({joined}), 1, 13))::BIGINT / 4503599627370496.0)"


def probs2(spark, sf) -> DataFrame:
    """Two-class probabilities near the label, which is flipped for a tenth."""
    p1 = 0.7 * F.col("y") + 0.3 * draw(SEED, "proba", F.col("id"))
    given = F.when(draw(SEED, "given", F.col("id")) < 0.1, 1 - F.col("y")).otherwise(F.col("y"))
    return (vectors(spark, sf).withColumn("p", F.array(1 - p1, p1)).withColumn("y", given)
            .select("id", "y", "p"))


PROBS2 = f"""probs2 AS (
  SELECT id, CASE WHEN {sql_draw(SEED, "'given'", "id")} < 0.1 THEN 1 - y ELSE y END AS y,
    1 - (0.7 * y + 0.3 * {sql_draw(SEED, "'proba'", "id")}) AS p0,
    0.7 * y + 0.3 * {sql_draw(SEED, "'proba'", "id")} AS p1 FROM vectors)"""


def probs4(spark, sf) -> DataFrame:
    """Four cluster probabilities per row."""
    raw = F.array(*[draw(SEED, f"c{i}", F.col("id")) + 1e-9 for i in range(4)])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return vectors(spark, sf).select("id", "y", F.transform(raw, lambda x: x / total).alias("p"))


PROBS4 = f"""probs4 AS (
  SELECT id, y, list_transform(r, lambda x: x / list_sum(r)) AS p FROM (
    SELECT id, y, [{", ".join(f"{sql_draw(SEED, repr(f'c{i}'), 'id')} + 1e-9" for i in range(4))}] AS r
    FROM vectors))"""


def views4(spark, sf) -> DataFrame:
    """Cluster probabilities of five views per row."""
    seeded = vectors(spark, sf).select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("view"))
    raw = F.array(*[draw(SEED, f"c{i}", F.col("id"), F.col("view")) + 1e-9 for i in range(4)])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return seeded.select("id", "view", F.transform(raw, lambda x: x / total).alias("p"))


VIEWS4 = f"""views4 AS (
  SELECT id, view, list_transform(r, lambda x: x / list_sum(r)) AS p FROM (
    SELECT id, view,
      [{", ".join(f"{sql_draw(SEED, repr(f'c{i}'), 'id', 'view')} + 1e-9" for i in range(4))}] AS r
    FROM vectors, (SELECT unnest(generate_series(1, 5)) AS view)))"""


SOURCES = """sources AS (
  SELECT n_nationkey AS id, n_name AS name, n_regionkey <> 0 AS active FROM nation)"""
SUB_SOURCES = """sub_sources AS (
  SELECT s_suppkey AS id, s_name AS name,
    CASE WHEN s_suppkey % 10 <> 0 THEN s_nationkey END AS parent_id FROM supplier)"""

_SQL = {"sources": [SOURCES], "sub_sources": [SUB_SOURCES], "requests": [REQUESTS],
        "shaped": [REQUESTS, SHAPED], "corpus": [REQUESTS, SHAPED, CORPUS], "texts": [TEXTS],
        "doc_labels": [DOC_LABELS], "vectors": [VECTORS], "probs2": [VECTORS, PROBS2],
        "probs4": [VECTORS, PROBS4], "views4": [VECTORS, VIEWS4]}


def sql(views: str, body: str) -> str:
    """`body` after the WITH clauses of the named views. The body may start with
    further clauses, each ending in a comma, before its SELECT."""
    parts: list[str] = []
    for name in views.split():
        parts += [p for p in _SQL[name] if p not in parts]
    return "WITH " + ",\n".join(parts) + ("," if body.lstrip().startswith("@") else "") + "\n" + \
        body.lstrip().removeprefix("@")

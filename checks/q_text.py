"""P6-P9, P12-P16, H1-H6, M9-M17."""
from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions import heuristics as hr, jsontext as js, vectors as vec
from labelaudit.functions.draws import draw
from labelaudit.operators import views as vw
from labelaudit.operators.features import moments
from labelaudit.operators.reports import anchor_agreement, flag_counts

from .registry import register
from .views import corpus, probs2, probs4, sql, sql_draw, vectors

# JSON objects of a text column, or null; corpus values are strings only
_OBJ = lambda c: (f"CASE WHEN json_valid({c}) AND json_type({c}) = 'OBJECT' "
                  f"THEN ({c}::JSON)::MAP(VARCHAR, VARCHAR) END")
_TOLERANT = """coalesce(CASE WHEN json_valid(headers) AND json_type(headers) = 'OBJECT'
    THEN (headers::JSON)::MAP(VARCHAR, VARCHAR)
    WHEN headers LIKE '{''%' THEN (replace(headers, '''', '"')::JSON)::MAP(VARCHAR, VARCHAR) END,
    MAP {}::MAP(VARCHAR, VARCHAR))"""
_UA = f"""ua AS (SELECT id, y, source, headers, request, coalesce(m['User-Agent'], m['user-agent'], m['USER-AGENT'],
    list_filter(map_entries(m), lambda e: lower(e.key) = 'user-agent')[1].value, '') AS user_agent
  FROM (SELECT *, {_TOLERANT} AS m FROM corpus))"""
# The three patterns.
_FLAGS = "@" + _UA + """, flags AS (SELECT *, regexp_matches(request, '\\{\\{.*?\\}\\}') AS has_template,
    regexp_matches(user_agent, '(?i)facebookexternalhit|googlebot|bingbot|bot\\b|crawler|spider|slurp|bingpreview|headless')
      AS has_crawler_ua,
    regexp_matches(user_agent, '(?i)python-requests|curl|wget|scrapy|selenium|playwright|puppeteer|httpclient|okhttp|go-http-client|java/|libwww|aiohttp')
      AS has_script_ua FROM ua),
  anchors AS (SELECT *, has_template OR has_crawler_ua OR has_script_ua AS flag FROM flags)"""


@register("canonical_json", sql("corpus", f"""SELECT id, CASE WHEN m IS NOT NULL THEN
    '{{' || coalesce((SELECT string_agg(to_json(e.key)::VARCHAR || ':' || to_json(e.value)::VARCHAR, ',' ORDER BY e.key)
      FROM (SELECT unnest(map_entries(m)) AS e)), '') || '}}' ELSE headers END AS canonical
  FROM (SELECT id, headers, {_OBJ("headers")} AS m FROM corpus)"""))
def _(spark, sf):
    return corpus(spark, sf).select("id", js.canonical("headers").alias("canonical"))


@register("manual_features", sql("corpus", """SELECT id, length(headers) AS header_length,
  length(request) AS request_length, length(headers) - length(replace(headers, ':', '')) AS header_colons,
  length(request) - length(replace(request, ':', '')) AS request_colons FROM corpus"""))
def _(spark, sf):
    names = ("header_length", "request_length", "header_colons", "request_colons")
    return corpus(spark, sf).select("id", *[
        c.cast("long").alias(n) for c, n in zip(js.manual_counts("headers", "request"), names)])


@register("parse_object", sql("corpus", f"""SELECT id, e.key, e.value FROM (
  SELECT id, unnest(map_entries({_TOLERANT})) AS e FROM corpus)"""))
def _(spark, sf):
    return corpus(spark, sf).select("id", F.explode(js.parse_object("headers")))


@register("parse_strict", sql("corpus", f"""SELECT id, cardinality({_OBJ("headers")})::INTEGER AS n_keys FROM corpus"""))
def _(spark, sf):
    pairs = js.entries("headers")
    return corpus(spark, sf).select("id", F.when(pairs.isNotNull(), F.size(pairs)).alias("n_keys"))


@register("user_agent", sql("corpus", "@" + _UA + " SELECT id, user_agent FROM ua"))
def _(spark, sf):
    return corpus(spark, sf).select("id", js.user_agent("headers").alias("user_agent"))


@register("has_template", sql("corpus", _FLAGS + " SELECT id, has_template FROM anchors"))
def _(spark, sf):
    return corpus(spark, sf).select("id", hr.has_template(F.col("request")).alias("has_template"))


@register("has_crawler_ua", sql("corpus", _FLAGS + " SELECT id, has_crawler_ua FROM anchors"))
def _(spark, sf):
    return corpus(spark, sf).select("id", hr.has_crawler_ua(js.user_agent("headers")).alias("has_crawler_ua"))


@register("has_script_ua", sql("corpus", _FLAGS + " SELECT id, has_script_ua FROM anchors"))
def _(spark, sf):
    return corpus(spark, sf).select("id", hr.has_script_ua(js.user_agent("headers")).alias("has_script_ua"))


@register("heuristic_flags", sql("corpus", _FLAGS + """ SELECT id, user_agent, has_template, has_crawler_ua,
  has_script_ua, flag AS heuristic_bot_flag FROM anchors"""))
def _(spark, sf):
    return hr.with_flags(corpus(spark, sf)).select(
        "id", "user_agent", "has_template", "has_crawler_ua", "has_script_ua", "heuristic_bot_flag")


@register("weak_labels", sql("corpus", _FLAGS + " SELECT id, CASE WHEN flag THEN 1 ELSE -1 END AS weak FROM anchors"))
def _(spark, sf):
    return hr.with_flags(corpus(spark, sf)).select("id", hr.weak_label(F.col("heuristic_bot_flag")).alias("weak"))


@register("anchor_agreement", sql("corpus", _FLAGS + """ SELECT source, count(*) AS n,
  round(100.0::DOUBLE * count(*) FILTER (flag) / count(*), 6) AS coverage,
  count(*) FILTER (flag AND y = 0) AS contradictions,
  round(100.0::DOUBLE * count(*) FILTER (flag AND y = 1) / count(*) FILTER (flag), 6) AS agreement
  FROM anchors GROUP BY source"""))
def _(spark, sf):
    out = anchor_agreement(hr.with_flags(corpus(spark, sf)), "heuristic_bot_flag", by=["source"])
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "agreement")})


@register("flag_counts", sql("corpus", _FLAGS + """ SELECT count(*) AS n, count(*) FILTER (flag) AS flagged,
  round(count(*) FILTER (flag) / count(*)::DOUBLE, 9) AS rate,
  count(*) FILTER (flag AND y = 1) AS flagged_bot, count(*) FILTER (flag AND y = 0) AS flagged_human FROM anchors"""))
def _(spark, sf):
    return flag_counts(hr.with_flags(corpus(spark, sf)), "heuristic_bot_flag").withColumn(
        "rate", F.round("rate", 9))


# ---- vectors -------------------------------------------------------------

_LONG = "long AS (SELECT id, y, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM vectors)"


@register("zscore", sql("vectors", "@" + _LONG + """, m AS (SELECT pos, avg(x) AS a, stddev_pop(x) AS s FROM long GROUP BY pos)
  SELECT id, CAST(pos AS INTEGER) AS pos, round((x - a) / (s + 1e-8), 9) AS z FROM long JOIN m USING (pos)"""))
def _(spark, sf):
    v = vectors(spark, sf)
    mean, std = moments(v, "v")
    array = lambda a: F.array(*[F.lit(float(x)) for x in a])
    return v.select("id", F.posexplode(vec.zscore("v", array(mean), array(std))).alias("pos", "z")).withColumn(
        "z", F.round("z", 9))


@register("l2_normalize", sql("vectors", """SELECT id, CAST(i AS INTEGER) AS pos,
    round(v[i + 1] * (i + 1) / sqrt(list_sum(list_transform(v, lambda x, j: (x * j) * (x * j)))), 9) AS x
  FROM vectors, (SELECT unnest(generate_series(0, 63)) AS i)"""))
def _(spark, sf):
    stretched = F.transform("v", lambda x, i: x * (i + 1))
    return vectors(spark, sf).select("id", F.posexplode(vec.l2_normalize(stretched)).alias("pos", "x")).withColumn(
        "x", F.round("x", 9))


@register("concat_vectors", sql("probs4 probs2", """SELECT id, CAST(i AS INTEGER) AS pos,
  round(list_concat(a.p, [p0, p1])[i + 1], 9) AS x FROM probs4 a JOIN probs2 b USING (id),
  (SELECT unnest(generate_series(0, 5)) AS i)"""))
def _(spark, sf):
    both = probs4(spark, sf).select("id", "p").join(
        probs2(spark, sf).select("id", F.col("p").alias("q")), "id")
    return both.select("id", F.posexplode(F.concat("p", "q")).alias("pos", "x")).withColumn(
        "x", F.round("x", 9))


@register("argmax", sql("probs4", "SELECT id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS cluster FROM probs4"))
def _(spark, sf):
    return probs4(spark, sf).select("id", vec.argmax("p").alias("cluster"))


@register("threshold", sql("probs2", "SELECT id, CAST(p1 >= 0.5 AS INTEGER) AS pred FROM probs2"))
def _(spark, sf):
    return probs2(spark, sf).select("id", vec.threshold(F.col("p")[1]).alias("pred"))


@register("vector_jitter", sql("vectors", f"""SELECT id, view, CAST(pos AS INTEGER) AS pos, round(
    CASE WHEN {sql_draw(42, "'drop'", 'view', 'id', 'pos')} < 0.15 THEN 0 ELSE x END
    + 0.05::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_draw(42, "'noise'", 'view', 'id', 'pos', "'r'")}))
      * cos(2.0::DOUBLE * pi() * {sql_draw(42, "'noise'", 'view', 'id', 'pos', "'a'")}), 9) AS x
  FROM (SELECT id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM vectors),
    (SELECT unnest([1, 2]) AS view)"""))
def _(spark, sf):
    rows = vectors(spark, sf).withColumn("view", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select("id", "view", F.posexplode(
        vec.jitter("v", 42, F.col("view"), F.col("id"))).alias("pos", "x")).withColumn("x", F.round("x", 9))


# ---- views ---------------------------------------------------------------

_MASK_VERSIONS = lambda c: (
    f"array_to_string(list_transform(regexp_extract_all({c}, '\\d+(?:\\.\\d+)+|(?s:.)'), "
    "lambda t: CASE WHEN length(t) > 1 THEN regexp_replace(t, '[0-9]', 'X', 'g') ELSE t END), '')")
_VARY = lambda k, u: (
    f"CASE WHEN {u} < 1.0::DOUBLE / 3 THEN lower({k}) WHEN {u} < 2.0::DOUBLE / 3 THEN upper({k}) ELSE "
    f"array_to_string(list_transform(string_split({k}, '-'), "
    "lambda p: upper(p[1:1]) || lower(p[2:])), '-') END")


def _in(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _rebuilt(view: str, column: str, chance, out: str, fallback: str) -> str:
    """Entries k (order o, new key nk, json value nv) put together again."""
    return f"""SELECT c.id, {view} AS view, CASE WHEN c.m IS NULL THEN {fallback} ELSE
      CASE WHEN {chance('spaced')} < 0.5 THEN '{{' || coalesce(j.spaced, '') || '}}'
        ELSE '{{' || coalesce(j.compact, '') || '}}' END END AS {out}
    FROM (SELECT id, view, {column}, {_OBJ(column)} AS m FROM corpus, pool) c
    LEFT JOIN (SELECT id, view, string_agg(to_json(nk)::VARCHAR || ': ' || nv, ', ' ORDER BY o) AS spaced,
      string_agg(to_json(nk)::VARCHAR || ':' || nv, ',' ORDER BY o) AS compact FROM kept_{column} GROUP BY id, view) j
      ON j.id = c.id AND j.view = c.view"""


def views_sql(config: str, n_views: int) -> str:
    """Clauses pool, view_headers and view_request for a named config."""
    do = vw.chances(config)
    h = lambda tag, *k: sql_draw(42, f"'{tag}'", "c.id", "c.view", *k)
    r = lambda tag, *k: sql_draw(42, f"'request-{tag}'", "c.id", "c.view", *k)
    if do["agent"]:
        agent = f"'{vw.MASK}'"
    else:
        agent = f"CASE WHEN {h('agent', 'k')} < {do['versions']} THEN {_MASK_VERSIONS('v')} ELSE v END"
    templated = "regexp_matches(v, '\\{\\{.*?\\}\\}')"
    unmask = lambda c: f"regexp_replace({c}, '\\{{\\{{.*?\\}}\\}}', '{vw.MASK}', 'g')"
    keep_t = "" if not do["template"] else f"WHEN {templated} THEN to_json({unmask('v')})::VARCHAR"
    new_key = lambda f: f"CASE WHEN {f('case', 'k')} < {do['spelling']} THEN {_VARY('k', f('spelling', 'k'))} ELSE k END"
    unnested = lambda col: (f"SELECT id, view, e.key AS k, e.value AS v FROM (SELECT id, view, "
                            f"unnest(map_entries({_OBJ(col)})) AS e FROM corpus, pool)")
    return f"""@pool AS (SELECT unnest(generate_series(1, {n_views})) AS view),
  kept_headers AS (SELECT id, view, {h('order', 'k')} AS o, {new_key(h)} AS nk,
    CASE WHEN lower(k) = 'user-agent' THEN to_json({agent})::VARCHAR
      WHEN lower(k) NOT IN {_in(vw.SEMANTIC)} AND {h('mask', 'k')} < {do['header']}
        THEN '"{vw.MASK}"' ELSE to_json(v)::VARCHAR END AS nv
    FROM ({unnested('headers')}) c
    WHERE NOT (lower(k) IN {_in(vw.UNSTABLE)} AND {h('unstable', 'k')} < {do['unstable']})
      AND NOT (lower(k) IN {_in(vw.OPTIONAL)} AND {h('optional', 'k')} < {do['optional']})),
  kept_request AS (SELECT id, view, {r('order', 'k')} AS o, {new_key(r)} AS nk,
    CASE WHEN NOT {templated} AND {r('mask', 'k')} < {do['parameter']} THEN '"{vw.MASK}"'
      {keep_t} ELSE to_json(v)::VARCHAR END AS nv FROM ({unnested('request')}) c),
  view_headers AS ({_rebuilt('c.view', 'headers', h, 'headers', 'c.headers')}),
  view_request AS ({_rebuilt('c.view', 'request', r, 'request',
                             unmask('c.request') if do['template'] else 'c.request')})
  """


for _name in vw.STRENGTHS:
    def _aug(spark, sf, name=_name):
        pool = vw.view_pool(corpus(spark, sf), 1, name)
        return pool.select("id", "headers", "request")
    register(f"augment_{_name}", sql("corpus", views_sql(_name, 1) +
             "SELECT id, headers, request FROM view_headers JOIN view_request USING (id)"))(_aug)


@register("augment_headers", sql("corpus", views_sql("medium_http_aug", 1) +
          "SELECT id, headers FROM view_headers"))
def _(spark, sf):
    return corpus(spark, sf).select("id", vw.augment_headers(
        F.col("headers"), "medium_http_aug", 42, F.lit(1), F.col("id")).alias("headers"))


@register("augment_request", sql("corpus", views_sql("template_masking_aug", 1) +
          "SELECT id, request FROM view_request"))
def _(spark, sf):
    return corpus(spark, sf).select("id", vw.augment_request(
        F.col("request"), "template_masking_aug", 42, F.lit(1), F.col("id")).alias("request"))


@register("two_views", sql("corpus", views_sql("medium_http_aug", 2) + """SELECT id,
  max(CASE WHEN view = 1 THEN headers || ' ' || request END) AS view_1,
  max(CASE WHEN view = 2 THEN headers || ' ' || request END) AS view_2
  FROM view_headers JOIN view_request USING (id, view) GROUP BY id"""))
def _(spark, sf):
    return vw.two_views(corpus(spark, sf))


@register("view_pool", sql("corpus", views_sql("medium_http_aug", 5) +
          "SELECT id, CAST(view AS INTEGER) AS view, headers, request FROM view_headers JOIN view_request USING (id, view)"))
def _(spark, sf):
    return vw.view_pool(corpus(spark, sf), 5).select("id", "view", "headers", "request")


_KEYS = "SELECT id, unnest(map_keys(headers)) AS k FROM requests"


@register("vary_case", sql("requests", f"""SELECT id, k AS key, {_VARY('k', sql_draw(42, "'spelling'", 'id', 'k'))} AS varied
  FROM ({_KEYS})"""))
def _(spark, sf):
    from .views import requests
    keys = requests(spark, sf).select("id", F.explode(F.map_keys("headers")).alias("key"))
    return keys.withColumn("varied", js.vary_case(F.col("key"), draw(42, "spelling", F.col("id"), F.col("key"))))


@register("mask_versions", sql("requests", f"""SELECT id, {_MASK_VERSIONS("user_agent || ' v2 Win64 1.20.3'")} AS masked
  FROM requests"""))
def _(spark, sf):
    from .views import requests
    return requests(spark, sf).select("id", js.mask_versions(
        F.concat("user_agent", F.lit(" v2 Win64 1.20.3"))).alias("masked"))


@register("reserialise", sql("requests", f"""SELECT id, CASE WHEN spaced THEN
    '{{' || array_to_string(list_transform(e, lambda x: to_json(x.key)::VARCHAR || ': ' || to_json(x.value)::VARCHAR), ', ') || '}}'
    ELSE '{{' || array_to_string(list_transform(e, lambda x: to_json(x.key)::VARCHAR || ':' || to_json(x.value)::VARCHAR), ',') || '}}'
    END AS text FROM (SELECT id, map_entries(params) AS e, {sql_draw(42, "'spaced'", 'id')} < 0.5 AS spaced FROM requests)"""))
def _(spark, sf):
    from .views import requests
    pairs = F.transform(F.map_entries("params"), lambda e: F.struct(
        e["key"].alias("key"), js.quoted(e["value"]).alias("json")))
    return requests(spark, sf).select("id", vw.serialise(
        pairs, draw(42, "spaced", F.col("id")) < 0.5).alias("text"))

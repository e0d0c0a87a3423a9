"""Chat formatting by perspective rotation: every speaker of a dialogue in turn is the assistant.

A conversation with speakers A, B, C gives three renderings. In the one of A, A's turns are
`assistant` turns and are trained on; B and C are named users. Roles in `context` (system) are no
speakers: they stay what they are in every rendering and give none of their own.

A rendering is the segments of (conv_id, perspective) in order of `position`; `start` is the
character at which a segment begins, so pieces of a long dialogue can be written by many tasks.
Start places are sums over runs of `RUN` turns plus a sum inside the run, so a conversation of any
length is spread over tasks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RUN = 256                    # turns whose places are worked out together
OPEN, CLOSE = "<|turn|>", "<|end|>\n"     # fixed values: the markers of the format
UNKNOWN = "unknown"          # speaker of a turn without a role


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(conversations: DataFrame, context=("system",)) -> DataFrame:
    """(conv_id, perspective, position, turn, role, name, segment, start, train_from, train_to).

    conversations: (conv_id, turn, role, text); other columns are not read. Turns are in order of
    `turn`, then role, then text (nulls first); repeated rows are repeated turns. A null role is the
    speaker 'unknown', a null text is empty, a null conv_id is a conversation like any other.
    `train_from` and `train_to` bound the characters of the rendering that the loss counts (text and
    end marker of the assistant), null for all other segments. A dialogue in which nobody but
    `context` speaks has no rendering."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    speaker = F.coalesce("role", F.lit(UNKNOWN))
    turns = conversations.select(
        key.alias("_key"), "conv_id", "turn", speaker.alias("_speaker"), _plain(F.col("text")).alias("_text"),
        F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-1)).alias("_run"))
    views = (turns.where(~F.col("_speaker").isin(*context))
             .select("_key", F.col("_speaker").alias("perspective")).distinct())
    own, aside = F.col("_speaker") == F.col("perspective"), F.col("_speaker").isin(*context)
    role = F.when(aside, F.col("_speaker")).when(own, "assistant").otherwise("user")
    named = ~aside & ~own
    head = F.concat(F.lit(OPEN), role, F.when(named, F.concat(F.lit(" "), _plain(F.col("_speaker"))))
                    .otherwise(""), F.lit("\n"))
    rows = (turns.join(views, "_key")
            .withColumns({"role": role, "name": F.when(named, F.col("_speaker")), "_head": F.length(head),
                          "segment": F.concat(head, "_text", F.lit(CLOSE)), "_own": own})
            .withColumn("_size", F.length("segment").cast("long")))
    run = ["_key", "perspective", "_run"]
    order = Window.partitionBy(*run).orderBy("turn", "_speaker", "_text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = (rows.groupBy(*run).agg(F.count("*").alias("_turns"), F.sum("_size").alias("_chars")))
    earlier = Window.partitionBy("_key", "perspective").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    places = runs.select(*run, F.coalesce(F.sum("_turns").over(earlier), F.lit(0)).alias("_turns"),
                         F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_chars"))
    placed = rows.withColumns({"_at": F.row_number().over(order) - 1,
                               "_from": F.coalesce(F.sum("_size").over(before), F.lit(0))}).join(places, run)
    start = F.col("_chars") + F.col("_from")
    return placed.select(
        "conv_id", "perspective", (F.col("_turns") + F.col("_at")).alias("position"), "turn", "role", "name",
        "segment", start.alias("start"),
        F.when(F.col("_own"), start + F.col("_head")).alias("train_from"),
        F.when(F.col("_own"), start + F.col("_size") - 1).alias("train_to"))


# The same for DuckDB: whole windows in place of runs.
SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.*, v.perspective,
         CASE WHEN speaker = 'system' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
s AS (
  SELECT *, '<|turn|>' || role || coalesce(' ' || replace(name, '<|', '< |'), '') || chr(10) AS head FROM r),
u AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM s),
w AS (
  SELECT *, row_number() OVER o - 1 AS position,
         coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective
           ORDER BY turn NULLS FIRST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM u WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, position::BIGINT AS position, turn, role, name, segment, start::BIGINT AS start,
       CASE WHEN speaker = perspective THEN (start + length(head))::BIGINT END AS train_from,
       CASE WHEN speaker = perspective THEN (start + length(segment) - 1)::BIGINT END AS train_to
FROM w"""

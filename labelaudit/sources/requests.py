"""The request log: filter, order, limit and shape.

Input columns: id, datetime, campaign_id, traffic_source_id, decision,
user_agent, headers / params / body (map<string,string>), duplicated. Any Spark
reader will do (Parquet, JDBC, ...); the filters are pushed to it."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.jsontext import map_text, with_user_agent
from ..functions.text import datetime_text

# Label groups and the decisions they hold.
LABEL_GROUPS = {"bot": ("bot",), "unsafe": ("offer",), "safe": ("safe",)}
# Fields of an exported item, in order.
ITEM_FIELDS = ("headers", "request", "decision", "campaign_id", "traffic_source_id",
               "datetime", "body")


def filter_requests(requests: DataFrame, decisions: Sequence[str] | None = None,
                    start: str | None = None, end: str | None = None,
                    include_duplicates: bool = False) -> DataFrame:
    """Decisions (none = all) and a half-open time range in UTC."""
    if decisions:
        requests = requests.where(F.col("decision").isin(list(decisions)))
    if start:
        requests = requests.where(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end:
        requests = requests.where(F.col("datetime") < F.lit(end).cast("timestamp"))
    if not include_duplicates:
        requests = requests.where(~F.col("duplicated"))
    return requests


def shape_requests(requests: DataFrame) -> DataFrame:
    """Maps to JSON text, User-Agent put back; other columns are kept."""
    return requests.withColumns({
        "headers": map_text(with_user_agent(F.col("headers"), F.col("user_agent"))),
        "request": map_text("params"),
        "body": map_text("body"),
    }).drop("params", "user_agent", "duplicated")


def pipeline_items(records: DataFrame, *more: Column) -> DataFrame:
    """The seven item fields in export order, datetime as text, and any further
    columns."""
    return records.withColumn("datetime", datetime_text("datetime")).select(*ITEM_FIELDS, *more)


def newest(df: DataFrame, keys: Sequence[str], limit: int | None, id_col: str = "id") -> DataFrame:
    """The `limit` newest rows per group (all of them without a limit). Spark
    trims every map task to the limit before the shuffle, so a source that holds
    most of the log costs no more than another."""
    if not limit:
        return df
    order = Window.partitionBy(*keys).orderBy(F.col("datetime").desc(), F.col(id_col))
    return (df.withColumn("rn", F.row_number().over(order))
            .where(F.col("rn") <= limit).drop("rn"))


def fetch_by_source(requests: DataFrame, source_id: int, decisions=None, limit: int | None = None,
                    start=None, end=None, include_duplicates: bool = False) -> DataFrame:
    """All requests of one source, newest first."""
    rows = filter_requests(requests.where(F.col("traffic_source_id") == int(source_id)),
                           decisions, start, end, include_duplicates)
    rows = rows.orderBy(F.col("datetime").desc(), "id")
    return shape_requests(rows.limit(int(limit)) if limit else rows)


def fetch_for_sources(requests: DataFrame, source_ids: Sequence[int], decisions=None,
                      limit_per_source: int | None = None) -> DataFrame:
    """The same for many sources in one job."""
    rows = requests.where(F.col("traffic_source_id").isin([int(i) for i in source_ids]))
    rows = filter_requests(rows, decisions)
    return shape_requests(newest(rows, ["traffic_source_id"], limit_per_source))


def counts_by_decision(requests: DataFrame, source_id: int | None = None) -> DataFrame:
    """Requests per decision of a source, or of every source; duplicates count."""
    if source_id is not None:
        requests = requests.where(F.col("traffic_source_id") == int(source_id))
    return requests.groupBy("traffic_source_id", "decision").agg(F.count("*").alias("n"))


def with_label_group(requests: DataFrame,
                     groups: Mapping[str, Sequence[str]] = LABEL_GROUPS) -> DataFrame:
    """Adds `label_group`; a decision in no group is dropped, one in two groups
    appears twice. The map is an argument, a handful of rows."""
    pairs = [(d, g) for g, decisions in groups.items() for d in decisions]
    table = requests.sparkSession.createDataFrame(pairs, "decision string, label_group string")
    return requests.join(F.broadcast(table), "decision")

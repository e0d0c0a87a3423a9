"""The export job: requests by source and label group, and a manifest."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import slug
from .requests import (LABEL_GROUPS, filter_requests, newest, pipeline_items, shape_requests,
                       with_label_group)
from .traffic_sources import with_source_name

DATASET = ["traffic_source_id", "traffic_source_name", "label_group", "decisions", "rows", "path"]


def grouped_requests(requests: DataFrame, sources: DataFrame,
                     label_groups: Mapping[str, Sequence[str]] = LABEL_GROUPS,
                     limit_per_group: int | None = 10_000, start=None, end=None,
                     include_duplicates: bool = False) -> DataFrame:
    """Requests of the given sources with source_name and label_group, the newest
    `limit_per_group` of each. All campaigns of a source are included."""
    rows = filter_requests(requests, None, start, end, include_duplicates)
    rows = with_label_group(with_source_name(rows, sources), label_groups)
    return newest(rows, ["traffic_source_id", "label_group"], limit_per_group)


def manifest(grouped: DataFrame, sources: DataFrame,
             label_groups: Mapping[str, Sequence[str]] = LABEL_GROUPS,
             write_empty: bool = False) -> DataFrame:
    """One row per source and group: decisions and rows. Empty groups are listed
    only with `write_empty`."""
    counts = grouped.groupBy("traffic_source_id", "label_group").agg(F.count("*").alias("rows"))
    names = [F.struct(F.lit(g).alias("label_group"),
                      F.array(*[F.lit(d) for d in ds]).alias("decisions"))
             for g, ds in label_groups.items()]
    grid = sources.select(F.col("id").alias("traffic_source_id"), F.col("name").alias("traffic_source_name"),
                          F.explode(F.array(*names)).alias("g"))
    grid = grid.select("traffic_source_id", "traffic_source_name", "g.*")
    out = grid.join(counts, ["traffic_source_id", "label_group"], "left" if write_empty else "inner")
    return out.withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def export(requests: DataFrame, sources: DataFrame, root: str,
           label_groups: Mapping[str, Sequence[str]] = LABEL_GROUPS,
           limit_per_group: int | None = 10_000, start=None, end=None,
           include_duplicates: bool = False, write_empty: bool = False) -> DataFrame:
    """Writes `<root>/datasets/traffic_source=<slug>/label_group=<slug>` (JSON
    lines, as many files as tasks) and `<root>/manifest`, one JSON object with the scope, the interval
    and the list of datasets; returns the datasets as written (`read_manifest`)."""
    spark = requests.sparkSession
    rows = grouped_requests(requests, sources, label_groups, limit_per_group, start, end,
                            include_duplicates)
    shaped = shape_requests(rows)
    out = pipeline_items(shaped, slug("source_name").alias("traffic_source"),
                         slug("label_group").alias("label_group"))
    # rebalance: small groups share a task, a hot group is split over many
    out.hint("rebalance", "traffic_source", "label_group").write.partitionBy(
        "traffic_source", "label_group").json(f"{root}/datasets")
    written = spark.read.schema("traffic_source_id long, traffic_source string, label_group string").json(
        f"{root}/datasets")
    slugs = spark.createDataFrame([(g,) for g in label_groups], "name string").select(
        F.col("name"), slug("name").alias("label_group"))
    counted = written.join(F.broadcast(slugs), "label_group").select(
        "traffic_source_id", F.col("name").alias("label_group"))
    listed = manifest(counted, sources, label_groups, write_empty).withColumn(
        "path", F.concat(F.lit(f"{root}/datasets/traffic_source="), slug("traffic_source_name"),
                         F.lit("/label_group="), slug("label_group")))
    place = F.array_position(F.array(*[F.lit(g) for g in label_groups]), F.col("label_group"))
    # one object: as many datasets as sources times groups
    datasets = listed.agg(F.sort_array(F.collect_list(F.struct(
        "traffic_source_id", place.alias("place"), *DATASET[1:]))).alias("datasets"))
    datasets.select(
        F.lit("traffic_source").alias("scope"),
        F.struct(F.lit(start).cast("string").alias("start_inclusive"), F.lit(end).cast("string").alias("end_exclusive")).alias("interval"),
        F.transform("datasets", lambda d: F.struct(*[d[c].alias(c) for c in DATASET])).alias("datasets")).coalesce(1).write.option(
        "ignoreNullFields", False).json(f"{root}/manifest")
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row per dataset of a written manifest, with its scope and interval."""
    schema = ("scope string, interval struct<start_inclusive string, end_exclusive string>, datasets array<struct<"
              "traffic_source_id long, traffic_source_name string, label_group string, decisions array<string>, rows long, path string>>")
    return spark.read.schema(schema).json(f"{root}/manifest").select("scope", "interval", F.inline("datasets"))

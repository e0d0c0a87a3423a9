"""Exported items as a stream: read, flag, write."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.heuristics import weak_label, with_flags
from ..sources.dumps import ITEM_SCHEMA


def read_item_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Items of the JSON-lines files that arrive in a folder."""
    return (spark.readStream.schema(ITEM_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
            .json(path))


def flag_items(items: DataFrame) -> DataFrame:
    """Anchors and weak label of each item."""
    texts = items.withColumns({c: F.coalesce(F.col(c), F.lit("{}")) for c in ("headers", "request")})
    return with_flags(texts).withColumn("weak_label", weak_label(F.col("heuristic_bot_flag")))


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Append to Parquet until all present files are read; exactly once per file."""
    return (df.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())

"""Traffic-source dimension tables: (id, name, active) and (id, name, parent_id)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import name_key
from ..sizes import small_table


def find_all(sources: DataFrame, active_only: bool = True, ids: Sequence[int] | None = None,
             names: Sequence[str] | None = None) -> DataFrame:
    """Sources by id or by name (any case, outer blanks ignored), in id order."""
    if active_only:
        sources = sources.where("active")
    if ids:
        sources = sources.where(F.col("id").isin([int(i) for i in ids]))
    if names:
        sources = sources.where(name_key("name").isin([str(n).strip().lower() for n in names]))
    return sources.select("id", "name", "active").orderBy("id")


def find_children(children: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Sub-sources in id order, with the parent's name if `sources` is given."""
    rows = children.select("id", "name", F.lit(True).alias("active"), "parent_id")
    if sources is not None:
        parents = sources.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
        rows = rows.join(small_table(parents), "parent_id", "left").select(
            "id", "name", "active", "parent_id", "parent_name")
    return rows.orderBy("id")


def with_source_name(df: DataFrame, sources: DataFrame, source_id: str = "traffic_source_id") -> DataFrame:
    """Adds `source_name` by id; the dimension is broadcast if it is small."""
    names = sources.select(F.col("id").alias(source_id), F.col("name").alias("source_name"))
    return df.join(small_table(names), source_id)


def with_source_id(df: DataFrame, sources: DataFrame, source_name: str = "source_name") -> DataFrame:
    """Adds `traffic_source_id` by exact name."""
    ids = sources.select(F.col("name").alias(source_name), F.col("id").alias("traffic_source_id"))
    return df.join(small_table(ids), source_name)

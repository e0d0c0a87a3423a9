"""JSON dumps: one file (or folder) per source and label group."""
from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

ITEM_SCHEMA = ("headers string, request string, decision string, campaign_id long, "
               "traffic_source_id long, datetime string, body string")


def read_items(spark: SparkSession, paths, json_lines: bool = False) -> DataFrame:
    """Items of JSON dumps; a missing headers or request text is '{}'. Dumps are
    JSON arrays unless `json_lines` (which Spark can split)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    items = spark.read.schema(ITEM_SCHEMA).option("multiLine", not json_lines).json(paths)
    return items.withColumns({c: F.coalesce(F.col(c), F.lit("{}")) for c in ("headers", "request")})


def load_labelled(spark: SparkSession, unsafe, bots, json_lines: bool = False) -> DataFrame:
    """(headers, request, ..., y): unsafe rows are 0, bots 1."""
    return (read_items(spark, unsafe, json_lines).withColumn("y", F.lit(0))
            .unionByName(read_items(spark, bots, json_lines).withColumn("y", F.lit(1))))


def _below(path, folder: str):
    """The part of a listed path below `folder`, which may have a scheme or be relative (then to the
    working directory, or on other file systems to the user's folder)."""
    bare = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)"
    plain = F.regexp_replace(path, bare, "")
    root = posixpath.normpath(re.sub(bare, "", folder))
    found = F.when(plain.startswith(f"{posixpath.abspath(root).rstrip('/')}/"), F.lit(len(posixpath.abspath(root).rstrip("/")) + 2))
    if not root.startswith("/"):
        found = found.otherwise(F.locate(f"/{root}/", plain) + len(root) + 2)
    return F.substr(plain, found)


def dump_files(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """(dir_rank, path, parent, name) of the JSON dumps one or two levels deep: files, or folders of
    files as Spark writes them. Only file names are read; `path` is the dump's as Spark lists it."""
    found = None
    for rank, folder in enumerate(directories):
        parts = F.split(_below(F.col("path"), folder), "/")
        flat = parts[0].endswith(".json")
        listing = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
                   .option("recursiveFileLookup", True).load(folder).select("path", parts.alias("parts"), flat.alias("flat")))
        name = F.when(F.col("flat"), F.col("parts")[0]).otherwise(F.get("parts", F.lit(1)))
        inside = F.size("parts") - F.when(F.col("flat"), 1).otherwise(2)        # 1: a file of a folder
        path = F.expr("substr(path, 1, length(path) - if(inside > 0, 1 + length(substring_index(path, '/', -1)), 0))")
        listing = (listing.withColumns({"name": name, "inside": inside}).where("name LIKE '%.json' AND inside BETWEEN 0 AND 1")
                   .select(F.lit(rank).alias("dir_rank"), path.alias("path"),
                           F.when(~F.col("flat"), F.col("parts")[0]).alias("parent"), "name").distinct())
        found = listing if found is None else found.unionByName(listing)
    return found


def find_dump(spark: SparkSession, directories: Sequence[str], source: str, group: str) -> str:
    """First match: per directory the flat dump, a dated flat dump, then the same
    in the source's own folder; dated ones in name order."""
    files = dump_files(spark, directories)
    plain, dated = f"{source}-{group}.json", f"{source}-{group}-"
    exact = F.col("name") == plain
    is_dated = F.col("name").startswith(dated) & F.col("name").endswith(".json")
    flat, nested = F.col("parent").isNull(), F.col("parent") == source
    kind = (F.when(flat & exact, 0).when(flat & is_dated, 1)
            .when(nested & exact, 2).when(nested & is_dated, 3))
    best = files.withColumn("kind", kind).where("kind IS NOT NULL").orderBy(
        "dir_rank", "kind", "path").select("path").first()
    if best is None:
        raise FileNotFoundError(f"no {group} dump of {source} in {list(directories)}")
    return best[0]


def load_source(spark: SparkSession, source: str, directories: Sequence[str],
                json_lines: bool = False) -> DataFrame:
    """The labelled rows of one source."""
    return load_labelled(spark, find_dump(spark, directories, source, "unsafe"),
                         find_dump(spark, directories, source, "bot"), json_lines)


def list_sources(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """(source): those with a bot and an unsafe dump, in name order."""
    files = dump_files(spark, directories)

    def having(group):
        named = F.col("name").endswith(f"-{group}.json") | F.col("name").rlike(rf"-{group}-.*\.json$")
        return files.where(named).select(F.substring_index("name", f"-{group}", 1).alias("source"))
    return having("bot").intersect(having("unsafe")).orderBy("source")


def load_export(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """Labelled rows of a partitioned export; the source and the groups are
    partition filters, so other folders are not read."""
    items = (spark.read.schema(ITEM_SCHEMA + ", traffic_source string, label_group string")
             .json(f"{root}/datasets"))
    if source is not None:
        items = items.where(F.col("traffic_source") == source)
    items = items.where(F.col("label_group").isin("bot", "unsafe"))
    return items.withColumns({
        "headers": F.coalesce("headers", F.lit("{}")), "request": F.coalesce("request", F.lit("{}")),
        "y": (F.col("label_group") == "bot").cast("int")})


def list_export_sources(items: DataFrame) -> DataFrame:
    """(source): those of a partitioned export with both label groups."""
    def having(group):
        return items.where(F.col("label_group") == group).select(F.col("traffic_source").alias("source"))
    return having("bot").intersect(having("unsafe")).orderBy("source")

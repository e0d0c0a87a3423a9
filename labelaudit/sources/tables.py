"""Result tables: CSV, JSON and Parquet sinks and their readers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# The tables of a saved study.
STUDY_TABLES = ("summary", "classification", "clustering", "synthetic_noise", "knn_comparison",
                "real_audit", "top_suspects")


def save_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header; only `columns` if given."""
    out = df.select(*columns) if columns else df
    out.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def load_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_arrays(df: DataFrame, path: str, columns: Sequence[str], id_col: str = "id") -> None:
    """Vectors as Parquet `array<float>`, keyed by id."""
    df.select(id_col, *[F.col(c).cast("array<float>").alias(c) for c in columns]).write.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose columns become numbers where every cell is one."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    numbers = {c: F.col(f"`{c}`").try_cast("double") for c in raw.columns}
    odd = raw.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & n.isNull()).alias(c)
                    for c, n in numbers.items()]).first()
    return raw.select(*[n.alias(c) if odd[c] == 0 else F.col(f"`{c}`")
                        for c, n in numbers.items()])


def save_study(tables: dict[str, DataFrame], root: str) -> None:
    """Each table under `<root>/<name>`, partitioned by source. A source that is there
    already is replaced, other sources stay."""
    for name, df in tables.items():
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source").parquet(f"{root}/{name}"))


def load_study(spark: SparkSession, root: str, source: str) -> dict[str, DataFrame] | None:
    """The saved tables of one source; None if it has no summary."""
    def read(name):
        return spark.read.parquet(f"{root}/{name}").where(F.col("source") == source)
    try:
        found = not read("summary").isEmpty()
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
    return {name: read(name) for name in STUDY_TABLES} if found else None

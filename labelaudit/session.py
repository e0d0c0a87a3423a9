"""Session settings and the shared scratch folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Read at plan time, so they can be set on a session somebody else made.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # files say little of a table's rows in memory (a packed 5 MB may be 200): beyond this size a broadcast
    # passes through the driver only by a hint, or when the bytes were measured by a shuffle
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # the shuffle files of a query go when it ends, not when the driver collects its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a local session may fall back
    to a temporary folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.gettempdir() + "/labelaudit"
    return folder.rstrip("/")


_steps: list[list[str]] = []          # paths made by the steps that run now, the innermost last


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _steps:
        _steps[-1].append(path)
    return path


def stored(df: DataFrame, name: str = "part", by: Sequence[str] = ()) -> DataFrame:
    """`df` written once to the shared folder and read back: a lost executor costs
    nothing, later plans stay short, and only needed columns are read again.
    Everything of a session lies in one folder, to be removed after it. With `by`
    there is a folder per group, so that a group can be read alone."""
    path = scratch_path(df.sparkSession, name)
    if by:
        df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step(spark: SparkSession, make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """`make()`, stored; then the tables that it stored on its way are removed, so that a job of many steps
    does not hold the tables of all. Nothing that lasts longer may read them. Steps run one at a time."""
    _steps.append([])
    try:
        made = make()
    finally:
        paths = _steps.pop()
    kept = stored(made, name)
    context = spark.sparkContext
    for path in paths:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return kept

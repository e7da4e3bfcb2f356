"""Session factory, table access and the shared folder for written intermediates."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "tantu", cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the caller brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session gets a folder of its own; on a cluster that is an error, as executors would not
    share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tantu-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and the loss of an executor costs nothing.

    Used where a result is read more than once. The files are left to the folder's owner (see ``drop_written``).
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(path: str) -> None:
    """Remove a written table of a local folder."""
    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def hinted(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """df to be broadcast, if it is known to have ``most`` rows at most; else as the planner decides by its size."""
    return F.broadcast(df) if rows <= most else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df over all shuffle partitions by a hash of the columns, for short rows with long work.

    Adaptive execution would judge such rows by their bytes and give them to a few tasks; a number that is asked for stays.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))

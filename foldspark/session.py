"""Session helpers. On a cluster the session comes from the submitter; these are for local use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "foldspark", cores: int | str = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only in local mode where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = existing.get() if existing.isDefined() else local_folder(spark.sparkContext.master)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def local_folder(master: str) -> str:
    """A temporary folder for a single machine; executors elsewhere would each write to their own."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="foldspark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh directory below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    Unlike a cached block the table survives lost executors, and unlike a
    checkpointed RDD it keeps its size statistics and column pruning.
    """
    return kept_table(df, by)[0]


def kept_table(df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
    """``cut`` that also gives the table's place, for ``remove_table`` once a later one replaces it.

    ``by`` names a column of few values whose filters shall read only their own files.
    """
    path = scratch(df.sparkSession, "cut")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns)), path


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``kept_table`` wrote."""
    if not re.fullmatch(r".*/cut-[0-9a-f]{32}", path):
        raise ValueError(f"not a table that was kept: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

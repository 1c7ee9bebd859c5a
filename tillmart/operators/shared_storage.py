"""Cutting lineage through storage every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COMPRESSION = "zstd"  # of stored tables: keys of 32 hexadecimal digits take little over half of what snappy leaves


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Frames made and written inside leave no shuffle files behind once written; otherwise these stay until the driver
    happens to collect garbage, and the disk holds the shuffles of every step so far."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode without any setting."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tillmart-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and continue from the reliable checkpoint, so lost executors never replay its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_parquet(df: DataFrame, folder: str, mode: str = "error") -> None:
    with shuffles_released(df.sparkSession):
        df.write.mode(mode).parquet(folder, compression=COMPRESSION)


def store(df: DataFrame, name: str = "stored") -> DataFrame:
    """Compute ``df`` once and read it back from Parquet in the shared folder: each later pass reads only its columns."""
    folder = new_folder(df.sparkSession, name)
    write_parquet(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def store_sliced(df: DataFrame, name: str, conditions: Sequence[Column]) -> DataFrame:
    """``store``, one slice of the rows after the other. Each row meets one of ``conditions``, which the plan can push to its inputs."""
    folder = new_folder(df.sparkSession, name)
    for condition in conditions:
        write_parquet(df.filter(condition), folder, "append")
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over ``spark.sql.shuffle.partitions`` tasks.

    For steps that compute much per byte: adaptive execution sizes partitions by bytes and would leave few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

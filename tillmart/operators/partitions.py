"""Shuffle partitions in proportion to the input, so that the memory of a task does not grow with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PART_BYTES = 8 << 20  # of stored input to a partition; joined and sorted rows take several times that
SPLIT = "spark.sql.files.maxPartitionBytes"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SLICE = 128  # partitions' worth of rows to a slice, where a wide table is made slice by slice
SPLIT_BYTES = 16 << 20  # of a file to a scan task, which may group all of its rows in memory before they are shuffled


def stored_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Bytes of the files under those of ``paths`` that exist."""
    total = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        total += files.getContentSummary(at).getLength() if files.exists(at) else 0
    return total


def size_partitions(spark: SparkSession, n_bytes: int) -> None:
    """Shuffles begin with a partition for every ``PART_BYTES`` of input, and ``spark.sql.shuffle.partitions`` at least;
    adaptive execution joins those that turn out small. Scans read ``SPLIT_BYTES`` a task at most, and shuffled
    partitions are joined up to as much: a task sorts and groups them several times over."""
    for key in (SPLIT, ADVISORY):
        size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        spark.conf.set(key, f"{min(size, SPLIT_BYTES)}b")
    spark.conf.set(INITIAL, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))))


def partition_count(spark: SparkSession) -> int:
    """How many partitions a shuffle begins with."""
    return int(spark.conf.get(INITIAL, spark.conf.get("spark.sql.shuffle.partitions")))


def slices(key: str, buckets: int) -> list[Column]:
    """Conditions that cut rows by the bucket of their key into slices of about ``SLICE`` buckets: the shuffles of a table made one
    slice at a time take as much disk as one slice, however large the table."""
    n = max(1, -(-buckets // SLICE))
    return [F.pmod(F.hash(key), F.lit(buckets)) % n == i for i in range(n)] if n > 1 else [F.lit(True)]

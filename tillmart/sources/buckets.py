"""Tables bucketed by a key: joins, groupings and windows on it read them without a shuffle.

A bucket is the work of one task, so a key with more than a bucket's fair share of the rows would be one slow task, and
nothing at run time could split it. Such keys, fewer than there are buckets, are set apart with the rows that have no key, in
a table without buckets. Two tables split by the same heavy keys stay aligned: what joins or groups them on the key can be
done on their even parts and on their heavy parts, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.partitions import partition_count, slices
from ..operators.shared_storage import COMPRESSION, shuffles_released


@dataclass(frozen=True)
class Bucketed:
    """Rows of ordinary keys, bucketed, and rows of heavy keys or none."""

    even: DataFrame
    heavy: DataFrame

    def whole(self) -> DataFrame:
        return self.even.unionByName(self.heavy)


def bucket_count(spark: SparkSession) -> int:
    return partition_count(spark)


def heavy_keys(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Keys with more than one of ``buckets`` equal shares of the rows; so there are fewer of them than buckets."""
    with shuffles_released(rows.sparkSession):
        counted = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        share = counted.filter(F.col("_n") * buckets > rows.agg(F.count("*").alias("_all")).scalar()).select(key)
        return rows.sparkSession.createDataFrame(share.collect(), share.schema)


def align(rows: DataFrame, key: str, heavy: DataFrame) -> Bucketed:
    """The two parts of ``rows``, not written yet. ``heavy`` holds fewer keys than there are buckets."""
    few = F.broadcast(heavy.select(F.col(key).alias("_heavy")))
    apart = rows.join(few, F.col(key) == F.col("_heavy"), "left")
    is_heavy = F.col("_heavy").isNotNull() | F.col(key).isNull()
    return Bucketed(apart.filter(~is_heavy).drop("_heavy"), apart.filter(is_heavy).drop("_heavy"))


def aligned(work: Callable[..., DataFrame], *tables: Bucketed) -> Bucketed:
    """``work``, which joins or groups on the key, done on the even parts and on the heavy parts."""
    return Bucketed(work(*[t.even for t in tables]), work(*[t.heavy for t in tables]))


def save_bucketed(parts: Bucketed, key: str, folder: str, buckets: int, sort_by: Sequence[str] = (),
                  finish: Callable[[DataFrame], DataFrame] | None = None, placed: bool = False, sliced: bool = False) -> Bucketed:
    """Write both parts under ``folder`` and return them read back; the even part in one file per bucket.

    ``finish`` is applied to the even part once its rows lie by key: joins, groupings and windows on the key need no
    shuffle there. ``placed`` says that they do so already, coming from tables with the same buckets. ``sliced`` makes and
    writes the even part some buckets at a time, so that its shuffles do not all lie on the disk at once.
    """
    spark, mode = parts.even.sparkSession, "overwrite"
    with shuffles_released(spark):
        for condition in slices(key, buckets) if sliced else [F.lit(True)]:
            some = parts.even.filter(condition)
            some = some if placed else some.repartition(buckets, key)
            some = finish(some) if finish else some
            some.write.mode(mode).bucketBy(buckets, key).sortBy(key, *sort_by).option("path", f"{folder}/even").option(
                "compression", COMPRESSION).format("parquet").saveAsTable(_table(folder))
            mode = "append"
        parts.heavy.write.mode("overwrite").parquet(f"{folder}/heavy", compression=COMPRESSION)
    return _read(spark, folder, parts.heavy.schema)


def open_bucketed(spark: SparkSession, key: str, folder: str, buckets: int) -> Bucketed:
    """A table written by an earlier session, whose catalog does not know it."""
    schema = spark.read.parquet(f"{folder}/even").schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{_table(folder)}` ({columns}) USING parquet OPTIONS (path '{folder}/even') "
              f"CLUSTERED BY (`{key}`) INTO {int(buckets)} BUCKETS")
    return _read(spark, folder, schema)


def _read(spark: SparkSession, folder: str, schema) -> Bucketed:
    return Bucketed(spark.table(_table(folder)), spark.read.schema(schema).parquet(f"{folder}/heavy"))


def _table(folder: str) -> str:
    return "buckets_" + hashlib.md5(folder.encode()).hexdigest()

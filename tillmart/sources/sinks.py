"""Saving and exposing mart tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, name: str, layer: str | None = None, *, path: str | None = None,
               partition_by: list[str] | None = None) -> DataFrame:
    """Write a mart or fact table and return it read back, so that later work starts from the stored files.

    With ``path`` the table is Parquet under ``<path>/<layer>/<name>``; without, a catalog table ``<layer>.<name>``. Either
    is overwritten in place; ``versions.publish`` and ``versions.refresh`` keep the old table until the new one is whole.
    """
    spark, writer = df.sparkSession, df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        target = "/".join(p for p in (path, layer, name) if p)
        writer.parquet(target)
        return spark.read.parquet(target)
    if layer:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{layer}`")
    target = f"{layer}.{name}" if layer else name
    writer.format("parquet").saveAsTable(target)
    return spark.table(target)


def export_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Store the result of a saved metric query."""
    return save_table(df, name, "exports", path=path)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Ad hoc SQL over the given tables, or over views registered before."""
    register_views(spark, tables or {})
    return spark.sql(sql)


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: columns, rows, and the first and last day in its first date or time column."""
    rows = []
    for name, df in tables.items():
        times = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("date", "timestamp", "timestamp_ntz")]
        first, last = ((F.min(times[0]), F.max(times[0])) if times else (F.lit(None), F.lit(None)))
        rows.append(df.agg(F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
                           F.count("*").alias("n_rows"), first.cast("timestamp_ntz").alias("first_day"),
                           last.cast("timestamp_ntz").alias("last_day")))
    return reduce(DataFrame.unionAll, rows)


def list_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) for each table; schema only, no data is read."""
    return [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]

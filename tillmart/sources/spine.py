"""Calendar spine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPINE_DAYS = 3650


def date_spine(spark: SparkSession, start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """One row per day (``date_day``), both ends included; by default the 3,650 days before today."""
    end = dt.date.fromisoformat(str(end)) if end else dt.date.today() - dt.timedelta(days=1)
    start = dt.date.fromisoformat(str(start)) if start else end - dt.timedelta(days=SPINE_DAYS - 1)
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date_day"))


def spine_over(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    """The days from the first to the last ``ts`` of ``df``, per group of ``by`` when given."""
    ends = df.groupBy(*(by or [])).agg(F.min(ts).cast("date").alias("_a"), F.max(ts).cast("date").alias("_b"))
    return ends.filter("_a is not null").select(*(by or []), F.explode(F.sequence("_a", "_b")).alias("date_day"))

"""Revenue anomalies: robust seasonal-trend decomposition per series and residual scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import safe_div
from ..operators.shared_storage import spread
from ..sources.spine import spine_over
from .decompose import decompose

PERIOD, THRESHOLD = 7, 2.5


def daily_series(daily: DataFrame, key: str | None = None, day: str = "date_day", value: str = "total_revenue",
                 fill: bool = False) -> DataFrame:
    """(series, date_day, revenue) of the days with sales; ``fill`` adds every day between the first and the last one of
    a series with a revenue of 0, so that the spacing is even. Without ``key`` there is one series.
    """
    series = F.lit("all") if key is None else F.col(key).cast("string")
    sums = daily.groupBy(series.alias("series"), F.col(day).cast("date").alias("date_day")).agg(
        F.sum(value).cast("double").alias("revenue"))
    if not fill:
        return sums
    return (spine_over(sums, "date_day", ["series"]).join(sums, ["series", "date_day"], "left")
            .fillna(0.0, ["revenue"]))


def revenue_anomalies(series: DataFrame, period: int = PERIOD, threshold: float = THRESHOLD) -> DataFrame:
    """Trend, seasonal part, residual and its z-score for every day. One task holds one series: one row per day."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date_day").reset_index(drop=True)
        trend, seasonal = decompose(pdf["revenue"].to_numpy(float), period)
        return pdf.assign(trend=trend, seasonal=seasonal)

    parts = spread(series, "series").groupBy("series").applyInPandas(
        split, "series string, date_day date, revenue double, trend double, seasonal double")
    return residual_scores(parts, threshold)


def residual_scores(parts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """What trend and seasonal part leave, its z-score in the series, and whether that is beyond the threshold."""
    of_series = W.partitionBy("series")  # one row per day
    resid = F.col("revenue") - F.col("trend") - F.col("seasonal")
    score = safe_div(F.col("resid") - F.avg("resid").over(of_series), F.stddev_samp("resid").over(of_series))
    return (parts.withColumn("resid", resid).withColumn("z_score", score)
            .withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False))))


def top_anomalies(scored: DataFrame, k: int = 15) -> DataFrame:
    return scored.filter("is_anomaly").orderBy(F.abs("z_score").desc(), "series", "date_day").limit(k)


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Days, anomalies and their share, spikes and drops per series."""
    hit = F.col("is_anomaly")
    return (scored.groupBy("series").agg(
        F.min("date_day").cast("timestamp_ntz").alias("first_day"),
        F.max("date_day").cast("timestamp_ntz").alias("last_day"), F.count("*").alias("days"),
        F.count_if(hit).alias("anomalies"), F.count_if(hit & (F.col("z_score") > 0)).alias("spikes"),
        F.count_if(hit & (F.col("z_score") < 0)).alias("drops"))
        .withColumn("anomaly_share", safe_div("anomalies", "days")))

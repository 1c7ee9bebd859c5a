"""Small aggregate shapes used by several reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions import round_half_away, safe_div, value_map
from .shared_storage import materialize


def share_of_total(df: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """Rows per key and their percentage of all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("pct", round_half_away(safe_div(F.col("rows") * 100.0, total), digits))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Fixed-width histogram between the smallest and the largest value; the last bin is closed on both sides."""
    v = F.col(value).cast("double")
    df = materialize(df.select(value).filter(v.isNotNull()))  # read twice: for the ends and for the counts
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    lo, width = ends.getField("lo"), (ends.getField("hi") - ends.getField("lo")) / bins
    bin_no = F.least(F.coalesce(F.floor(F.try_divide(v - lo, width)), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return (df.withColumn("bin", bin_no).groupBy("bin").agg(F.count("*").alias("rows"))
            .select("bin", (lo + width * F.col("bin")).alias("bin_start"), "rows"))


def hierarchy_totals(df: DataFrame, parent: str, child: str, value: str) -> DataFrame:
    """Totals per (parent, child), per parent and overall; NULL marks the rolled-up level, as in a treemap."""
    return df.rollup(parent, child).agg(F.sum(value).alias(value), F.grouping_id().cast("bigint").alias("level"))


def minmax_profile(df: DataFrame, dims: Sequence[str], constant: float | None = 1.0) -> DataFrame:
    """Scale each column to 0..1. A constant column becomes ``constant``, or is left as it is when that is None."""
    df = materialize(df)  # read twice: for the ranges and for the rows
    ranges = df.agg(F.struct(*[F.struct(F.min(d).cast("double").alias("lo"), F.max(d).cast("double").alias("hi"))
                               .alias(d) for d in dims])).scalar()
    out = df
    for d in dims:
        lo, hi, v = ranges.getField(d).getField("lo"), ranges.getField(d).getField("hi"), F.col(d).cast("double")
        flat = v if constant is None else F.when(v.isNotNull(), F.lit(constant))
        out = out.withColumn(d, F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(flat))
    return out


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str,
            labels: dict[str, str] | None = None) -> DataFrame:
    """Columns to rows; column names are replaced by ``labels`` when given."""
    doubles = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    long = doubles.unpivot(list(ids), list(values), name, value)
    return long.withColumn(name, value_map(name, labels)) if labels else long


def pivot_first(df: DataFrame, row: str, column: str, values: Sequence[int], cell: str, prefix: str) -> DataFrame:
    """Dataframe-style pivot with known columns named ``<prefix><value>``."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.first(cell))
    return wide.select(row, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])


def lag_growth(value: str, window: WindowSpec) -> tuple:
    """(previous value, change over it) as columns; the change is NULL without a previous value or when it is 0."""
    prev = F.lag(value, 1).over(window)
    return prev, safe_div(F.col(value) - prev, prev)

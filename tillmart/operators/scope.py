"""Dashboard scope, prior period and as-of split."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(d: str | dt.date) -> Column:
    return F.lit(dt.date.fromisoformat(str(d))).cast("timestamp_ntz")


def scope(orders: DataFrame, locations: DataFrame, start: str | dt.date | None = None,
          end: str | dt.date | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Orders in the inclusive date range (open at an end that is not given) at the named locations (all when empty),
    with the location name."""
    dims = locations.select("location_id", "location_name")
    if names:
        dims = dims.filter(F.col("location_name").isin(list(names)))
    if start is not None:
        orders = orders.filter(F.col("ordered_at") >= _date(start))
    if end is not None:
        orders = orders.filter(F.col("ordered_at") <= _date(end))
    return orders.join(dims, "location_id")


def prior_year(day: str | dt.date) -> dt.date:
    d = dt.date.fromisoformat(str(day))
    try:
        return d.replace(year=d.year - 1)
    except ValueError:  # 29 February
        return d.replace(year=d.year - 1, day=28)


def prior_scope(orders: DataFrame, locations: DataFrame, start: str | dt.date, end: str | dt.date,
                names: Sequence[str] | None = None) -> DataFrame:
    """The same scope one year earlier."""
    return scope(orders, locations, prior_year(start), prior_year(end), names)


def cutoff_date(orders: DataFrame, holdout_days: int) -> Column:
    """Last order day minus the holdout, as a scalar subquery: computed once, no join."""
    last = F.max("ordered_at") - F.expr(f"INTERVAL {int(holdout_days)} DAYS")
    return orders.agg(last.alias("cutoff_date")).scalar()


def split_at_cutoff(orders: DataFrame, holdout_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(train, holdout): orders up to and including the cutoff, and those after it."""
    cutoff = cutoff_date(orders, holdout_days)
    return orders.filter(F.col("ordered_at") <= cutoff), orders.filter(F.col("ordered_at") > cutoff)

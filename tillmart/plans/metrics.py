"""Named metrics over the marts, and queries of metrics by dimension and time."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import safe_div, truncate_to
from ..operators.distinct import WHOLE
from ..operators.ordered import exact_medians
from ..sources.spine import spine_over

# Time column of each mart that metrics are dated by.
METRIC_TIME = {"orders": "ordered_at", "order_items": "ordered_at", "customers": "first_ordered_at",
               "locations": "opened_date"}


# Metric name -> (mart, aggregate function, expression).
SIMPLE = {
    "order_total": ("orders", F.sum, "order_total"),
    "orders": ("orders", F.count, "*"),
    "tax_paid": ("orders", F.sum, "tax_paid"),
    "order_cost": ("orders", F.sum, "order_cost"),
    "new_customer_orders": ("orders", F.count_if, "customer_order_number = 1"),
    "large_orders": ("orders", F.count_if, "order_total >= 20"),
    "food_orders": ("orders", F.count_if, "is_food_order"),
    "drink_orders": ("orders", F.count_if, "is_drink_order"),
    "revenue": ("order_items", F.sum, "product_price"),
    "food_revenue": ("order_items", F.sum, "case when is_food_item then product_price else 0 end"),
    "drink_revenue": ("order_items", F.sum, "case when is_drink_item then product_price else 0 end"),
    "customers": ("customers", F.countDistinct, "customer_id"),
    "count_lifetime_orders": ("customers", F.sum, "count_lifetime_orders"),
    "lifetime_spend_pretax": ("customers", F.sum, "lifetime_spend_pretax"),
    "lifetime_spend": ("customers", F.sum, "lifetime_spend"),
    "average_tax_rate": ("locations", F.avg, "tax_rate"),
}
MEDIANS = {"median_revenue": ("order_items", "product_price")}
# Ratio metric -> (numerator, denominator).
RATIOS = {
    "food_revenue_pct": ("food_revenue", "revenue"), "drink_revenue_pct": ("drink_revenue", "revenue"),
    "average_order_value": ("lifetime_spend_pretax", "count_lifetime_orders"),
}
# Mart -> foreign key -> mart it leads to.
FOREIGN = {
    "order_items": {"order_id": "orders", "product_id": "products"},
    "orders": {"location_id": "locations", "customer_id": "customers"},
}
# Mart -> dimension -> column.
DIMENSIONS = {
    "order_items": {d: d for d in ("order_item_id", "order_id", "product_id", "is_food_item", "is_drink_item")},
    "orders": {"order_total_dim": "order_total", **{d: d for d in (
        "order_id", "location_id", "customer_id", "is_food_order", "is_drink_order", "customer_order_number")}},
    "customers": {d: d for d in ("customer_id", "customer_name", "customer_type", "first_ordered_at", "last_ordered_at")},
    "locations": {d: d for d in ("location_id", "location_name", "opened_date")},
    "products": {d: d for d in ("product_id", "product_name", "product_type", "product_description", "product_price",
                                "is_food_item", "is_drink_item")},
    "supplies": {d: d for d in ("supply_id", "product_id", "supply_name", "supply_cost", "is_perishable_supply")},
}
METRIC_TIME_KEY = "metric_time"


def _paths(mart: str, dims: Sequence[str]) -> dict[str, list[str]]:
    """For each dimension the foreign keys that lead from the mart to it; the shortest path counts."""
    found: dict[str, list[str]] = {}
    reached = [(mart, [])]
    for holder, path in reached:
        for dim in dims:
            if dim in DIMENSIONS[holder]:
                found.setdefault(dim, path)
        reached += [(other, [*path, key]) for key, other in FOREIGN.get(holder, {}).items()]
    if missing := [d for d in dims if d not in found]:
        raise KeyError(f"{mart} has no way to the dimensions {missing}")
    return found


def _grouped(marts: dict[str, DataFrame], mart: str, rows: DataFrame, dims: Sequence[str], others: Sequence[str],
             parts: Sequence[str], merge: Callable[[str], Column] = F.sum, first: Callable[[str], Column] | None = None
             ) -> DataFrame:
    """States of ``parts``, sums unless ``merge`` says otherwise, by ``dims`` and ``others`` (columns of ``rows``).

    Rows are summed by the keys of the mart before anything joins, and again after each join, so a join sees a row per
    key and group, not one per row of the mart. ``first`` makes the states from rows where merging would not.
    """
    paths = _paths(mart, dims)
    sums = [merge(p).alias(p) for p in parts]
    own = [F.col(DIMENSIONS[mart][d]).alias(d) for d, path in paths.items() if not path]
    keys = sorted({path[0] for path in paths.values() if path})
    out = rows.groupBy(*own, *[F.col(k).alias(f"_key_{k}") for k in keys], *others).agg(
        *[(first or merge)(p).alias(p) for p in parts])
    here = [d for d, path in paths.items() if not path]
    for i, key in enumerate(keys):
        holder, there = FOREIGN[mart][key], [d for d, path in paths.items() if path[:1] == [key]]
        inner = sorted({paths[d][1] for d in there if len(paths[d]) > 1})
        near = [d for d in there if len(paths[d]) == 1]
        dim = marts[holder].select(F.col(key).alias("_dim"), *[F.col(DIMENSIONS[holder][d]).alias(d) for d in near],
                                   *[F.col(k).alias(f"_key_{k}") for k in inner])
        out = out.join(dim, out[f"_key_{key}"] == dim["_dim"], "left").drop("_dim", f"_key_{key}")
        here += near
        left = [f"_key_{k}" for k in [*keys[i + 1:], *inner]]
        out = out.groupBy(*here, *left, *others).agg(*sums)
        for far in inner:
            last = [d for d in there if paths[d][1:] == [far]]
            names = marts[FOREIGN[holder][far]].select(
                F.col(far).alias("_dim"), *[F.col(DIMENSIONS[FOREIGN[holder][far]][d]).alias(d) for d in last])
            out = out.join(names, out[f"_key_{far}"] == names["_dim"], "left").drop("_dim", f"_key_{far}")
            here, left = here + last, [k for k in left if k != f"_key_{far}"]
            out = out.groupBy(*here, *left, *others).agg(*sums)
    return out.select(*dims, *others, *parts)


def _where_dims(where: str | None) -> list[str]:
    known = {d for some in DIMENSIONS.values() for d in some}
    return [w for w in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", where or "")) if w in known]


def _aggregate(marts, mart, names, dims, grain, where) -> DataFrame:
    asked = list(dict.fromkeys([*dims, *_where_dims(where)]))
    others = [METRIC_TIME_KEY] if grain else []
    measures = {n: (SIMPLE[n][1], F.lit(1) if SIMPLE[n][2] == "*" else F.expr(SIMPLE[n][2])) for n in names}
    rows = _dated(marts[mart], mart, grain)
    summed = {n: m for n, m in measures.items() if m[0] is not F.countDistinct}
    sides = [_distinct(marts, mart, rows.withColumn("_id", value), n, asked, dims, others, where)
             for n, (fn, value) in measures.items() if fn is F.countDistinct]
    if summed:
        counted = rows.select("*", *[_summand(fn, value).alias(f"_m_{n}") for n, (fn, value) in summed.items()],
                              *[value.isNotNull().cast("int").alias(f"_n_{n}") for n, (fn, value) in summed.items() if fn is F.avg])
        parts = [c for c in counted.columns if c not in rows.columns]
        grouped = _grouped(marts, mart, counted, asked, others, parts)
        if where:
            grouped = grouped.filter(where)
        sides.append(grouped.groupBy(*dims, *others).agg(*[_total(fn, n).alias(n) for n, (fn, _) in summed.items()]))
    return reduce(lambda a, b: _full_join(a, b, [*dims, *others]), sides)


def _summand(fn: Callable, value: Column) -> Column:
    """What a row adds to the sum that stands for the aggregate."""
    if fn is F.count_if:
        return value.cast("int")
    if fn is F.count:
        return value.isNotNull().cast("int")
    if fn is F.avg:
        return value.cast("double")
    if fn is F.sum:
        return value
    raise ValueError("a metric is a sum, a count, an average or a distinct count")


def _total(fn: Callable, name: str) -> Column:
    total = F.sum(f"_m_{name}")
    if fn is F.sum:
        return total
    return safe_div(total, F.sum(f"_n_{name}")) if fn is F.avg else F.coalesce(total, F.lit(0))


def _distinct(marts, mart, rows, name, asked, dims, others, where) -> DataFrame:
    """Distinct values of ``_id``: whole numbers as bitmaps that merge on the way to the dimensions, other types as rows."""
    if dict(rows.dtypes)["_id"] in WHOLE:
        ranged = rows.withColumn("_range", F.bitmap_bucket_number("_id")).withColumn("_bits", F.bitmap_bit_position("_id"))
        states = _grouped(marts, mart, ranged, asked, [*others, "_range"], ["_bits"], F.bitmap_or_agg, F.bitmap_construct_agg)
        states = (states.filter(where) if where else states).groupBy(*dims, *others, "_range").agg(
            F.bitmap_or_agg("_bits").alias("_bits"))
        counts = F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0))
        return states.groupBy(*dims, *others).agg(counts.cast("bigint").alias(name))
    states = _grouped(marts, mart, rows.withColumn("_n", F.lit(1)), asked, [*others, "_id"], ["_n"])
    values = (states.filter(where) if where else states).select(*dims, *others, "_id").distinct()
    return values.groupBy(*dims, *others).agg(F.count("_id").alias(name))


def _dated(df: DataFrame, mart: str, grain: str | None) -> DataFrame:
    return df.withColumn(METRIC_TIME_KEY, truncate_to(METRIC_TIME[mart], grain)) if grain else df


def metric_query(marts: dict[str, DataFrame], metrics: Sequence[str], dims: Sequence[str] = (),
                 grain: str | None = None, where: str | None = None) -> DataFrame:
    """Metrics by dimensions and, with ``grain``, by ``metric_time``; ``where`` is SQL over any reachable dimensions.

    Metrics of one mart share one aggregation; results of different marts meet in a full join on the group keys.
    """
    wanted = list(dict.fromkeys(m for name in metrics for m in RATIOS.get(name, (name,))))
    if unknown := [m for m in wanted if m not in SIMPLE and m not in MEDIANS]:
        raise KeyError(f"unknown metrics {unknown}")
    keys = [*dims, *([METRIC_TIME_KEY] if grain else [])]
    parts = []
    for mart in METRIC_TIME:
        names = [m for m in wanted if m in SIMPLE and SIMPLE[m][0] == mart]
        if names:
            parts.append(_aggregate(marts, mart, names, dims, grain, where))
    for name in (m for m in wanted if m in MEDIANS):
        mart, value = MEDIANS[name]
        asked = list(dict.fromkeys([*dims, *_where_dims(where)]))
        rows = _dated(marts[mart], mart, grain).withColumn("_value", F.col(value)).withColumn("_n", F.lit(1))
        counts = _grouped(marts, mart, rows, asked, ["_value", *([METRIC_TIME_KEY] if grain else [])], ["_n"])
        counts = (counts.filter(where) if where else counts).select(*keys, F.col("_value").alias(name), "_n")
        parts.append(exact_medians(counts, [name], keys, weight="_n"))
    joined = reduce(lambda a, b: _full_join(a, b, keys), parts)
    out = [F.col(m) if m not in RATIOS else safe_div(*RATIOS[m]).alias(m) for m in metrics]
    return joined.select(*keys, *out)


def dimension_values(marts: dict[str, DataFrame], mart: str, dims: Sequence[str]) -> DataFrame:
    """The distinct values of dimensions that a mart has or leads to."""
    return _grouped(marts, mart, marts[mart].withColumn("_n", F.lit(1)), dims, [], ["_n"]).select(*dims).distinct()


def _full_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:  # one row each
        return a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])
    b = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    return a.join(b, cond, "full").select(
        *[F.coalesce(k, f"_b_{k}").alias(k) for k in keys],
        *[c for c in a.columns if c not in keys], *[c for c in b.columns if not c.startswith("_b_")])


def _equal(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]):
    return reduce(lambda x, y: x & y, [a[left].eqNullSafe(b[right]) for left, right in pairs])


def revenue_growth_mom(marts: dict[str, DataFrame], grain: str = "month", dims: Sequence[str] = (),
                       where: str | None = None) -> DataFrame:
    """Revenue against the value one month earlier, found by date, so a missing month gives NULL, not a wrong pair."""
    current = metric_query(marts, ["revenue"], dims, grain, where)
    # From the later period to the earlier one: 29 to 31 March all look back to 28 February.
    asked = current.withColumn("_then", F.col(METRIC_TIME_KEY) - F.expr("INTERVAL 1 MONTH"))
    past = current.select(*[F.col(d).alias(f"_p_{d}") for d in dims], F.col(METRIC_TIME_KEY).alias("_past"),
                          F.col("revenue").alias("revenue_prev_month"))
    pairs = [*[(d, f"_p_{d}") for d in dims]]
    meet = (asked["_then"] == past["_past"]) & _equal(asked, past, pairs) if pairs else asked["_then"] == past["_past"]
    growth = safe_div((F.col("current_revenue") - F.col("revenue_prev_month")) * 100, "revenue_prev_month")
    return (asked.join(past, meet, "left").withColumnRenamed("revenue", "current_revenue")
            .withColumn("revenue_growth_mom", growth)
            .select(*dims, METRIC_TIME_KEY, "current_revenue", "revenue_prev_month", "revenue_growth_mom"))


def order_gross_profit(marts: dict[str, DataFrame], grain: str | None = "day", dims: Sequence[str] = (),
                       where: str | None = None) -> DataFrame:
    """Item revenue minus order cost per period and by dimensions that both have or lead to."""
    both = metric_query(marts, ["revenue", "order_cost"], dims, grain, where)
    return both.withColumn("order_gross_profit", F.col("revenue") - F.col("order_cost"))


def cumulative_revenue(marts: dict[str, DataFrame], grain: str = "day", dims: Sequence[str] = (),
                       where: str | None = None) -> DataFrame:
    """Running revenue on every calendar day from the first to the last sale of all; a coarser grain shows the value of
    the last day in each period that lies in that range."""
    daily = metric_query(marts, ["revenue"], dims, "day", where).filter(F.col(METRIC_TIME_KEY).isNotNull())
    days = spine_over(marts["order_items"], "ordered_at").select(
        F.col("date_day").cast("timestamp_ntz").alias(METRIC_TIME_KEY))
    if dims:  # a row for each group and day; groups are as many as the result has
        ends = days.agg(F.struct(F.min(METRIC_TIME_KEY).alias("a"), F.max(METRIC_TIME_KEY).alias("b"))).scalar()
        days = daily.select(*dims).distinct().withColumn(METRIC_TIME_KEY, F.explode(F.sequence(
            ends.getField("a"), ends.getField("b"), F.expr("INTERVAL 1 DAY"))))
    named = daily.select(*[F.col(c).alias(f"_d_{c}") for c in daily.columns])
    meet = _equal(days, named, [(c, f"_d_{c}") for c in [*dims, METRIC_TIME_KEY]])
    by_day = W.partitionBy(*dims).orderBy(METRIC_TIME_KEY).rowsBetween(W.unboundedPreceding, 0)  # one row per day
    running = days.join(named, meet, "left").select(
        *dims, METRIC_TIME_KEY, F.sum("_d_revenue").over(by_day).alias("cumulative_revenue"))
    if grain == "day":
        return running
    return running.groupBy(*dims, truncate_to(METRIC_TIME_KEY, grain).alias("_period")).agg(
        F.max_by("cumulative_revenue", METRIC_TIME_KEY).alias("cumulative_revenue")).withColumnRenamed(
        "_period", METRIC_TIME_KEY)


# Saved queries: name -> (metrics, dimensions, grain).
SAVED_QUERIES = {
    "order_metrics": (["orders", "new_customer_orders", "order_total", "food_orders", "drink_orders"], [], "day"),
    "revenue_metrics": (["revenue", "food_revenue", "drink_revenue"], [], "day"),
    "customer_order_metrics": (["count_lifetime_orders", "lifetime_spend_pretax", "average_order_value"],
                               ["customer_id"], None),
}


def saved_query(marts: dict[str, DataFrame], name: str) -> DataFrame:
    metrics, dims, grain = SAVED_QUERIES[name]
    return metric_query(marts, metrics, dims, grain)

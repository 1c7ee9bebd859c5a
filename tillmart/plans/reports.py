"""Queries behind the dashboard pages and the exploration report. ``scoped`` is the output of ``scope``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import (
    day_name, month_label, months_between_boundaries, round_half_away, round_half_even, safe_div, truncate_to,
    value_map, weekday_number,
)
from ..operators.aggregates import hierarchy_totals, histogram, minmax_profile, pivot_first, unpivot
from ..operators.ordered import exact_medians, prefix_sum
from ..operators.scope import prior_scope, scope
from ..operators.shared_storage import materialize
from .facts import product_sales


def _aov(digits: int = 2):
    return round_half_away(safe_div("_sum", "orders"), digits).alias("aov")


def _revenue(digits: int = 0):
    return round_half_away("_sum", digits).alias("revenue")


def _order_stats(df: DataFrame, *keys, customers: bool = False) -> DataFrame:
    extra = [F.countDistinct("customer_id").alias("customers")] if customers else []
    return df.groupBy(*keys).agg(F.count("order_id").alias("orders"), F.sum("order_total").alias("_sum"), *extra)


def _pct_change(value: str, window) -> object:
    return round_half_even((safe_div(value, F.lag(value, 1).over(window)) - 1) * 100, 1)


# -- overview ---------------------------------------------------------------------------------------------------------

def overview(orders: DataFrame, locations: DataFrame, start: str, end: str,
             names: Sequence[str] | None = None) -> DataFrame:
    """One row of headline figures and the change against the same range a year earlier (NULL without one)."""
    now = scope(orders, locations, start, end, names).agg(
        F.countDistinct("customer_id").alias("customers"), F.count("order_id").alias("orders"),
        F.sum("order_total").alias("_sum"), F.sum(F.col("order_total") - F.col("order_cost")).alias("_profit"))
    before = prior_scope(orders, locations, start, end, names).agg(
        F.struct(round_half_away(F.sum("order_total"), 0).alias("revenue"), F.count("order_id").alias("orders")))
    prev = before.scalar()

    def delta(value: str):
        old = prev.getField(value)
        return F.when(old > 0, round_half_even(safe_div(F.col(value) - old, old) * 100, 0))

    return (now.select("customers", "orders", _revenue(), _aov(),
                       round_half_away(safe_div("_profit", "_sum") * 100, 1).alias("margin_pct"))
            .withColumn("prev_revenue", prev.getField("revenue")).withColumn("prev_orders", prev.getField("orders"))
            .withColumn("revenue_delta_pct", delta("revenue")).withColumn("orders_delta_pct", delta("orders")))


def monthly_trend(scoped: DataFrame) -> DataFrame:
    by_month = W.orderBy("month")  # one row per calendar month
    return (_order_stats(scoped, truncate_to("ordered_at", "month").alias("month"), customers=True)
            .select("month", _revenue(), "orders", "customers", _aov())
            .withColumn("mom_pct", _pct_change("revenue", by_month))
            .withColumn("month_label", month_label("month")).orderBy("month"))


def weekly_trend(scoped: DataFrame) -> DataFrame:
    """Weekly revenue with a moving average that needs four full weeks."""
    by_week = W.orderBy("week")  # one row per calendar week
    last4 = by_week.rowsBetween(-3, 0)
    return (_order_stats(scoped, truncate_to("ordered_at", "week").alias("week"))
            .select("week", _revenue(), "orders", _aov())
            .withColumn("ma4", F.when(F.count("revenue").over(last4) == 4,
                                      round_half_even(F.sum("revenue").over(last4) / 4, 0)))
            .withColumn("wow", _pct_change("revenue", by_week)).orderBy("week"))


def revenue_by_location(scoped: DataFrame) -> DataFrame:
    return _order_stats(scoped, "location_name").select("location_name", _revenue())


def revenue_by_location_month(scoped: DataFrame) -> DataFrame:
    return (_order_stats(scoped, truncate_to("ordered_at", "month").alias("month"), "location_name")
            .select("month", "location_name", _revenue(), "orders", _aov()).orderBy("month", "location_name"))


def revenue_by_location_month_all(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """All orders, also those whose location is unknown."""
    monthly = _order_stats(orders, truncate_to("ordered_at", "month").alias("month"), "location_id")
    return (monthly.join(locations.select("location_id", "location_name"), "location_id", "left")
            .select("month", "location_id", "location_name", _revenue()).orderBy("month", "location_id"))


def day_of_week(scoped: DataFrame) -> DataFrame:
    return (_order_stats(scoped, day_name("ordered_at").alias("day_of_week"),
                         weekday_number("ordered_at").alias("day_num"))
            .select("day_of_week", "day_num", "orders", _revenue(), _aov()).orderBy("day_num"))


# Order type labels of the dashboard and of the exploration report.
DASHBOARD_TYPES = {"both": "Food + Drink", "food": "Food only", "drink": "Drink only", "none": "Other"}
REPORT_TYPES = {"both": "Mixed (food+drink)", "food": "Food only", "drink": "Drink only", "none": "Unknown"}


def order_composition(orders: DataFrame, labels: dict[str, str] = DASHBOARD_TYPES) -> DataFrame:
    """Orders, share and average value per order type."""
    food, drink = F.col("is_food_order"), F.col("is_drink_order")
    kind = (F.when(food & drink, labels["both"]).when(food & ~drink, labels["food"])
            .when(drink, labels["drink"]).otherwise(labels["none"]))
    four_types = W.partitionBy(F.lit(1))
    return (_order_stats(orders, kind.alias("order_type"))
            .select("order_type", "orders",
                    round_half_away(safe_div(F.col("orders") * 100.0, F.sum("orders").over(four_types)), 1)
                    .alias("pct"), _aov()).orderBy(F.col("orders").desc()))


def variance_decomposition(scoped: DataFrame) -> DataFrame:
    """Monthly revenue change split into a volume and a price effect, one row per effect."""
    by_month = W.orderBy("month")  # one row per calendar month
    effects = (_order_stats(scoped, truncate_to("ordered_at", "month").alias("month"))
               .select("month", "orders", _aov(4))
               .withColumn("_o", F.lag("orders").over(by_month)).withColumn("_a", F.lag("aov").over(by_month))
               .withColumn("volume_effect", round_half_even((F.col("orders") - F.col("_o")) * F.col("_a"), 0))
               .withColumn("price_effect", round_half_even((F.col("aov") - F.col("_a")) * F.col("_o"), 0))
               .filter("volume_effect is not null").withColumn("month_label", month_label("month")))
    # Effect labels.
    return unpivot(effects, ["month", "month_label"], ["volume_effect", "price_effect"], "effect", "value", {
        "volume_effect": "Volume (more/fewer orders)", "price_effect": "Price (AOV change)"})


# -- products ---------------------------------------------------------------------------------------------------------

def product_monthly(monthly_sales: DataFrame) -> DataFrame:
    """Monthly revenue and units per product name; takes ``marts.sales`` over the orders in scope."""
    return (monthly_sales.groupBy("month", "product_name", "is_food_item")
            .agg(round_half_away(F.sum("total_revenue"), 0).alias("revenue"), F.sum("units_sold").alias("units"))
            .orderBy("month", "product_name", "is_food_item"))


def product_treemap(order_items: DataFrame) -> DataFrame:
    """Rounded product revenue rolled up to category and total; takes the item mart or sales."""
    category = F.when(F.col("is_food_item"), "Food").otherwise("Beverage").alias("category")
    products = product_sales(order_items, False).groupBy("product_name", category).agg(
        round_half_away(F.sum("total_revenue"), 0).alias("revenue"))
    return hierarchy_totals(products, "category", "product_name", "revenue")


def product_ranking(cogs: DataFrame) -> DataFrame:
    return cogs.select("product_name", "product_type", "units_sold",
                       round_half_away("total_revenue", 0).alias("revenue"),
                       round_half_away("gross_margin_pct", 1).alias("margin_pct"),
                       round_half_away("perishable_pct_of_revenue", 1).alias("perishable_risk_pct"), "gross_margin_pct",
                       ).orderBy(F.col("gross_margin_pct").desc_nulls_last(), "product_name").drop("gross_margin_pct")


def perishable_risk(cogs: DataFrame) -> DataFrame:
    return cogs.select("product_name", "product_type", "gross_margin_pct", "perishable_pct_of_revenue",
                       "total_revenue").orderBy(F.col("perishable_pct_of_revenue").desc_nulls_last(), "product_name")


# Strategy text per quadrant.
QUADRANT_STRATEGY = {
    "Star": "Invest & protect — core revenue and margin drivers",
    "Cash Cow": "Optimize supply costs — high volume, margin pressure",
    "Question Mark": "Bundle with high-volume items to grow sales",
    "Dog": "Review pricing or reduce supply cost or consider cutting",
}


def quadrant_summary(bcg: DataFrame, cogs: DataFrame) -> DataFrame:
    """Products, revenue and mean margin per quadrant, from the unrounded facts. Margins have two decimals and are
    averaged exactly."""
    return (cogs.join(bcg.select("product_id", "bcg_quadrant"), "product_id").groupBy("bcg_quadrant").agg(
        F.count("product_name").alias("products"), round_half_even(F.sum("total_revenue"), 0).alias("total_revenue"),
        round_half_even(safe_div(F.sum(F.col("gross_margin_pct").cast("decimal(16,2)")),
                                 F.count("gross_margin_pct")), 1).alias("avg_margin"))
        .withColumn("strategy", value_map("bcg_quadrant", QUADRANT_STRATEGY)))


# Cost type labels.
COST_LABELS = {"total_perishable_cost": "Perishable", "total_non_perishable_cost": "Non-Perishable"}


def cost_breakdown(cogs: DataFrame) -> DataFrame:
    return unpivot(cogs, ["product_id", "product_name", "product_type", "total_revenue", "gross_margin_pct"],
                   list(COST_LABELS), "cost_type", "cost", COST_LABELS)


def product_trends(performance: DataFrame, names: Sequence[str] | None = None, first: int = 5) -> DataFrame:
    """Monthly revenue and margin of the named products; by default the first five names by month and product id."""
    if not names:
        seen = performance.groupBy("product_name").agg(
            F.min(F.struct("month", "product_id")).alias("_at")).orderBy("_at").limit(first)
        performance = performance.join(F.broadcast(seen.select("product_name")), "product_name")  # `first` rows
    else:
        performance = performance.filter(F.col("product_name").isin(list(names)))
    return performance.select("month", "product_id", "product_name", "total_revenue", "gross_margin_pct")


# -- customers --------------------------------------------------------------------------------------------------------

def retention_heatmap(cohorts: DataFrame, prefix: str = "M") -> DataFrame:
    pct = cohorts.filter("months_since_first_order <= 11").select(
        month_label("cohort_month").alias("cohort_label"), "months_since_first_order",
        round_half_away(F.col("retention_rate") * 100, 1).alias("retention_pct"))
    return pivot_first(pct, "cohort_label", "months_since_first_order", list(range(12)), "retention_pct", prefix)


def retention_curve(cohorts: DataFrame) -> DataFrame:
    """Mean of the rounded percentages per month since the first order, months 0 to 11."""
    pct = round_half_away(F.col("retention_rate") * 100, 1).cast("decimal(6,1)")
    return (cohorts.filter("months_since_first_order <= 11").groupBy("months_since_first_order")
            .agg(safe_div(F.sum(pct), F.count(pct)).alias("avg_retention"),
                 F.count("cohort_month").alias("cohorts_included")).orderBy("months_since_first_order"))


def retention_summary(cohorts: DataFrame, months: int = 6) -> DataFrame:
    """Mean of the rates, then rounded, for the first months."""
    rate = F.col("retention_rate").cast("decimal(10,4)")
    return (cohorts.filter(F.col("months_since_first_order") <= months)
            .groupBy(F.col("months_since_first_order").alias("month_n"))
            .agg(F.countDistinct("cohort_month").alias("cohorts"),
                 round_half_away(safe_div(F.sum(rate), F.count(rate)) * 100, 1).alias("avg_retention_pct"))
            .orderBy("month_n"))


# Upper limits and labels of the lifetime-value buckets.
LTV_BUCKETS = [(200, "< $200"), (500, "$200–500"), (1000, "$500–1K")]
LTV_TOP_BUCKET = "> $1K"


def _spenders(customers: DataFrame) -> DataFrame:
    return customers.filter("lifetime_spend is not null and lifetime_spend > 0")


def ltv_buckets(customers: DataFrame, limits: Sequence[tuple[int, str]] = LTV_BUCKETS,
                top: str = LTV_TOP_BUCKET) -> DataFrame:
    bucket, order = F.lit(top), F.lit(len(limits))
    for i, (limit, label) in reversed(list(enumerate(limits))):
        below = F.col("lifetime_spend") < limit
        bucket, order = F.when(below, label).otherwise(bucket), F.when(below, i).otherwise(order)
    all_buckets = W.partitionBy(F.lit(1))  # one row per bucket
    return (_spenders(customers).groupBy(bucket.alias("ltv_bucket"), order.alias("_order"))
            .agg(F.count("customer_id").alias("customers"), F.sum("lifetime_spend").alias("total_revenue"))
            .withColumn("revenue_pct", round_half_even(
                safe_div("total_revenue", F.sum("total_revenue").over(all_buckets)) * 100, 1))
            .orderBy("_order").drop("_order"))


def ltv_distribution(customers: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(_spenders(customers), "lifetime_spend", bins)


def ltv_center(customers: DataFrame) -> DataFrame:
    """Median and mean lifetime spend."""
    spenders = materialize(_spenders(customers).select("lifetime_spend"))  # read twice
    median = exact_medians(spenders, ["lifetime_spend"]).select("lifetime_spend").scalar()
    return spenders.agg(safe_div(F.sum("lifetime_spend"), F.count("*")).alias("mean_spend")).withColumn(
        "median_spend", median)


def pareto_curve(customers: DataFrame) -> DataFrame:
    """Customers by descending spend with cumulative shares of customers and revenue."""
    ranked = prefix_sum(_spenders(customers).select("customer_id", "lifetime_spend"),
                        [F.col("lifetime_spend").desc(), F.col("customer_id").asc()],
                        "lifetime_spend", "_cum", total="_total", position="spend_rank", count="_n")
    return ranked.select(
        "customer_id", "lifetime_spend", "spend_rank",
        round_half_even(safe_div("_cum", "_total") * 100, 1).alias("cum_revenue_pct"),
        round_half_even(safe_div("spend_rank", "_n") * 100, 1).alias("customer_pct"))


def pareto_at(curve: DataFrame, customer_pct: float = 20.0) -> DataFrame:
    return curve.filter(F.col("customer_pct") <= customer_pct).agg(F.max("cum_revenue_pct").alias("cum_revenue_pct"))


# Action text per segment on the customer page.
SEGMENT_PAGE_ACTIONS = {
    "Champions": "Reward with loyalty program. Upsell premium items.",
    "Loyal Customers": "Early access to new menu. Referral program.",
    "Potential Loyalists": "Regular content + mild offers to build habit.",
    "At Risk": "Win-back email with personalized discount.",
    "Cannot Lose Them": "Aggressive re-engagement — free item offer.",
    "Recent Customers": "Onboarding flow, highlight top products.",
    "Lost": "Exit survey to understand churn reason.",
}


def rfm_summary(segments: DataFrame) -> DataFrame:
    """Customers, spend, revenue share, recency and action per segment (seven rows at most)."""
    all_segments = W.partitionBy(F.lit(1))
    return (segments.groupBy("rfm_segment").agg(
        F.count("customer_id").alias("customers"), F.sum("monetary").alias("total_revenue"),
        F.sum("recency_days").alias("_recency"), F.count("recency_days").alias("_n"))
        .withColumn("revenue_pct", round_half_even(
            safe_div("total_revenue", F.sum("total_revenue").over(all_segments)) * 100, 1))
        .withColumn("avg_spend", round_half_even(safe_div("total_revenue", "customers"), 0))
        .withColumn("avg_recency", round_half_even(safe_div("_recency", "_n"), 0))
        .withColumn("action", value_map("rfm_segment", SEGMENT_PAGE_ACTIONS))
        .drop("_recency", "_n").orderBy(F.col("revenue_pct").desc(), "rfm_segment"))


def top_segments(summary: DataFrame, k: int = 2) -> DataFrame:
    """The k segments with the most revenue taken together: customers, their share, revenue share."""
    whole = summary.agg(F.sum("customers")).scalar()
    best = summary.orderBy(F.col("revenue_pct").desc(), "rfm_segment").limit(k)
    return best.agg(F.sum("customers").alias("customers"),
                    F.sum(F.col("revenue_pct").cast("decimal(6,1)")).cast("double").alias("revenue_pct")).select(
        "customers", round_half_even(safe_div("customers", whole) * 100, 0).alias("customer_pct"), "revenue_pct")


def order_frequency(customers: DataFrame) -> DataFrame:
    return (customers.filter("count_lifetime_orders is not null")
            .groupBy(F.col("count_lifetime_orders").alias("n_orders")).agg(F.count("*").alias("customers"))
            .orderBy("n_orders"))


def customer_breakdown(customers: DataFrame) -> DataFrame:
    known = customers.filter("count_lifetime_orders is not null")
    return known.groupBy("customer_type").agg(
        F.count("*").alias("customer_count"),
        round_half_away(safe_div(F.sum("lifetime_spend"), F.count("lifetime_spend")), 2).alias("avg_ltv"),
        round_half_away(safe_div(F.sum("count_lifetime_orders"), F.count("*")), 1).alias("avg_orders"),
        F.sum("lifetime_spend").alias("total_revenue")).orderBy(F.col("customer_count").desc())


def churn_breakdown(features: DataFrame) -> DataFrame:
    return features.groupBy("is_churned").agg(
        F.count("*").alias("customers"),
        round_half_away(safe_div(F.sum("lifetime_spend"), F.count("lifetime_spend")), 2).alias("avg_ltv"),
        round_half_away(safe_div(F.sum("days_since_last_order"), F.count("days_since_last_order")), 0)
        .alias("avg_days_since_order")).orderBy("is_churned")


def dataset_overview(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Counts and totals; each distinct count is an aggregate of its own, whose groups are spread over tasks."""
    items = order_items.agg(F.count("*")).scalar()

    def known(column: str):
        return orders.select(column).filter(F.col(column).isNotNull()).distinct().agg(F.count("*")).scalar()

    return orders.agg(
        F.count("order_id").alias("orders"),  # one row per order
        F.min("ordered_at").alias("first_order"), F.max("ordered_at").alias("last_order"),
        F.sum("order_total").alias("total_revenue"), F.count("order_total").alias("_n"),
    ).withColumn("line_items", items).withColumn("customers", known("customer_id")).withColumn(
        "active_locations", known("location_id")).withColumn(
        "avg_order_value", round_half_away(safe_div("total_revenue", "_n"), 2)).withColumn(
        "avg_ltv", round_half_away(safe_div("total_revenue", "customers"), 2)).drop("_n")


# -- locations --------------------------------------------------------------------------------------------------------

def location_monthly(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """Location by month with the age of the location; orders without a known location are left out."""
    monthly = _order_stats(orders, truncate_to("ordered_at", "month").alias("month"), "location_id", customers=True)
    return (monthly.join(locations.select("location_id", "location_name", "opened_date"), "location_id")
            .select("month", "location_name", "orders", _revenue(), _aov(), "customers",
                    months_between_boundaries("opened_date", "month").alias("months_since_open"))
            .orderBy("month", "location_name"))


def location_margins(performance: DataFrame) -> DataFrame:
    return performance.select(
        "location_name", "total_orders", round_half_away("total_revenue", 0).alias("revenue"),
        round_half_away("avg_order_value", 2).alias("aov"), "months_open",
        round_half_away("revenue_per_month_open", 0).alias("rev_per_month"),
        round_half_away(safe_div("total_gross_profit", "total_revenue") * 100, 1).alias("margin_pct"),
        "revenue_rank").orderBy("revenue_rank", "location_name")


# Metric labels of the location comparison.
LOCATION_METRICS = {
    "total_orders": "Total Orders", "avg_order_value": "Avg Order Value ($)",
    "new_customer_order_pct": "New Customer Order %", "food_revenue_pct": "Food Revenue %",
    "drink_revenue_pct": "Drink Revenue %",
}


def location_metrics_long(performance: DataFrame) -> DataFrame:
    return unpivot(performance, ["location_name"], list(LOCATION_METRICS), "metric", "value", LOCATION_METRICS)


def location_revenue_cost(performance: DataFrame) -> DataFrame:
    return unpivot(performance, ["location_name"], ["total_revenue", "total_cost"], "variable", "value")


RADAR_DIMS = ["total_revenue", "total_orders", "avg_order_value", "revenue_per_month_open", "new_customer_order_pct"]


def location_radar(performance: DataFrame) -> DataFrame:
    return minmax_profile(performance.select("location_name", *RADAR_DIMS), RADAR_DIMS)


def location_ratio_vs(performance: DataFrame, base: str,
                      metrics: Sequence[str] = ("total_revenue", "total_orders", "avg_order_value",
                                                "revenue_per_month_open")) -> DataFrame:
    """Each metric of each location against the base location, in percent, rounded to whole numbers."""
    ref = performance.filter(F.col("location_name") == base).agg(
        F.struct(*[F.max(m).alias(m) for m in metrics])).scalar()
    return performance.select("location_name", *[
        round_half_even((safe_div(m, ref.getField(m)) - 1) * 100, 0).alias(f"{m}_vs_base") for m in metrics])


def sample_rows(df: DataFrame, n: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """Some rows; the first ones by ``order`` where it is given."""
    return (df.orderBy(*order) if order else df).limit(n)

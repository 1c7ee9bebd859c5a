"""Six business analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import month_key, months_between_boundaries, ratio_pct, round_half_away, safe_div, truncate_to
from ..operators.aggregates import lag_growth
from ..operators.ordered import exact_medians, ntile_rows, rank_rows
from ..operators.shared_storage import materialize
from .facts import product_sales, unit_costs


def revenue_trends(orders: DataFrame) -> DataFrame:
    """Weekly orders, revenue, growth, 4-week moving average and running total."""
    weekly = orders.groupBy(truncate_to("ordered_at", "week").alias("week_start")).agg(
        F.count("order_id").alias("orders"), F.sum("order_total").alias("revenue"),
        F.countDistinct("customer_id").alias("unique_customers"))
    by_week = W.orderBy("week_start")  # one row per calendar week
    last4 = by_week.rowsBetween(-3, 0)
    prev, growth = lag_growth("revenue", by_week)
    return weekly.select(
        "week_start", "orders", "revenue", round_half_away(safe_div("revenue", "orders"), 2).alias("aov"),
        "unique_customers", prev.alias("prev_week_revenue"),
        safe_div(F.sum("revenue").over(last4), F.count("revenue").over(last4)).alias("ma_4week_revenue"),
        round_half_away(growth * 100, 1).alias("wow_growth_pct"),
        F.sum("revenue").over(by_week.rangeBetween(W.unboundedPreceding, 0)).alias("cumulative_revenue"),
    ).orderBy("week_start")


RETENTION_MONTHS = list(range(12))


def retention_matrix(cohorts: DataFrame) -> DataFrame:
    """Cohort rows, months 0 to 11 as columns, retention in percent."""
    wide = (cohorts.withColumn("pct", round_half_away(F.col("retention_rate") * 100, 1))
            .groupBy(month_key("cohort_month").alias("cohort"), "cohort_size")
            .pivot("months_since_first_order", RETENTION_MONTHS).agg(F.max("pct")))
    return wide.select("cohort", "cohort_size",
                       *[F.col(str(m)).alias(f"Month {m}") for m in RETENTION_MONTHS]).orderBy("cohort")


def bcg_quadrants(cogs: DataFrame) -> DataFrame:
    """Products against the median revenue and the median margin."""
    stats = materialize(cogs.select(  # read for the medians and for the rows
        "product_id", "product_name", "product_type", "units_sold", "total_revenue", "gross_margin_pct",
        "perishable_pct_of_revenue",
        round_half_away(safe_div("total_revenue", "units_sold"), 2).alias("avg_unit_price")))
    medians = exact_medians(stats, ["total_revenue", "gross_margin_pct"])
    middle = medians.select(F.struct("total_revenue", "gross_margin_pct")).scalar()
    revenue = F.col("total_revenue").cast("double")
    rich, wide = revenue > F.col("median_revenue"), F.col("gross_margin_pct") > F.col("median_margin")
    quadrant = (F.when(rich & wide, "Star").when(rich & ~wide, "Cash Cow").when(~rich & wide, "Question Mark")
                .otherwise("Dog"))
    score = safe_div(revenue, "median_revenue") * 0.5 + safe_div("gross_margin_pct", "median_margin") * 0.5
    return (stats.withColumn("median_revenue", middle.getField("total_revenue"))
            .withColumn("median_margin", middle.getField("gross_margin_pct"))
            .withColumn("bcg_quadrant", quadrant).withColumn("composite_score", round_half_away(score, 2))
            .withColumn("total_revenue", round_half_away("total_revenue", 0))
            .orderBy(F.col("composite_score").desc_nulls_last(), "product_id"))


def location_benchmark(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """Location by month: growth, 3-month moving average, rank within the month.

    Orders at locations that the location table does not know form one series without an id.
    """
    month = truncate_to("ordered_at", "month")
    dims = locations.select(F.col("location_id").alias("_known"), "location_name", "opened_date")
    monthly = orders.join(dims, F.col("location_id") == F.col("_known"), "left").groupBy(
        F.col("_known").alias("location_id"), "location_name", "opened_date", month.alias("month")).agg(
        F.count("order_id").alias("orders"), F.sum("order_total").alias("revenue"),
        F.countDistinct("customer_id").alias("unique_customers"))
    facts = (monthly.withColumn("aov", round_half_away(safe_div("revenue", "orders"), 2))
             .withColumn("months_since_open", months_between_boundaries("opened_date", "month")))
    by_month = W.partitionBy("location_id").orderBy("month")  # one row per calendar month
    last3 = by_month.rowsBetween(-2, 0)
    prev, growth = lag_growth("revenue", by_month)
    grown = (facts.withColumn("prev_month_revenue", prev)
             .withColumn("mom_growth_pct", round_half_away(growth * 100, 1))
             .withColumn("ma_3month_revenue",
                         safe_div(F.sum("revenue").over(last3), F.count("revenue").over(last3))))
    return rank_rows(grown, "revenue", "monthly_revenue_rank", ["month"], tie_break=["location_id"]).orderBy(
        "location_name", "month")


# Segment names, in rule order, and the action text of each.
SEGMENT_ACTIONS = {
    "Champions": "Reward with loyalty program, upsell premium items",
    "Loyal Customers": "Offer early access to new menu items",
    "Recent Customers": "Onboarding campaign, highlight popular products",
    "At Risk": "Win-back email with personalized discount",
    "Cannot Lose Them": "Aggressive re-engagement offer (free item)",
    "Lost": "Survey to understand churn reason",
    "Potential Loyalists": "Nurture with regular content and mild offers",
}


def rfm_scores(features: DataFrame) -> DataFrame:
    """Quintile scores for recency, frequency and spend; ties are broken by customer id."""
    scored = raw = materialize(features.filter("count_lifetime_orders is not null").select(  # read for each score
        "customer_id", "customer_name", F.col("days_since_last_order").alias("recency_days"),
        F.col("count_lifetime_orders").alias("frequency"), F.col("lifetime_spend").alias("monetary")))
    for column, order, name in (("recency_days", F.col("recency_days").desc_nulls_last(), "r_score"),
                                ("frequency", F.col("frequency").asc_nulls_last(), "f_score"),
                                ("monetary", F.col("monetary").asc_nulls_last(), "m_score")):
        score = ntile_rows(raw.select("customer_id", column), 5, [order, F.col("customer_id").asc()], name)
        scored = scored.join(score.select("customer_id", name), "customer_id")
    return scored


def rfm_segments(features: DataFrame) -> DataFrame:
    """Scores, their total, the first matching segment rule and its action."""
    r, f = F.col("r_score"), F.col("f_score")
    rules = [r.between(4, 5) & (f >= 4), (r >= 3) & (f >= 3), (r >= 4) & (f < 3), r.between(2, 3) & (f >= 3),
             (r < 2) & (f >= 3), (r < 2) & (f < 2)]
    names = list(SEGMENT_ACTIONS)

    def first_match(results: list[str]):
        picked = F.when(rules[0], results[0])
        for rule, result in zip(rules[1:], results[1:-1]):
            picked = picked.when(rule, result)
        return picked.otherwise(results[-1])

    return (rfm_scores(features).withColumn("rfm_total", r + f + F.col("m_score"))
            .withColumn("rfm_segment", first_match(names))
            .withColumn("recommended_action", first_match([SEGMENT_ACTIONS[n] for n in names]))
            .orderBy(F.col("rfm_total").desc(), F.col("monetary").desc(), "customer_id"))


def margin_erosion(order_items: DataFrame, supplies: DataFrame) -> DataFrame:
    """Product by month: margin, its change, the declining flag and the perishable-risk rank in the month.

    Takes the item mart or monthly sales, and the supplies.
    """
    monthly = product_sales(order_items, True).select(
        "product_id", "product_name", "is_food_item", "month", F.col("total_revenue").alias("revenue"),
        F.col("total_supply_cost").alias("supply_cost"), "units_sold")
    perishable = (F.col("perishable_cost_per_unit") * F.col("units_sold").cast("decimal(18,0)")).cast("decimal(38,2)")
    facts = (monthly.join(unit_costs(supplies), "product_id", "left")
             .withColumn("monthly_perishable_cost", perishable)
             .withColumn("gross_profit", F.col("revenue") - F.col("supply_cost"))
             .withColumn("gross_margin_pct", ratio_pct("gross_profit", "revenue", 1))
             .withColumn("perishable_pct_of_revenue", ratio_pct("monthly_perishable_cost", "revenue", 1)))
    by_month = W.partitionBy("product_id").orderBy(F.col("month").asc_nulls_last())  # one row per calendar month
    earlier3 = by_month.rowsBetween(-3, -1)
    # Margins have one decimal. Tenths are compared as integers: an average of equal doubles need not equal them.
    tenths = F.rint(F.col("gross_margin_pct") * 10).cast("bigint")
    below = tenths * F.count(tenths).over(earlier3) < F.sum(tenths).over(earlier3)
    trend = (facts.withColumn("margin_mom_change_pts",
                              F.col("gross_margin_pct") - F.lag("gross_margin_pct", 1).over(by_month))
             .withColumn("is_margin_declining", F.coalesce(below, F.lit(False))))
    return rank_rows(trend, "perishable_pct_of_revenue", "perishable_risk_rank", ["month"],
                     tie_break=["product_id"]).orderBy(F.col("month").desc(), "perishable_risk_rank", "product_id")

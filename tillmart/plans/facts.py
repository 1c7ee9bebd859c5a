"""The six analytics fact tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import (
    days_between, months_between_boundaries, ratio_pct, round_half_away, safe_div, truncate_to,
)
from ..operators.ordered import rank_rows
from ..operators.scope import cutoff_date
from ..operators.shared_storage import store


def _order_totals() -> list:
    return [F.count("order_id").alias("total_orders"), F.sum("order_total").alias("total_revenue"),
            F.sum("order_cost").alias("total_cost"),
            F.sum(F.col("order_total") - F.col("order_cost")).alias("gross_profit")]


def _food_only():
    return F.col("is_food_order") & ~F.col("is_drink_order")


def _drink_only():
    return F.col("is_drink_order") & ~F.col("is_food_order")


def daily_revenue(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """Day by location. Orders are aggregated on the location key first; names join the few result rows."""
    daily = orders.groupBy(F.col("ordered_at").alias("date_day"), "location_id").agg(
        *_order_totals(),
        F.count_if(F.col("customer_order_number") == 1).alias("new_customer_orders"),
        F.count_if(F.col("customer_order_number") > 1).alias("returning_customer_orders"),
        F.count_if(_food_only()).alias("food_only_orders"),
        F.count_if(_drink_only()).alias("drink_only_orders"),
        F.count_if(F.col("is_food_order") & F.col("is_drink_order")).alias("mixed_orders"))
    return daily.join(locations.select("location_id", "location_name"), "location_id", "left").select(
        "date_day", "location_id", "location_name", "total_orders", "total_revenue", "total_cost", "gross_profit",
        ratio_pct("gross_profit", "total_revenue", 2).alias("gross_margin_pct"),
        round_half_away(safe_div("total_revenue", "total_orders"), 2).alias("avg_order_value"),
        "new_customer_orders", "returning_customer_orders", "food_only_orders", "drink_only_orders", "mixed_orders")


def product_sales(order_items: DataFrame, monthly: bool) -> DataFrame:
    """Units, revenue and cost per product (and month) from the item mart.

    Sales already counted per product (``marts.sales``) pass through unchanged.
    """
    if "units_sold" in order_items.columns:
        return order_items
    keys = ["product_id", "product_name", "is_food_item", "is_drink_item"]
    if monthly:
        order_items = order_items.withColumn("month", truncate_to("ordered_at", "month"))
        keys.append("month")
    return order_items.groupBy(*keys).agg(
        F.count("order_item_id").alias("units_sold"), F.sum("product_price").alias("total_revenue"),
        F.sum("supply_cost").alias("total_supply_cost"),
        F.sum(F.col("product_price") - F.col("supply_cost")).alias("gross_profit"))


def product_performance(order_items: DataFrame) -> DataFrame:
    """Product by month with the revenue rank in the month; takes the item mart or monthly sales."""
    monthly = (product_sales(order_items, True).filter(F.col("month").isNotNull())
               .withColumn("gross_margin_pct", ratio_pct("gross_profit", "total_revenue", 2))
               .withColumn("avg_revenue_per_unit", round_half_away(safe_div("total_revenue", "units_sold"), 2)))
    return rank_rows(monthly, "total_revenue", "revenue_rank_in_month", ["month"], tie_break=["product_id"])


def unit_costs(supplies: DataFrame) -> DataFrame:
    """Perishable and other supply cost of one unit of each product."""
    perishable = F.col("is_perishable_supply")
    zero = F.lit(0).cast("decimal(16,2)")
    return supplies.groupBy("product_id").agg(
        F.sum(F.when(perishable, F.col("supply_cost")).otherwise(zero)).alias("perishable_cost_per_unit"),
        F.sum(F.when(~perishable, F.col("supply_cost")).otherwise(zero)).alias("non_perishable_cost_per_unit"))


def supply_cogs(order_items: DataFrame, supplies: DataFrame) -> DataFrame:
    """Cost of goods per product, split into perishable and other supplies; takes the item mart or sales."""
    profit = F.col("total_revenue") - F.col("total_supply_cost")
    units = F.col("units_sold").cast("decimal(18,0)")
    perishable_total = (F.col("perishable_cost_per_unit") * units).cast("decimal(38,2)")
    other_total = (F.col("non_perishable_cost_per_unit") * units).cast("decimal(38,2)")
    return product_sales(order_items, False).join(unit_costs(supplies), "product_id", "left").select(
        "product_id", "product_name",
        F.when(F.col("is_food_item"), "food").otherwise("beverage").alias("product_type"),
        "units_sold", "total_revenue", "total_supply_cost",
        "perishable_cost_per_unit", "non_perishable_cost_per_unit",
        perishable_total.alias("total_perishable_cost"), other_total.alias("total_non_perishable_cost"),
        profit.alias("gross_profit"), ratio_pct(profit, "total_revenue", 2).alias("gross_margin_pct"),
        ratio_pct(perishable_total, "total_revenue", 2).alias("perishable_pct_of_revenue"))


def location_performance(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per location with revenue per month open, mix shares and two ranks."""
    zero = F.lit(0).cast("decimal(16,2)")
    totals = orders.groupBy("location_id").agg(
        *_order_totals(), F.max("ordered_at").alias("_last"),
        F.count_if(F.col("customer_order_number") == 1).alias("_new"),
        F.sum(F.when(_food_only(), F.col("order_total")).otherwise(zero)).alias("_food"),
        F.sum(F.when(_drink_only(), F.col("order_total")).otherwise(zero)).alias("_drink"))
    dims = locations.select("location_id", "location_name", "opened_date")
    facts = (totals.join(dims, "location_id", "left")
             .withColumn("months_open", months_between_boundaries("opened_date", "_last"))
             .select("location_id", "location_name", "opened_date", "months_open", "total_orders", "total_revenue",
                     "total_cost", F.col("gross_profit").alias("total_gross_profit"),
                     round_half_away(safe_div("total_revenue", "total_orders"), 2).alias("avg_order_value"),
                     round_half_away(safe_div("total_revenue", "months_open"), 2).alias("revenue_per_month_open"),
                     round_half_away(safe_div("_new", "total_orders"), 4).alias("new_customer_order_pct"),
                     round_half_away(safe_div("_food", "total_revenue"), 4).alias("food_revenue_pct"),
                     round_half_away(safe_div("_drink", "total_revenue"), 4).alias("drink_revenue_pct")))
    by_revenue = rank_rows(facts, "total_revenue", "revenue_rank", tie_break=["location_id"])
    return rank_rows(by_revenue, "revenue_per_month_open", "efficiency_rank", tie_break=["location_id"])


def cohorts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Acquisition month by activity month: cohort size, active customers, retention rate."""
    base = customers.filter(F.col("first_ordered_at").isNotNull()).select(
        "customer_id", truncate_to("first_ordered_at", "month").alias("cohort_month"))
    activity = orders.select("customer_id", truncate_to("ordered_at", "month").alias("activity_month")).distinct()
    sizes = base.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))  # one row per customer
    active = (base.join(activity, "customer_id").filter(F.col("activity_month") >= F.col("cohort_month"))
              .groupBy("cohort_month", "activity_month")
              .agg(F.count("*").alias("active_customers")))  # one row per customer and month
    return active.join(sizes, "cohort_month", "left").select(
        "cohort_month", "activity_month",
        months_between_boundaries("cohort_month", "activity_month").alias("months_since_first_order"),
        "cohort_size", "active_customers",
        round_half_away(safe_div("active_customers", "cohort_size"), 4).alias("retention_rate"))


def churn_features(customers: DataFrame, orders: DataFrame, holdout_days: int = 30, cutoff: Column | None = None
                   ) -> DataFrame:
    """One row per customer known at the cutoff, with features from before it and the label from after it.

    Everything comes from one roll-up of the orders to (customer, day): order gaps within a day are 0 and the others
    lie between consecutive days, so the window per customer sees at most one row per calendar day however many
    orders the customer has. The order mart already counts items per order, so the item mart is not read. ``cutoff`` is needed
    where ``orders`` is a part of them.
    """
    cutoff = cutoff_date(orders, holdout_days) if cutoff is None else cutoff
    days = orders.groupBy("customer_id", "ordered_at").agg(
        F.count("*").alias("n"), F.sum("order_total").alias("spend"), F.sum("count_food_items").alias("food"),
        F.sum("count_drink_items").alias("drink"), F.sum("count_order_items").alias("items"))
    prev = F.lag("ordered_at").over(W.partitionBy("customer_id").orderBy("ordered_at"))
    age = days_between("ordered_at", cutoff)
    days = (days.withColumn("gap", days_between(prev, "ordered_at")).withColumn("age", age)
            .withColumn("known", F.col("ordered_at") <= cutoff))

    def total(value, cond=F.lit(True)):
        return F.sum(F.when(F.col("known") & cond, value))

    gap = F.col("gap").cast("double")
    per_customer = days.groupBy("customer_id").agg(
        total(F.col("n")).alias("count_lifetime_orders"),
        F.min(F.when(F.col("known"), F.col("ordered_at"))).alias("first_ordered_at"),
        F.max(F.when(F.col("known"), F.col("ordered_at"))).alias("last_ordered_at"),
        total(F.col("spend")).alias("lifetime_spend"), total(gap).alias("_gap"), total(gap * gap).alias("_gap2"),
        total(F.col("food")).alias("_food"), total(F.col("drink")).alias("_drink"),
        total(F.col("items")).alias("_items"),
        F.coalesce(total(F.col("n"), F.col("age") <= 30), F.lit(0)).alias("orders_last_30_days"),
        F.coalesce(total(F.col("n"), F.col("age").between(31, 60)), F.lit(0)).alias("orders_prior_30_days"),
        F.max(~F.col("known")).alias("_came_back")).filter("count_lifetime_orders is not null")

    gaps = (F.col("count_lifetime_orders") - 1).cast("double")
    sum_gap = F.when(gaps > 0, F.coalesce("_gap", F.lit(0.0)))
    sum_gap2 = F.when(gaps > 0, F.coalesce("_gap2", F.lit(0.0)))
    variance = safe_div(gaps * sum_gap2 - sum_gap * sum_gap, gaps * (gaps - 1))
    return customers.select("customer_id", "customer_name").join(per_customer, "customer_id").select(
        "customer_id", "customer_name",
        days_between("last_ordered_at", cutoff).alias("days_since_last_order"),
        "count_lifetime_orders", "lifetime_spend",
        round_half_away(safe_div("lifetime_spend", "count_lifetime_orders"), 2).alias("avg_order_value"),
        round_half_away(safe_div(sum_gap, gaps), 1).alias("avg_days_between_orders"),
        round_half_away(F.sqrt(variance), 1).alias("stddev_days_between_orders"),
        round_half_away(safe_div("_food", "_items"), 4).alias("food_item_pct"),
        round_half_away(safe_div("_drink", "_items"), 4).alias("drink_item_pct"),
        "orders_last_30_days", "orders_prior_30_days",
        (F.col("orders_last_30_days") - F.col("orders_prior_30_days")).alias("order_frequency_trend"),
        (~F.col("_came_back")).alias("is_churned"), "first_ordered_at", "last_ordered_at")


# Name -> fact from the marts.
FACTS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "fct_daily_revenue": lambda m: daily_revenue(m["orders"], m["locations"]),
    # Stored before they are ranked: the shuffles of the sums and of the ranks need not share the disk.
    "fct_product_performance": lambda m: product_performance(store(product_sales(m["order_items"], True), "product_sales")),
    "fct_supply_cogs": lambda m: supply_cogs(m["order_items"], m["supplies"]),
    "fct_location_performance": lambda m: location_performance(m["orders"], m["locations"]),
    "fct_cohorts": lambda m: cohorts(m["customers"], m["orders"]),
    "fct_customer_churn_features": lambda m: churn_features(m["customers"], m["orders"]),
}


def build_facts(marts: dict[str, DataFrame], names: Sequence[str] = tuple(FACTS)) -> dict[str, DataFrame]:
    """All six fact tables, or those named. The two with ranks store intermediate rows when called."""
    return {name: FACTS[name](marts) for name in names}

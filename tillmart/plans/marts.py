"""Marts: one row per order item, order, customer, product, location and supply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import truncate_to

#: Bounds of ranges of order ids come from a sample of about SAMPLE orders; every STEP of one customer and day are a range.
SAMPLE, STEP = 16384, 64
ATTRIBUTES = ["product_name", "product_price", "is_food_item", "is_drink_item"]  # of a product


def product_dimension(products: DataFrame, supplies: DataFrame | None = None) -> DataFrame:
    """One row per product: name, price, flags and, given supplies, their summed cost. Given as ``products``, it stays as it is.

    A union and one aggregation rather than a join of the two tables: its size estimate is their sum, so Spark
    broadcasts it to the items exactly when both are small, and otherwise the items meet one sort-merge join, which
    adaptive execution splits where a product is hot (it does not split a chain of joins on one key).
    """
    if "supply_cost" in products.columns:
        return products
    if supplies is None:
        return products.select("product_id", *ATTRIBUTES)
    types = dict(products.dtypes)
    both = products.select("product_id", *ATTRIBUTES, F.lit(None).cast("decimal(16,2)").alias("supply_cost")).union(
        supplies.select("product_id", *[F.lit(None).cast(types[a]).alias(a) for a in ATTRIBUTES], "supply_cost"))
    return both.groupBy("product_id").agg(*[F.max(a).alias(a) for a in ATTRIBUTES],
                                          F.sum("supply_cost").alias("supply_cost"))


def price_items(items: DataFrame, products: DataFrame, supplies: DataFrame | None = None) -> DataFrame:
    """Items with price, flags and the supply cost of their product; no join with the orders."""
    return items.join(product_dimension(products, supplies), "product_id", "left")


def flag_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items as ``price_items`` gives them with supplies, less the supply cost: a product given twice joins once here, too."""
    once = products.groupBy("product_id").agg(*[F.max(a).alias(a) for a in ATTRIBUTES])
    return items.join(once, "product_id", "left")


def sales(items: DataFrame, products: DataFrame, supplies: DataFrame | None = None, orders: DataFrame | None = None,
          how: str = "left") -> DataFrame:
    """Units, revenue and, given supplies, supply cost per product and, with ``orders``, per month of those orders.
    Items of other orders have no month; ``how="inner"`` leaves them out.

    Items are counted per product before prices join: every item of a product has the same price and cost, so the
    sums are products of the count, and the join sees one row per product and month instead of one per item.
    """
    keys = ["product_id"]
    if orders is not None:
        days = orders.select("order_id", truncate_to("ordered_at", "month").alias("month"))
        items, keys = items.join(days, "order_id", how), ["product_id", "month"]
    counted = items.groupBy(*keys).agg(F.count("*").alias("_rows"), F.count("order_item_id").alias("units_sold"))
    rows = F.col("_rows").cast("decimal(18,0)")

    def total(unit) -> object:
        return (unit * rows).cast("decimal(38,2)")

    costs = [] if supplies is None else [
        total(F.col("supply_cost")).alias("total_supply_cost"),
        total(F.col("product_price") - F.col("supply_cost")).alias("gross_profit")]
    return counted.join(product_dimension(products, supplies), "product_id", "left").select(
        *keys, "product_name", "is_food_item", "is_drink_item", "units_sold",
        total(F.col("product_price")).alias("total_revenue"), *costs)


def order_items(items: DataFrame, stg_orders: DataFrame, products: DataFrame, supplies: DataFrame | None = None
                ) -> DataFrame:
    """Order item mart: priced items with the order day. Revenue queries may leave out the supplies and their cost."""
    return dated_items(price_items(items, products, supplies), stg_orders)


def dated_items(priced: DataFrame, stg_orders: DataFrame) -> DataFrame:
    """Priced items with the day of their order."""
    costs = [c for c in ("supply_cost",) if c in priced.columns]
    return priced.join(stg_orders.select("order_id", "ordered_at"), "order_id", "left").select(
        "order_item_id", "order_id", "product_id", "ordered_at", "product_name", "product_price", "is_food_item",
        "is_drink_item", *costs)


def orders(stg_orders: DataFrame, priced_items: DataFrame) -> DataFrame:
    """Order mart. ``priced_items`` needs only item columns, so the order join of the item mart is not repeated.

    Items are summed before the join; an order without items keeps NULL counts, flags and cost. Items without a supply cost
    give orders without one.
    """
    return join_item_summary(number_customer_orders(stg_orders), priced_items).select(
        *stg_orders.columns, *_item_summary(priced_items), "customer_order_number")


ITEM_SUMMARY = ["order_cost", "order_items_subtotal", "count_food_items", "count_drink_items", "count_order_items",
                "is_food_order", "is_drink_order"]


def _item_summary(priced_items: DataFrame) -> list[str]:
    return [c for c in ITEM_SUMMARY if c != "order_cost" or "supply_cost" in priced_items.columns]


def join_item_summary(stg_orders: DataFrame, priced_items: DataFrame) -> DataFrame:
    """Orders with what their items add up to."""
    costs = [F.sum(c).alias("order_cost") for c in ("supply_cost",) if c in priced_items.columns]
    summary = priced_items.groupBy("order_id").agg(
        *costs,
        F.sum("product_price").alias("order_items_subtotal"),
        F.count_if("is_food_item").alias("count_food_items"),
        F.count_if("is_drink_item").alias("count_drink_items"),
        F.count("order_item_id").alias("count_order_items"))
    flagged = (summary.withColumn("is_food_order", F.col("count_food_items") > 0)
               .withColumn("is_drink_order", F.col("count_drink_items") > 0))
    return stg_orders.join(flagged, "order_id", "left").select(*stg_orders.columns, *_item_summary(priced_items))


def number_customer_orders(stg_orders: DataFrame) -> DataFrame:
    """Add ``customer_order_number``: row number per customer by day, then order id.

    A window over the customer alone would put a customer with very many orders, or all orders without a customer, into
    one task. Orders are numbered inside (customer, day, range of order ids) and shifted by the customer's orders in
    earlier ranges, which a window over the counts of those ranges gives.
    """
    group = ["_guest", "_who", "_day", "_unknown", "_range"]
    keyed = _in_ranges(stg_orders)
    earlier = W.partitionBy("_guest", "_who").orderBy("_day", "_unknown", "_range").rowsBetween(W.unboundedPreceding, -1)
    before = (keyed.groupBy(*group).agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    inside = F.row_number().over(W.partitionBy(*group).orderBy("order_id"))
    return (keyed.withColumn("_inside", inside).join(before, group, "left")
            .withColumn("customer_order_number", (F.col("_before") + F.col("_inside")).cast("bigint"))
            .select(*stg_orders.columns, "customer_order_number"))


def _in_ranges(stg_orders: DataFrame) -> DataFrame:
    """Orders with customer, day and ``_range``: which of the ranges of order ids of that customer and day they lie in.

    The bounds are taken from the data, so ids may be of any type, random, or begin alike. A sample by hash holds STEP
    orders of one customer and day only where these hold about STEP / SAMPLE of all orders; only such days are cut, at
    every STEP-th id of the sample, so there are about SAMPLE / STEP bounds in all, however many orders. Any bounds give the
    same numbers: a sample read again need not be the same one.
    """
    types = dict(stg_orders.dtypes)
    keyed = stg_orders.select(
        "*", F.col("customer_id").isNull().alias("_guest"),
        F.coalesce("customer_id", F.lit("0").cast(types["customer_id"])).alias("_who"),
        F.coalesce("ordered_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("_day"),
        F.col("order_id").isNull().alias("_unknown"))
    one_in = F.greatest(F.lit(1), F.floor(stg_orders.agg(F.count("*").alias("_all")).scalar() / SAMPLE))
    sample = keyed.filter(~F.col("_unknown") & (F.pmod(F.xxhash64("order_id"), one_in) == 0))
    ids = F.array_sort(F.collect_set("order_id"))
    bounds = (sample.groupBy("_guest", "_who", "_day").agg(ids.alias("_ids")).filter(F.size("_ids") > STEP)
              .select("_guest", "_who", "_day", F.filter("_ids", lambda _, i: i % STEP == STEP - 1).alias("_bounds")))
    found = F.size(F.filter("_bounds", lambda b: b <= F.col("order_id")))
    # About SAMPLE / STEP ids in all.
    return keyed.join(F.broadcast(bounds), ["_guest", "_who", "_day"], "left").withColumn(
        "_range", F.when(F.col("_unknown") | F.col("_bounds").isNull(), 0).otherwise(found)).drop("_bounds")


def customers(stg_customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer mart; a customer without orders is ``new`` with NULL totals."""
    summary = orders.groupBy("customer_id").agg(
        F.count("order_id").alias("count_lifetime_orders"),  # one row per order
        F.min("ordered_at").alias("first_ordered_at"), F.max("ordered_at").alias("last_ordered_at"),
        F.sum("subtotal").alias("lifetime_spend_pretax"), F.sum("tax_paid").alias("lifetime_tax_paid"),
        F.sum("order_total").alias("lifetime_spend"))
    kind = F.when(F.col("count_lifetime_orders") > 1, "returning").otherwise("new")
    return stg_customers.join(summary, "customer_id", "left").withColumn("customer_type", kind)


def build_marts(stg: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All six marts, lazily. Products, locations and supplies pass through."""
    items, products, supplies = stg["stg_order_items"], stg["stg_products"], stg["stg_supplies"]
    order_mart = orders(stg["stg_orders"], price_items(items, products, supplies))
    return {
        "orders": order_mart,
        "order_items": order_items(items, stg["stg_orders"], products, supplies),
        "customers": customers(stg["stg_customers"], order_mart),
        "products": products, "locations": stg["stg_locations"], "supplies": supplies,
    }

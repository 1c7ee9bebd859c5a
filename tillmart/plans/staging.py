"""Raw tables to clean staging relations: renames, dollars, day truncation, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cents_to_dollars, surrogate_key, truncate_to
from ..sources.raw import DRINK_TYPE, FOOD_TYPE


def stage_customers(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))


def stage_orders(raw: DataFrame) -> DataFrame:
    money = ["subtotal", "tax_paid", "order_total"]
    return raw.select(
        F.col("id").alias("order_id"), F.col("store_id").alias("location_id"), F.col("customer").alias("customer_id"),
        *[F.col(m).alias(f"{m}_cents") for m in money],
        *[cents_to_dollars(m).alias(m) for m in money],
        truncate_to("ordered_at", "day").alias("ordered_at"))


def stage_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("order_item_id"), "order_id", F.col("sku").alias("product_id"))


def stage_products(raw: DataFrame) -> DataFrame:
    def is_type(t: str):
        return F.coalesce(F.col("type") == t, F.lit(False))

    return raw.select(
        F.col("sku").alias("product_id"), F.col("name").alias("product_name"), F.col("type").alias("product_type"),
        F.col("description").alias("product_description"), cents_to_dollars("price").alias("product_price"),
        is_type(FOOD_TYPE).alias("is_food_item"), is_type(DRINK_TYPE).alias("is_drink_item"))


def stage_locations(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"), "tax_rate",
                      truncate_to("opened_at", "day").alias("opened_date"))


def stage_supplies(raw: DataFrame) -> DataFrame:
    return raw.select(
        surrogate_key("id", "sku").alias("supply_uuid"), F.col("id").alias("supply_id"),
        F.col("sku").alias("product_id"), F.col("name").alias("supply_name"),
        cents_to_dollars("cost").alias("supply_cost"), F.col("perishable").alias("is_perishable_supply"))


def stage_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "stg_customers": stage_customers(raw["raw_customers"]), "stg_orders": stage_orders(raw["raw_orders"]),
        "stg_order_items": stage_order_items(raw["raw_items"]), "stg_products": stage_products(raw["raw_products"]),
        "stg_locations": stage_locations(raw["raw_stores"]), "stg_supplies": stage_supplies(raw["raw_supplies"]),
    }

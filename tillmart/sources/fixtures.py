"""The TPC-H-shaped Parquet tables presented as the six raw retail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .raw import DRINK_TYPE, FOOD_TYPE

# Declared schemas: without them every reader would first run a job over the file footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}

# Part types counted as food and as drink; the rest is neither.
FOOD_TYPES = ["ECONOMY", "SMALL", "STANDARD"]
DRINK_TYPES = ["MEDIUM", "LARGE"]


def _cents(dollars: str) -> Column:
    return F.floor(F.col(dollars) * 100 + 0.5)


def _text(name: str, dtype: str) -> Column:
    if dtype == "double":
        return F.col(name).cast("decimal(18,2)").cast("string")
    if dtype == "timestamp_ntz":
        return F.date_format(name, "yyyy-MM-dd")
    return F.col(name).cast("string")


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy raw tables; a query reads only the columns and files it needs."""

    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    customer, lineitem, part = table("customer"), table("lineitem"), table("part")

    home = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("store_id"))
    orders = (table("orders").join(home, "o_custkey")
              .withColumn("order_total", _cents("o_totalprice"))
              .withColumn("subtotal", F.expr("(order_total * 100 + 53) div 106"))
              .select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"),
                      F.col("o_orderdate").alias("ordered_at"), "store_id", "subtotal",
                      (F.col("order_total") - F.col("subtotal")).alias("tax_paid"), "order_total"))

    line_text = F.concat_ws("|", *[F.coalesce(_text(c, t), F.lit("")) for c, t in lineitem.dtypes])
    items = lineitem.select(F.md5(line_text).alias("id"), F.col("l_orderkey").alias("order_id"),
                            F.col("l_partkey").alias("sku"))

    products = part.select(
        F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"),
        F.when(F.col("p_type").isin(FOOD_TYPES), FOOD_TYPE).when(F.col("p_type").isin(DRINK_TYPES), DRINK_TYPE)
        .otherwise("other").alias("type"),
        _cents("p_retailprice").alias("price"), F.col("p_brand").alias("description"))

    stores = table("nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.date_add(F.lit("1993-01-01").cast("date"), F.col("n_nationkey") * 30).cast("timestamp_ntz")
        .alias("opened_at"),
        F.lit(0.06).alias("tax_rate"))

    supplies = (lineitem.select("l_partkey", "l_suppkey").distinct()
                .join(part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
                .select(F.col("l_suppkey").alias("id"),
                        F.concat(F.lit("Supply#"), F.col("l_suppkey").cast("string")).alias("name"),
                        F.floor(F.col("p_retailprice") + 0.5).alias("cost"),
                        (F.col("l_suppkey") % 3 == 0).alias("perishable"),
                        F.col("l_partkey").alias("sku")))

    return {
        "raw_customers": customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "raw_orders": orders, "raw_items": items, "raw_products": products, "raw_stores": stores,
        "raw_supplies": supplies,
    }

"""The main queries on tables where one customer, one product and one order each hold a third of the rows."""

import glob
import os

import pytest
from compare import connect, difference
from conftest import SF
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillmart.plans import marts

NAMES = ["mart_orders", "fct_daily_revenue", "fct_product_performance", "fct_supply_cogs", "fct_location_performance",
         "fct_cohorts", "fct_customer_churn_features", "rfm_segments", "margin_erosion", "pareto_curve", "ltv_summary",
         "churn_split", "metric_items", "product_monthly", "run_checks_marts"]


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    import duckdb

    out = tmp_path_factory.mktemp("skewed")
    changes = {"orders": "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey",
               "lineitem": "CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey, "
                           "CASE WHEN l_linenumber IN (1, 2) THEN 7 ELSE l_orderkey END AS l_orderkey"}
    for f in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(f)[:-8]
        replaced = f"REPLACE ({changes[name]})" if name in changes else ""
        duckdb.sql(f"COPY (SELECT * {replaced} FROM '{f}') TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_skewed_tables(spark, skewed_dir, name):
    assert difference(entry.queries()[name](spark, skewed_dir), connect(skewed_dir), entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("text_ids", [False, True])
def test_orders_without_a_customer_on_one_day_are_numbered_in_ranges(spark, text_ids, monkeypatch):
    monkeypatch.setattr(marts, "STEP", 16)
    rows = [(i, None if i % 3 == 0 else i % 40, 1 if i % 3 == 0 else i % 7) for i in range(1200)] + [(None, None, 1)]
    name = (lambda i: None if i is None else f"{i:05d}") if text_ids else (lambda i: i)
    orders = spark.createDataFrame([(name(i), c, d) for i, c, d in rows],
                                   f"order_id {'string' if text_ids else 'long'}, customer_id long, d int").selectExpr(
        "order_id", "customer_id", "cast(date_add(date'2024-01-01', d) as timestamp_ntz) as ordered_at")
    got = {r.order_id: r.customer_order_number for r in marts.number_customer_orders(orders).collect()}
    seen = {}
    for i, c, _ in sorted(rows, key=lambda r: (r[2], r[0] is None, r[0])):
        seen[c] = seen.get(c, 0) + 1
        assert got[name(i)] == seen[c]


IDS = {"whole": "id", "random": "xxhash64(id)", "text": "concat('order-2024-', lpad(cast(id as string), 9, '0'))",
       "random text": "concat('order-', md5(cast(id as string)))"}


@pytest.mark.parametrize("ids", IDS)
@pytest.mark.parametrize("days", [1, 400])
def test_no_task_numbers_more_than_twice_the_mean(spark, ids, days):
    """A third of all orders without a customer, on one day or on many."""
    n, tasks = 120_000, 8
    orders = spark.range(n).selectExpr(
        f"{IDS[ids]} AS order_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE xxhash64(id, 1) % 5000 END AS customer_id",
        f"cast(date_add(date'2024-01-01', cast(id % {days} AS int)) AS timestamp_ntz) AS ordered_at")
    group = ["_guest", "_who", "_day", "_unknown", "_range"]
    ranged = marts._in_ranges(orders)
    inside = [r["count"] for r in ranged.repartition(tasks, *group).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(inside) == n and max(inside) <= 2 * n / tasks
    counts = ranged.groupBy(*group).count()  # what the window per customer sees
    most = counts.groupBy("_guest", "_who").count().agg(F.max("count")).first()[0]
    assert most <= days + marts.SAMPLE // marts.STEP + 200
    numbered = marts.number_customer_orders(orders)
    guests = numbered.filter("customer_id IS NULL").agg(
        F.min("customer_order_number"), F.max("customer_order_number"), F.countDistinct("customer_order_number")).first()
    assert tuple(guests) == (1, n // 3, n // 3)
    ahead = F.lag("customer_order_number").over(W.partitionBy("customer_id").orderBy("ordered_at", "order_id"))
    assert numbered.withColumn("ahead", ahead).filter("customer_order_number <> coalesce(ahead, 0) + 1").count() == 0

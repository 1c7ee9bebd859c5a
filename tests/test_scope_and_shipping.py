"""Orders outside any written date, unknown locations, row order, and Python tasks away from the repository."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from tillmart.operators import scope
from tillmart.plans import analyses, reports

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _orders(spark):
    rows = [(1, 1, 1, "1990-01-05", 10.0), (2, 1, 1, "2000-02-05", 20.0), (3, 2, 1, "2010-03-05", 40.0),
            (4, 2, 8, "2000-02-06", 5.0), (5, 3, 9, "2000-02-07", 7.0), (6, 3, 9, "2000-03-07", 24.0)]
    return spark.createDataFrame(rows, "order_id int, customer_id int, location_id int, d string, order_total double").select(
        "order_id", "customer_id", "location_id", F.col("d").cast("timestamp_ntz").alias("ordered_at"),
        F.col("order_total").cast("decimal(16,2)"))


def _locations(spark):
    return spark.sql("SELECT 1 AS location_id, 'North' AS location_name, TIMESTAMP_NTZ '1989-12-01' AS opened_date")


def test_scope_has_no_dates_of_its_own(spark):
    orders, locations = _orders(spark), _locations(spark)
    assert scope.scope(orders, locations).count() == 3
    assert scope.scope(orders, locations, "2000-01-01").count() == 2
    assert scope.scope(orders, locations, None, "2000-12-31").count() == 2
    months = [str(r.month)[:7] for r in reports.monthly_trend(scope.scope(orders, locations)).collect()]
    assert months == ["1990-01", "2000-02", "2010-03"]


def test_unknown_locations_are_one_series(spark):
    rows = analyses.location_benchmark(_orders(spark), _locations(spark)).filter("location_id is null").collect()
    assert [(str(r.month)[:7], r.orders, float(r.revenue), r.mom_growth_pct) for r in rows] == [
        ("2000-02", 2, 12.0, None), ("2000-03", 1, 24.0, 100.0)]


def test_product_ranking_sorts_by_the_unrounded_margin(spark):
    cogs = spark.createDataFrame([("a", "food", 1, 10.0, 50.01, 1.0), ("b", "food", 1, 10.0, 50.04, 1.0)],
                                 "product_name string, product_type string, units_sold long, total_revenue double, "
                                 "gross_margin_pct double, perishable_pct_of_revenue double")
    assert [r.product_name for r in reports.product_ranking(cogs).collect()] == ["b", "a"]


def test_python_tasks_find_the_package_anywhere(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate())
print("rows", entry.queries()["revenue_anomalies_by_location"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.split("rows")[1]) > 0, done.stderr[-2000:]

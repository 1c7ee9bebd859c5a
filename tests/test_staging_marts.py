"""Given/expect cases for staging and marts."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import SF
from pyspark.sql import functions as F

from catalog import queries
from tillmart.functions import cents_to_dollars, round_half_away, round_half_even, safe_div, surrogate_key
from tillmart.plans import facts, marts, staging
from tillmart.sources import (
    check_bad_lines, date_spine, list_columns, load_raw, read_raw, read_raw_quarantined, run_sql, save_table,
)


def test_order_flags_from_items(spark):
    items = spark.createDataFrame(
        [(1, 1, False, True), (1, 2, True, False), (2, 3, False, True)],
        "order_id int, order_item_id int, is_drink_item boolean, is_food_item boolean").withColumn(
        "supply_cost", F.lit(None).cast("decimal(16,2)")).withColumn("product_price", F.lit(None).cast("decimal(16,2)"))
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id int").withColumn(
        "customer_id", F.lit(1)).withColumn("ordered_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.order_id: (r.count_food_items, r.count_drink_items, r.is_food_order, r.is_drink_order)
           for r in marts.orders(orders, items).collect()}
    assert got == {1: (1, 1, True, True), 2: (1, 0, True, False), 3: (None, None, None, None)}


def test_supply_costs_sum_per_product(spark):
    supplies = spark.createDataFrame([(1, Decimal("4.50")), (2, Decimal("3.50")), (2, Decimal("5.00"))],
                                     "product_id int, supply_cost decimal(16,2)")
    products = spark.createDataFrame([(1,), (2,)], "product_id int").selectExpr(
        "product_id", "'p' product_name", "cast(1 as decimal(16,2)) product_price", "true is_food_item",
        "false is_drink_item")
    items = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "order_id int, product_id int").withColumn(
        "order_item_id", F.lit("i"))
    orders = spark.createDataFrame([(1,), (2,)], "order_id int").withColumn(
        "ordered_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = sorted((r.order_id, r.product_id, r.supply_cost) for r in
                 marts.order_items(items, orders, products, supplies).collect())
    assert got == [(1, 1, Decimal("4.50")), (2, 2, Decimal("8.50")), (2, 2, Decimal("8.50"))]


def test_location_day_truncation(spark):
    raw = spark.createDataFrame(
        [(1, "Vice City", 0.2, "2016-09-01T00:00:00"), (2, "San Andreas", 0.1, "2079-10-27T23:59:59.9999")],
        "id int, name string, tax_rate double, opened_at string").withColumn(
        "opened_at", F.col("opened_at").cast("timestamp_ntz"))
    got = {r.location_id: (r.location_name, r.tax_rate, r.opened_date) for r in
           staging.stage_locations(raw).collect()}
    assert got == {1: ("Vice City", 0.2, dt.datetime(2016, 9, 1)), 2: ("San Andreas", 0.1, dt.datetime(2079, 10, 27))}


def test_product_flags_with_null_type(spark):
    raw = spark.createDataFrame([("a", "jaffle"), ("b", "beverage"), ("c", None)], "sku string, type string").selectExpr(
        "sku", "'n' name", "type", "1100L price", "'d' description")
    got = {r.product_id: (r.is_food_item, r.is_drink_item, r.product_price) for r in
           staging.stage_products(raw).collect()}
    assert got == {"a": (True, False, Decimal("11.00")), "b": (False, True, Decimal("11.00")),
                   "c": (False, False, Decimal("11.00"))}


def test_customer_order_numbers_with_guests_ties_and_missing_days(spark):
    rows = [(1, "a", "2024-01-02"), (2, "a", "2024-01-01"), (3, "a", "2024-01-02"), (4, None, "2024-01-05"),
            (5, None, "2024-01-01"), (6, None, "2024-01-05"), (7, "a", None), (8, "0", "2024-01-01")]
    orders = spark.createDataFrame(rows, "order_id int, customer_id string, d string").select(
        "order_id", "customer_id", F.col("d").cast("timestamp_ntz").alias("ordered_at"))
    got = {r.order_id: r.customer_order_number for r in marts.number_customer_orders(orders).collect()}
    assert got == {2: 1, 1: 2, 3: 3, 7: 4, 5: 1, 4: 2, 6: 3, 8: 1}


def test_unused_order_joins_leave_the_plan(spark):
    """A query on order totals reads neither items nor daily counts."""
    from catalog.queries import QUERIES

    plan = QUERIES["revenue_trends"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "row_number" not in plan


def test_customers_without_orders_are_new(spark):
    customers = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "customer_id int, customer_name string")
    orders = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "order_id int, customer_id int").selectExpr(
        "*", "timestamp_ntz'2024-01-01' ordered_at", "cast(1 as decimal(16,2)) subtotal",
        "cast(0.1 as decimal(16,2)) tax_paid", "cast(1.1 as decimal(16,2)) order_total")
    got = {r.customer_id: (r.count_lifetime_orders, r.lifetime_spend, r.customer_type) for r in
           marts.customers(customers, orders).collect()}
    assert got == {1: (2, Decimal("2.20"), "returning"), 2: (1, Decimal("1.10"), "new"), 3: (None, None, "new")}


def test_bad_lines_are_kept_apart(spark, tmp_path):
    good = ["A-1,flame,jaffle,1400,plain", 'A-2,,beverage,,"two, parts"']
    bad = ["A-3,blank,jaffle,12x,bad price", "A-4,short,jaffle", "A-5,long,jaffle,5,one,two"]
    folder = tmp_path / "raw_products.csv"
    folder.mkdir()
    head = "sku,name,type,price,description"
    (folder / "a.csv").write_text("\n".join([head, good[0], *bad[:2]]) + "\n")
    (folder / "b.csv").write_text("\n".join([head, bad[2], good[1]]) + "\n")
    (folder / "c.csv").write_text(head + "\n")
    read = read_raw_quarantined(spark, str(tmp_path), "raw_products")
    assert [(r.sku, r.price, r.description) for r in read.good.orderBy("sku").collect()] == [
        ("A-1", 1400, "plain"), ("A-2", None, "two, parts")]
    found = {r.line: r.file.rsplit("/", 1)[1] for r in read.bad.collect()}
    assert found == {bad[0]: "a.csv", bad[1]: "a.csv", bad[2]: "b.csv"}
    assert [tuple(r) for r in check_bad_lines({"raw_products": read}).collect()] == [("raw_products: readable lines", 3)]
    with pytest.raises(Exception):
        read_raw(spark, str(tmp_path), "raw_products").collect()
    for _ in range(2):  # the quarantine table grows with every load
        assert load_raw(spark, str(tmp_path), str(tmp_path / "bad"), ["raw_products"])["raw_products"].count() == 2
    assert spark.read.parquet(str(tmp_path / "bad")).groupBy("table_name").count().collect() == [("raw_products", 6)]
    (folder / "d.csv").write_text("sku,name\nA-6,x\n")
    with pytest.raises(Exception):
        read_raw_quarantined(spark, str(tmp_path), "raw_products").good.collect()


def test_read_raw_csv_details(spark, tmp_path):
    (tmp_path / "raw_products.csv").write_text(
        'sku,name,type,price,description\nA-1,flame,jaffle,1400,"pulled pork, and more! "\nA-2,blank ,beverage,600,x\n')
    (tmp_path / "raw_supplies.csv").write_text("id,name,cost,perishable,sku\nS-1,knife,7,False,A-1\nS-2,cheese,20,True,A-1\n")
    (tmp_path / "raw_stores.csv").write_text("id,name,opened_at,tax_rate\nL-1,Town,2016-09-01T00:00:00,0.06\n")
    products = {r.sku: r for r in read_raw(spark, str(tmp_path), "raw_products").collect()}
    assert products["A-1"].description == "pulled pork, and more! " and products["A-2"]["name"] == "blank "
    assert [r.perishable for r in read_raw(spark, str(tmp_path), "raw_supplies").orderBy("id").collect()] == [False, True]
    assert read_raw(spark, str(tmp_path), "raw_stores").first().opened_at == dt.datetime(2016, 9, 1)


def test_csv_to_daily_revenue(spark, tmp_path):
    """The whole path from six CSV files to a fact table."""
    from tillmart.plans import facts

    files = {
        "raw_customers": "id,name\nc1,Ann\nc2,Bo\n",
        "raw_orders": "id,customer,ordered_at,store_id,subtotal,tax_paid,order_total\n"
                      "o1,c1,2024-09-01T08:10:00,s1,1000,60,1060\no2,c1,2024-09-01T09:00:00,s1,500,30,530\n"
                      "o3,c2,2024-09-02T10:00:00,s1,700,42,742\n",
        "raw_items": "id,order_id,sku\ni1,o1,P1\ni2,o2,P2\ni3,o2,P1\n",
        "raw_products": "sku,name,type,price,description\nP1,Toast,jaffle,1000,t\nP2,Tea,beverage,500,t\n",
        "raw_stores": "id,name,opened_at,tax_rate\ns1,Town,2020-01-15T00:00:00,0.06\n",
        "raw_supplies": "id,name,cost,perishable,sku\nu1,bread,100,True,P1\nu2,bag,50,False,P1\nu3,leaf,20,True,P2\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    m = marts.build_marts(staging.stage_all({n: read_raw(spark, str(tmp_path), n) for n in files}))
    rows = [tuple(r) for r in facts.daily_revenue(m["orders"], m["locations"]).orderBy("date_day").select(
        "date_day", "location_name", "total_orders", "total_revenue", "total_cost", "gross_profit",
        "gross_margin_pct", "avg_order_value", "new_customer_orders", "returning_customer_orders",
        "food_only_orders", "mixed_orders").collect()]
    assert rows == [
        (dt.datetime(2024, 9, 1), "Town", 2, Decimal("15.90"), Decimal("3.20"), Decimal("12.70"), 79.87, 7.95,
         1, 1, 1, 1),
        (dt.datetime(2024, 9, 2), "Town", 1, Decimal("7.42"), None, None, None, 7.42, 1, 0, 0, 0)]


def test_scalars(spark):
    row = spark.range(1).select(
        round_half_away(F.lit(0.285), 2).alias("a"), round_half_away(F.lit(-2.5)).alias("b"),
        round_half_even(F.lit(2.5)).alias("c"), round_half_even(F.lit(3.5)).alias("d"),
        safe_div(F.lit(1), F.lit(0)).alias("e"), surrogate_key(F.lit("x"), F.lit(None)).alias("f"),
        cents_to_dollars(F.lit(1234567)).alias("g"), cents_to_dollars(F.lit(5), "postgres").alias("h"),
        round_half_away(F.lit(-0.001), 1).cast("string").alias("i")).first()
    import hashlib

    assert tuple(row) == (0.28, -3.0, 2.0, 4.0, None,
                          hashlib.md5(b"x-_dbt_utils_surrogate_key_null_").hexdigest(),
                          Decimal("12345.67"), Decimal("0.05"), "0.0")
    with pytest.raises(ValueError):
        cents_to_dollars("x", "other")


def test_spine_and_sinks(spark, tmp_path):
    spine = date_spine(spark)
    assert spine.count() == 3650
    assert [r.date_day.isoformat() for r in date_spine(spark, "2024-02-28", "2024-03-01").collect()] == [
        "2024-02-28", "2024-02-29", "2024-03-01"]
    saved = save_table(spark.range(3), "t", "marts", path=str(tmp_path))
    assert saved.count() == 3 and (tmp_path / "marts" / "t").is_dir()
    assert run_sql(spark, "select sum(id) s from v_t", {"v_t": saved}).first().s == 3
    assert list_columns({"t": saved}) == [("t", "id", "bigint")]


def test_results_do_not_depend_on_time_zone(spark):
    from tillmart.functions import truncate_to

    df = spark.sql("select timestamp_ntz'2018-11-04 00:30:00' t")  # midnight does not exist that day in Sao Paulo
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        assert df.select(truncate_to("t", "day").alias("d")).first().d == dt.datetime(2018, 11, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_churn_features_read_no_supplies(spark, monkeypatch):
    """Supply costs change no feature; a product that is given twice, or not at all, still counts an item once."""
    stg = {
        "stg_customers": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "customer_id long, customer_name string"),
        "stg_orders": spark.createDataFrame(
            [(1, 1, "2024-01-01", 5.0), (2, 1, "2024-01-09", 7.0), (3, 2, "2024-03-01", 1.0), (4, 2, "2024-01-05", 2.0)],
            "order_id long, customer_id long, d string, order_total double").select(
                "order_id", F.lit(1).alias("location_id"), "customer_id",
                *[F.lit(0).cast("decimal(16,2)").alias(c) for c in ("subtotal", "tax_paid")],
                F.col("order_total").cast("decimal(16,2)").alias("order_total"),
                F.col("d").cast("timestamp_ntz").alias("ordered_at")),
        "stg_order_items": spark.createDataFrame([("i", 1, 1), ("j", 1, 2), ("k", 2, 9), ("l", 4, None), ("m", 4, 1)],
                                                 "order_item_id string, order_id long, product_id long"),
        "stg_products": spark.createDataFrame(
            [(1, "x", True, False), (1, "x", True, None), (2, "y", False, True), (None, "z", True, True)],
            "product_id long, product_name string, is_food_item boolean, is_drink_item boolean").withColumn(
                "product_price", F.lit(1).cast("decimal(16,2)")),
        "stg_locations": spark.range(1).select(F.lit(1).alias("location_id"), F.lit("2020-01-01").cast("timestamp_ntz").alias("opened_date")),
        "stg_supplies": spark.createDataFrame([(1, 2.0), (1, 3.0), (7, 1.0), (9, 1.0)], "product_id long, c double").select(
            "product_id", F.col("c").cast("decimal(16,2)").alias("supply_cost"), F.lit("only supplies").alias("supply_name")),
    }
    m = marts.build_marts(stg)
    monkeypatch.setattr(queries, "_stg", lambda *_: stg)
    got, wanted = queries._features(spark, "none"), facts.churn_features(m["customers"], m["orders"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect())) and got.count() == 2
    monkeypatch.undo()
    assert "l_suppkey" not in queries._features(spark, SF)._jdf.queryExecution().executedPlan().toString()

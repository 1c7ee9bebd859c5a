from pyspark.sql import functions as F

from tillmart.operators import checks
from tillmart.operators.aggregates import histogram, minmax_profile, pivot_first
from tillmart.operators.scope import prior_scope, prior_year, scope


def test_checks_report_failing_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "k int, v string")
    parent = spark.createDataFrame([(2,)], "k int")
    assert checks.check_not_null(df, "k").count() == 2
    assert [tuple(r) for r in checks.check_unique(df, "k").collect()] == [(1, 2)]
    assert [tuple(r) for r in checks.check_relationship(df, "k", parent, "k").collect()] == [(1, 2)]
    assert checks.check_accepted(df, "v", ["a", "b"]).count() == 1
    assert checks.check_expression(df, "k > 1").count() == 2
    report = {r.check_name: r.failures for r in checks.run_checks({"t": df, "p": parent}, {"t": [
        ("not_null", "k"), ("unique", "k"), ("relationship", "k", "p", "k"), ("accepted", "v", ["a", "b"]),
        ("expression", "k > 1")]}).collect()}
    assert report == {"t: not_null k": 2, "t: unique k": 1, "t: relationship k": 2, "t: accepted v": 1,
                      "t: expression k > 1": 2}


def test_row_counts(spark):
    got = {r.table_name: (r.n_rows, r.status) for r in checks.row_counts(
        {"a": spark.range(3), "b": spark.range(2)}, {"a": 3, "b": 5}).collect()}
    assert got == {"a": (3, "OK"), "b": (2, "WARN (expected 5)")}


def test_histogram_ends_and_constant(spark):
    got = {r.bin: r.rows for r in histogram(spark.range(11), "id", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    same = histogram(spark.range(4).withColumn("v", F.lit(7)), "v", 5).collect()
    assert [(r.bin, r.bin_start, r.rows) for r in same] == [(0, 7.0, 4)]


def test_minmax_profile(spark):
    df = spark.createDataFrame([("x", 1.0, 5.0), ("y", 3.0, 5.0)], "k string, a double, b double")
    assert [tuple(r) for r in minmax_profile(df, ["a", "b"]).orderBy("k").collect()] == [("x", 0, 1), ("y", 1, 1)]
    assert [r.b for r in minmax_profile(df, ["a", "b"], constant=None).collect()] == [5.0, 5.0]


def test_pivot_first(spark):
    df = spark.createDataFrame([("x", 0, 1.0), ("x", 2, 3.0)], "k string, m int, v double")
    assert pivot_first(df, "k", "m", range(3), "v", "M").first().asDict() == {
        "k": "x", "M0": 1.0, "M1": None, "M2": 3.0}


def test_scope_bounds_and_leap_day(spark):
    orders = spark.createDataFrame([(1, "2024-02-29", 1), (2, "2024-03-01", 1), (3, "2023-02-28", 1),
                                    (4, "2024-02-29", 9)], "order_id int, d string, location_id int").select(
        "order_id", F.col("d").cast("timestamp_ntz").alias("ordered_at"), "location_id")
    places = spark.createDataFrame([(1, "A"), (2, "B")], "location_id int, location_name string")
    assert [r.order_id for r in scope(orders, places, "2024-02-29", "2024-02-29").collect()] == [1]
    assert scope(orders, places, "2024-01-01", "2024-12-31", ["B"]).count() == 0
    assert [r.order_id for r in prior_scope(orders, places, "2024-02-29", "2024-02-29", ["A"]).collect()] == [3]
    assert prior_year("2024-02-29").isoformat() == "2023-02-28"

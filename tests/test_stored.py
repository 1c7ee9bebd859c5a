"""Bucketed tables, tables in versions, and checks counted while writing."""

import datetime as dt
from functools import reduce

import pytest
from conftest import SF
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillmart.operators import checks
from tillmart.plans import layers, marts, staging
from tillmart.sources import buckets, fixture_tables, versions


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rules = {"orders": [("not_null", "order_id"), ("not_null", "order_cost"), ("unique", "order_id"),
                        ("expression", "order_total > 100"), ("relationship", "customer_id", "customers", "customer_id")],
             "customers": [("accepted", "customer_type", ["new"]), ("not_null", "customer_id")]}
    return layers.store_layers(fixture_tables(spark, SF), str(tmp_path_factory.mktemp("layers")), rules), rules


def exchanges(df: DataFrame) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "SinglePartition" not in line]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_and_windows_on_stored_marts_need_no_exchange(spark, stored, no_broadcast):
    parts = stored[0].parts
    orders, items, customers = parts["orders"].even, parts["order_items"].even, parts["customers"].even
    assert not exchanges(items.groupBy("order_id").agg(F.sum("supply_cost")))
    assert not exchanges(orders.join(customers, "customer_id", "left"))
    assert not exchanges(customers.join(orders.groupBy("customer_id").agg(F.count("*")), "customer_id", "left"))
    last = F.lag("ordered_at").over(W.partitionBy("customer_id").orderBy("ordered_at", "order_id"))
    assert not exchanges(orders.withColumn("last", last))
    assert exchanges(orders.join(items, "order_id"))  # orders lie by customer


def test_items_meet_orders_by_order_without_exchange(spark, tmp_path, no_broadcast):
    stg = staging.stage_all(fixture_tables(spark, SF))
    heavy = buckets.heavy_keys(stg["stg_order_items"], "order_id", 8)
    orders, items = [buckets.save_bucketed(buckets.align(stg[n], "order_id", heavy), "order_id", f"{tmp_path}/{n}", 8)
                     for n in ("stg_orders", "stg_order_items")]
    joined = items.even.join(orders.even, "order_id", "left")
    assert not exchanges(joined) and joined.count() == stg["stg_order_items"].count()
    again = buckets.open_bucketed(spark, "order_id", f"{tmp_path}/stg_orders", 8)
    assert sorted(again.whole().collect()) == sorted(stg["stg_orders"].collect())


def test_stored_marts_equal_marts_made_at_once(spark, stored):
    made = marts.build_marts(staging.stage_all(fixture_tables(spark, SF)))
    for name in ("orders", "order_items", "customers"):
        assert sorted(map(repr, stored[0][name].select(made[name].columns).collect())) == sorted(map(repr, made[name].collect())), name


def test_heavy_and_missing_keys_are_set_apart(spark, tmp_path):
    rows = [(i, 1 if i % 3 == 0 else None if i % 3 == 1 else 100 + i % 90) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k int")
    heavy = buckets.heavy_keys(df, "k", 8)
    assert [r.k for r in heavy.collect()] == [1]
    saved = buckets.save_bucketed(buckets.align(df, "k", heavy), "k", str(tmp_path), 8)
    assert sorted(r.id for r in saved.heavy.collect()) == [i for i, k in rows if k in (1, None)]
    assert sorted(map(tuple, saved.whole().collect()), key=repr) == sorted(rows, key=repr)
    sizes = saved.even.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * 300 / len(sizes)
    counted = buckets.aligned(lambda a: a.groupBy("k").count(), saved).whole()
    assert {r.k: r["count"] for r in counted.collect()} == {r.k: r["count"] for r in df.groupBy("k").count().collect()}


def test_tables_without_rows_or_keys(spark, tmp_path):
    df = spark.createDataFrame([], "id int, k int")
    saved = buckets.save_bucketed(buckets.align(df, "k", buckets.heavy_keys(df, "k", 4)), "k", f"{tmp_path}/a", 4)
    assert saved.whole().count() == 0
    out = versions.refresh(df.selectExpr("id", "timestamp_ntz'2024-01-01' AS ts"), f"{tmp_path}/b", versions.month_part("ts"),
                           lambda d: d, versions.month_part("ts"))
    assert out.count() == 0 and versions.publish(df, f"{tmp_path}/c").count() == 0


def test_checks_counted_while_writing_equal_a_second_scan(spark, stored):
    out, rules = stored
    scanned = checks.run_checks(dict(out), rules)
    assert sorted(map(tuple, out.checks(rules, {}).collect())) == sorted(map(tuple, scanned.collect()))
    assert out.row_counts() == {name: out[name].count() for name in rules}
    assert all(kind in checks.ROW_RULES for w in out._watched.values() for kind, *_ in w.rules)


def sales(spark, rows):
    return spark.createDataFrame(rows, "id int, day string, amount int").selectExpr("id", "CAST(day AS timestamp_ntz) AS day", "amount")


def totals(df):
    return df.groupBy(F.trunc(F.col("day").cast("date"), "month").cast("timestamp_ntz").alias("month")).agg(F.sum("amount").alias("amount"))


def found(df):
    return {None if r["month"] is None else r["month"].strftime("%Y-%m"): r["amount"] for r in df.collect()}


ROWS = [(1, "2024-01-05", 10), (2, "2024-01-06", 5), (3, "2024-02-01", 7), (4, "2024-03-09", 1), (5, None, 2)]


def refresh(spark, rows, target, build=totals, others=()):
    return versions.refresh(sales(spark, rows), target, versions.month_part("day"), build, versions.month_part("month"), others)


def test_a_late_row_rewrites_only_its_month(spark, tmp_path):
    target, built = str(tmp_path / "t"), []

    def build(df):
        built.append(sorted(r["m"] for r in df.select(versions.month_part("day").alias("m")).distinct().collect()))
        return totals(df)

    assert found(refresh(spark, ROWS, target, build)) == {"2024-01": 15, "2024-02": 7, "2024-03": 1, None: 2}
    old = {r["part"]: r["folder"] for r in versions._versions(spark, target)}
    late = [*ROWS, (6, "2024-02-20", 3), (7, "2024-04-01", 4)]
    assert found(refresh(spark, late, target, build)) == {"2024-01": 15, "2024-02": 10, "2024-03": 1, "2024-04": 4, None: 2}
    new = {r["part"]: r["folder"] for r in versions._versions(spark, target)}
    assert built[1] == ["2024-02", "2024-04"] and {p for p in old if old[p] == new[p]} == {"2024-01", "2024-03", "none"}
    # A row moved, one changed and one gone; then nothing.
    changed = [(1, "2024-01-05", 10), (2, "2024-03-06", 5), (3, "2024-02-01", 8), (4, "2024-03-09", 1), (6, "2024-02-20", 3)]
    assert found(refresh(spark, changed, target, build)) == {"2024-01": 10, "2024-02": 11, "2024-03": 6}
    assert built[2] == ["2024-01", "2024-02", "2024-03"]
    before = versions._versions(spark, target)
    refresh(spark, changed[::-1], target, build)
    assert sorted(before) == sorted(versions._versions(spark, target)) and built[3] == []


def test_a_changed_dimension_rewrites_every_month(spark, tmp_path):
    one, two = [spark.createDataFrame([(n,)], "name string") for n in "ab"]
    refresh(spark, ROWS, str(tmp_path), others=[one])
    old = {r["folder"] for r in versions._versions(spark, str(tmp_path))}
    refresh(spark, ROWS, str(tmp_path), others=[two])
    assert not old & {r["folder"] for r in versions._versions(spark, str(tmp_path))}


def test_equal_rows_do_not_cancel_out(spark, tmp_path):
    refresh(spark, ROWS, str(tmp_path))
    assert found(refresh(spark, ROWS + [ROWS[2]] * 2, str(tmp_path)))["2024-02"] == 21


def test_a_broken_run_leaves_the_old_version(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    refresh(spark, ROWS, target)

    def broken(df):
        return totals(df).withColumn("amount", F.when(F.col("month") >= F.lit(dt.datetime(2024, 2, 1)), F.raise_error(F.lit("off"))).otherwise(
            F.col("amount")).cast("bigint"))

    with pytest.raises(Exception, match="off"):
        refresh(spark, [*ROWS, (8, "2024-01-01", 1), (9, "2024-02-02", 1)], target, broken)
    schema = totals(sales(spark, ROWS)).schema
    assert found(versions.current(spark, target, schema)) == {"2024-01": 15, "2024-02": 7, "2024-03": 1, None: 2}
    with monkeypatch.context() as m:  # data written, version not
        m.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            refresh(spark, [*ROWS, (9, "2024-02-02", 1)], target)
    assert found(versions.current(spark, target, schema))["2024-02"] == 7
    assert found(refresh(spark, [*ROWS, (9, "2024-02-02", 1)], target))["2024-02"] == 8


def test_publish_keeps_the_old_version_until_the_new_one_is_whole(spark, tmp_path):
    target = str(tmp_path / "t")
    old = versions.publish(spark.range(3), target)
    with pytest.raises(Exception, match="off"):
        versions.publish(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("off"))).otherwise(F.col("id")).cast("bigint").alias("id")), target)
    assert old.count() == versions.current(spark, target, old.schema).count() == 3
    assert versions.publish(spark.range(4), target).count() == 4 and old.count() == 3


def test_refreshed_facts_follow_a_late_order(spark, tmp_path):
    """An order that comes in late makes the customer's next one a returning order, months later."""
    stg = staging.stage_all(fixture_tables(spark, SF))
    first = stg["stg_orders"].groupBy("customer_id").agg(F.min("ordered_at").alias("a"), F.count("*").alias("n")).filter("n > 3").orderBy(
        "customer_id").first()
    is_late = (F.col("customer_id") == first["customer_id"]) & (F.col("ordered_at") == F.lit(first["a"]))

    def mart(orders):
        return marts.orders(orders, marts.price_items(stg["stg_order_items"], stg["stg_products"], stg["stg_supplies"]))

    target = str(tmp_path / "daily")
    layers.refresh_daily_revenue(mart(stg["stg_orders"].filter(~is_late)), stg["stg_locations"], target)
    old = {r["part"]: r["folder"] for r in versions._versions(spark, target)}
    got = layers.refresh_daily_revenue(mart(stg["stg_orders"]), stg["stg_locations"], target)
    whole = layers.facts.daily_revenue(mart(stg["stg_orders"]), stg["stg_locations"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    new = {r["part"]: r["folder"] for r in versions._versions(spark, target)}
    touched = {f"{r['ordered_at']:%Y-%m}" for r in stg["stg_orders"].filter(F.col("customer_id") == first["customer_id"]).collect()}
    assert {p for p in new if old.get(p) != new[p]} == touched


def test_skewed_layers_equal_marts_made_at_once(spark, tmp_path):
    """A third of the orders of one customer, a third of none; a third of the items of one order."""
    raw = fixture_tables(spark, SF)
    raw["raw_orders"] = raw["raw_orders"].withColumn(
        "customer", F.expr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE customer END"))
    raw["raw_items"] = raw["raw_items"].withColumn("order_id", F.expr("CASE WHEN xxhash64(id) % 3 = 0 THEN 7 ELSE order_id END"))
    out = layers.store_layers(raw, str(tmp_path))
    made = marts.build_marts(staging.stage_all(raw))
    for name in ("orders", "order_items", "customers"):
        assert sorted(map(repr, out[name].select(made[name].columns).collect())) == sorted(map(repr, made[name].collect())), name
    facts = layers.facts.churn_features(made["customers"], made["orders"])
    assert sorted(map(repr, out["fct_customer_churn_features"].collect())) == sorted(map(repr, facts.collect()))
    assert reduce(max, [r["count"] for r in out.parts["orders"].even.groupBy("customer_id").count().collect()]) * 8 <= out["orders"].count()

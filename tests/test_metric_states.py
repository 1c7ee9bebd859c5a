"""Averages and distinct counts by dimensions of other marts, against plain joins."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from catalog.queries import _marts
from tillmart.plans import metrics

NEW = {"buyers": ("orders", F.countDistinct, "customer_id"), "average_order": ("orders", F.avg, "order_total"),
       "average_price": ("order_items", F.avg, "product_price"), "products_sold": ("order_items", F.countDistinct, "product_id")}


@pytest.fixture(scope="module")
def marts(spark):
    stored = {n: df.persist() for n, df in _marts(spark, SF).items()}
    yield stored
    for df in stored.values():  # later tests look at plans
        df.unpersist()


def plain(rows, keys, **aggregates):
    return {tuple(r[k] for k in keys): tuple(r[a] for a in aggregates) for r in rows.groupBy(*keys).agg(
        *[c.alias(a) for a, c in aggregates.items()]).collect()}


def same(got, keys, names, want):
    got = {tuple(r[k] for k in keys): tuple(r[n] for n in names) for r in got.collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(tuple(float(v) if v is not None else None for v in values), rel=1e-9)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_states_equal_plain_joins(spark, marts, monkeypatch, kind):
    monkeypatch.setattr(metrics, "SIMPLE", {**metrics.SIMPLE, **NEW})
    orders = marts["orders"].withColumn("_n", F.crc32(F.col("customer_id").cast("string").cast("binary")) % 5000)
    key = F.when(F.col("_n") % 9 != 0, F.col("_n")).cast(kind)  # some orders have no customer
    orders = orders.withColumn("customer_id", key).drop("_n")
    customers = marts["customers"].withColumn("customer_id", (F.crc32(F.col("customer_id").cast("string").cast("binary")) % 5000).cast(
        kind)).dropDuplicates(["customer_id"])
    given = {**marts, "orders": orders, "customers": customers}
    month = F.date_trunc("month", "ordered_at").cast(dict(metrics.metric_query(given, ["orders"], grain="month").dtypes)["metric_time"])
    wide = orders.join(marts["locations"].select("location_id", "location_name"), "location_id", "left").join(
        customers.select("customer_id", "customer_type"), "customer_id", "left").withColumn("metric_time", month)
    for keys, grain in ((["location_name"], None), (["location_name", "customer_type"], "month"), ([], "month")):
        want = plain(wide, [*keys, *(["metric_time"] if grain else [])], buyers=F.countDistinct("customer_id"),
                     average_order=F.avg(F.col("order_total").cast("double")), orders=F.count("*"))
        got = metrics.metric_query(given, ["buyers", "average_order", "orders"], keys, grain)
        same(got, [*keys, *(["metric_time"] if grain else [])], ["buyers", "average_order", "orders"], want)
    want = plain(wide.filter("customer_type = 'returning'"), ["location_name"], buyers=F.countDistinct("customer_id"))
    same(metrics.metric_query(given, ["buyers"], ["location_name"], where="customer_type = 'returning'"), ["location_name"],
         ["buyers"], want)
    total = metrics.metric_query(given, ["buyers", "average_order"]).first()
    assert total.buyers == orders.select("customer_id").filter("customer_id is not null").distinct().count()
    none = metrics.metric_query({**given, "orders": orders.limit(0)}, ["buyers", "average_order"]).first()
    assert tuple(none) == (0, None)


def test_items_reach_the_locations(marts, monkeypatch):
    monkeypatch.setattr(metrics, "SIMPLE", {**metrics.SIMPLE, **NEW})
    wide = marts["order_items"].join(marts["orders"].select("order_id", "location_id"), "order_id", "left").join(
        marts["locations"].select("location_id", "location_name"), "location_id", "left")
    want = plain(wide, ["location_name"], products_sold=F.countDistinct("product_id"),
                 average_price=F.avg(F.col("product_price").cast("double")))
    same(metrics.metric_query(marts, ["products_sold", "average_price"], ["location_name"]), ["location_name"],
         ["products_sold", "average_price"], want)

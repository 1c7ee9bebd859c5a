"""Every registered query with SQL against DuckDB on the smallest tables, and invariants."""

import pytest
from compare import connect, difference
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry

ORACLES, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


def test_retention_starts_at_one(spark):
    cohorts = QUERIES["fct_cohorts"](spark, SF)
    assert cohorts.filter("months_since_first_order = 0 and retention_rate <> 1").count() == 0
    assert cohorts.filter("months_since_first_order < 0 or retention_rate not between 0 and 1").count() == 0


def test_shares_sum_to_hundred(spark):
    total = QUERIES["order_composition"](spark, SF).agg(F.sum("pct")).first()[0]
    assert abs(total - 100) < 0.3


def test_order_kinds_do_not_exceed_orders(spark):
    daily = QUERIES["fct_daily_revenue"](spark, SF)
    assert daily.filter("food_only_orders + drink_only_orders + mixed_orders > total_orders").count() == 0
    assert daily.filter("new_customer_orders + returning_customer_orders <> total_orders").count() == 0


def test_variance_effects_explain_the_change(spark):
    effects = {}
    for r in QUERIES["variance_decomposition"](spark, SF).collect():
        effects.setdefault(r.month, []).append(r.value)
    months = [r for r in QUERIES["monthly_trend"](spark, SF).orderBy("month").collect()]
    for prev, now in zip(months, months[1:]):
        cross = (now.orders - prev.orders) * (now.aov - prev.aov)
        assert abs(sum(effects[now.month]) + cross - (now.revenue - prev.revenue)) < 5 + 0.02 * now.orders


def test_limit_sample(spark):
    assert QUERIES["sample_rows"](spark, SF).count() == 20

"""Every registered query with, where SQL can express it, the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmart import functions as fn
from tillmart.operators import aggregates, checks, distinct
from tillmart.operators import scope as scopes
from tillmart.operators.partitions import size_partitions, stored_bytes
from tillmart.operators.shared_storage import materialize, new_folder, store
from tillmart.plans import analyses, facts, layers, marts, metrics, reports, staging
from tillmart.sources import (
    check_bad_lines, date_spine, export_table, fixture_tables, read_raw, read_raw_quarantined, run_sql, save_table,
    table_catalog,
)
from tillmart.sources.fixtures import SCHEMAS
from tillmart.sources.spine import spine_over

from . import models
from .oracles import FACT_SQL, churn_sql, div, even, rnd, whole, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Scope of the queries that show the filters themselves.
PART_START, PART_END, PART_NAMES = "1998-03-01", "2000-02-29", ["NATION_1", "NATION_7", "NATION_20"]


def doubles(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles, for comparison."""
    return df.select(*[F.col(f"`{n}`").cast("double").alias(n) if t.startswith("decimal") else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size_partitions(spark, stored_bytes(spark, [f"{sf_dir}/{table}.parquet" for table in SCHEMAS]))
            return doubles(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@lru_cache(maxsize=4)  # plans only: a query that uses several tables builds them once
def _stg(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return staging.stage_all(fixture_tables(spark, sf_dir))


@lru_cache(maxsize=4)
def _marts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return marts.build_marts(_stg(spark, sf_dir))


def _revenue_marts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The marts with an item mart that leaves supply costs out: revenue metrics do not need them."""
    s = _stg(spark, sf_dir)
    return {**_marts(spark, sf_dir),
            "order_items": marts.order_items(s["stg_order_items"], s["stg_orders"], s["stg_products"])}


def _sales(spark, sf_dir, orders: DataFrame | None = None, monthly: bool = False, costs: bool = True) -> DataFrame:
    s = _stg(spark, sf_dir)
    how = "left" if orders is None else "inner"
    if monthly and orders is None:
        orders = s["stg_orders"]
    return marts.sales(s["stg_order_items"], s["stg_products"], s["stg_supplies"] if costs else None, orders, how)


def _cogs(spark, sf_dir) -> DataFrame:
    return facts.supply_cogs(_sales(spark, sf_dir), _stg(spark, sf_dir)["stg_supplies"])


def _features(spark, sf_dir, days: int = 30) -> DataFrame:
    """From marts that leave supply costs out: the features do not need them."""
    s = _stg(spark, sf_dir)
    orders = marts.orders(s["stg_orders"], marts.flag_items(s["stg_order_items"], s["stg_products"]))
    return facts.churn_features(marts.customers(s["stg_customers"], orders), orders, days)


def _cohorts(spark, sf_dir) -> DataFrame:
    m = _marts(spark, sf_dir)
    return facts.cohorts(m["customers"], m["orders"])


def _locations_fact(spark, sf_dir) -> DataFrame:
    m = _marts(spark, sf_dir)
    return facts.location_performance(m["orders"], m["locations"])


def _scoped(spark, sf_dir) -> DataFrame:
    m = _marts(spark, sf_dir)
    return scopes.scope(m["orders"], m["locations"])


SCOPED = "m_orders JOIN stg_locations USING (location_id)"

# -- sources and sinks ------------------------------------------------------------------------------------------------

for _name in ("raw_customers", "raw_orders", "raw_items", "raw_products", "raw_stores", "raw_supplies"):
    query(f"fixture_{_name}", with_ctes(f"SELECT * FROM {_name}"))(
        lambda spark, d, n=_name: fixture_tables(spark, d)[n])


@query("read_raw", with_ctes("""SELECT id::VARCHAR AS id, customer::VARCHAR AS customer, ordered_at,
    store_id::VARCHAR AS store_id, subtotal, tax_paid, order_total FROM raw_orders"""))
def _(spark, d):
    folder = new_folder(spark, "csv")
    fixture_tables(spark, d)["raw_orders"].select(
        "id", "customer", "ordered_at", "store_id", "subtotal", "tax_paid", "order_total",
    ).write.option("header", True).csv(f"{folder}/raw_orders.csv")
    return read_raw(spark, folder, "raw_orders")


def _damaged(spark, d):
    """Orders as CSV, some of them with an unreadable total."""
    folder = new_folder(spark, "csv")
    rows = fixture_tables(spark, d)["raw_orders"]
    number = F.regexp_replace(F.col("id").cast("string"), "[^0-9]", "").cast("long")
    total = F.col("order_total").cast("string")
    odd = F.when(number % 50 == 0, F.concat(total, F.lit("?"))).when(number % 50 == 1, F.lit("n/a")).otherwise(total)
    (rows.select("id", "customer", F.date_format("ordered_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ordered_at"), "store_id",
                 "subtotal", "tax_paid", odd.alias("order_total"))
     .write.option("header", True).csv(f"{folder}/raw_orders.csv"))
    return read_raw_quarantined(spark, folder, "raw_orders")


_DAMAGED = "regexp_replace(id::VARCHAR, '[^0-9]', '', 'g')::BIGINT % 50 IN (0, 1)"


@query("read_raw_quarantined", with_ctes(f"""SELECT id::VARCHAR AS id, customer::VARCHAR AS customer, ordered_at,
    store_id::VARCHAR AS store_id, subtotal, tax_paid, order_total FROM raw_orders WHERE NOT ({_DAMAGED})"""))
def _(spark, d):
    return _damaged(spark, d).good


@query("raw_bad_lines", with_ctes(f"""SELECT 'raw_orders' AS table_name, concat_ws(',', id, customer,
    strftime(ordered_at, '%Y-%m-%dT%H:%M:%S'), store_id, subtotal, tax_paid, CASE WHEN
    regexp_replace(id::VARCHAR, '[^0-9]', '', 'g')::BIGINT % 50 = 0 THEN order_total::VARCHAR || '?' ELSE 'n/a' END) AS line
    FROM raw_orders WHERE {_DAMAGED}"""))
def _(spark, d):
    return _damaged(spark, d).bad.select("table_name", "line")


@query("check_bad_lines", with_ctes(f"""SELECT 'raw_orders: readable lines' AS check_name, count(*) AS failures
    FROM raw_orders WHERE {_DAMAGED}"""))
def _(spark, d):
    return check_bad_lines({"raw_orders": _damaged(spark, d)})


@query("date_spine", with_ctes("""SELECT unnest(generate_series((SELECT min(ordered_at)::DATE FROM stg_orders),
    (SELECT max(ordered_at)::DATE FROM stg_orders), INTERVAL 1 DAY))::TIMESTAMP AS date_day"""))
def _(spark, d):
    return spine_over(_stg(spark, d)["stg_orders"], "ordered_at").select(F.col("date_day").cast("timestamp_ntz"))


@query("date_spine_orders", with_ctes("""
  SELECT date_day::TIMESTAMP AS date_day, count(order_id) AS orders
  FROM (SELECT unnest(generate_series((SELECT min(ordered_at)::DATE FROM stg_orders),
          (SELECT max(ordered_at)::DATE FROM stg_orders), INTERVAL 1 DAY))::DATE AS date_day)
  LEFT JOIN stg_orders ON ordered_at = date_day GROUP BY 1"""))
def _(spark, d):
    orders = _stg(spark, d)["stg_orders"]
    daily = orders.groupBy(F.col("ordered_at").cast("date").alias("date_day")).agg(
        F.count("order_id").alias("orders"))
    days = spine_over(orders, "ordered_at").select(F.col("date_day").cast("date"))
    return days.join(daily, "date_day", "left").select(
        F.col("date_day").cast("timestamp_ntz"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("save_table", with_ctes("""SELECT customer_id, customer_name, customer_type, count_lifetime_orders
    FROM m_customers"""))
def _(spark, d):
    saved = save_table(_marts(spark, d)["customers"], "customers", "marts", path=new_folder(spark, "tables"),
                       partition_by=["customer_type"])
    return saved.select("customer_id", "customer_name", "customer_type", "count_lifetime_orders")


@query("export_order_metrics", with_ctes("""SELECT ordered_at AS metric_time, count(*) AS orders,
    count(*) FILTER (customer_order_number = 1) AS new_customer_orders, sum(order_total)::DOUBLE AS order_total,
    count(*) FILTER (is_food_order) AS food_orders, count(*) FILTER (is_drink_order) AS drink_orders
    FROM m_orders GROUP BY 1"""))
def _(spark, d):
    return export_table(metrics.saved_query(_marts(spark, d), "order_metrics"), "order_metrics",
                        path=new_folder(spark, "exports"))


@query("export_revenue_metrics", with_ctes("""SELECT ordered_at AS metric_time, sum(product_price)::DOUBLE AS revenue,
    sum(CASE WHEN is_food_item THEN product_price ELSE 0 END)::DOUBLE AS food_revenue,
    sum(CASE WHEN is_drink_item THEN product_price ELSE 0 END)::DOUBLE AS drink_revenue FROM m_order_items GROUP BY 1"""))
def _(spark, d):
    return export_table(metrics.saved_query(_marts(spark, d), "revenue_metrics"), "revenue_metrics",
                        path=new_folder(spark, "exports"))


@query("export_customer_order_metrics", with_ctes(f"""SELECT customer_id, count_lifetime_orders,
    lifetime_spend_pretax::DOUBLE AS lifetime_spend_pretax,
    {div('lifetime_spend_pretax', 'count_lifetime_orders')} AS average_order_value FROM m_customers"""))
def _(spark, d):
    return export_table(metrics.saved_query(_marts(spark, d), "customer_order_metrics"), "customer_order_metrics",
                        path=new_folder(spark, "exports"))


@query("table_catalog", with_ctes("""
  SELECT 'orders' AS table_name, 18::BIGINT AS n_columns, count(*) AS n_rows, min(ordered_at) AS first_day,
         max(ordered_at) AS last_day FROM m_orders
  UNION ALL SELECT 'order_items', 9, count(*), min(ordered_at), max(ordered_at) FROM m_order_items
  UNION ALL SELECT 'customers', 9, count(*), min(first_ordered_at), max(first_ordered_at) FROM m_customers
  UNION ALL SELECT 'products', 7, count(*), NULL, NULL FROM stg_products
  UNION ALL SELECT 'locations', 4, count(*), min(opened_date), max(opened_date) FROM stg_locations
  UNION ALL SELECT 'supplies', 6, count(*), NULL, NULL FROM stg_supplies"""))
def _(spark, d):
    return table_catalog(_marts(spark, d))


@query("adhoc_sql", with_ctes("""SELECT location_name, customer_type, count(*) AS orders,
    sum(order_total)::DOUBLE AS revenue FROM m_orders JOIN m_customers USING (customer_id)
    JOIN stg_locations USING (location_id) GROUP BY 1, 2"""))
def _(spark, d):
    m = _marts(spark, d)
    return run_sql(spark, """
        SELECT location_name, customer_type, count(*) AS orders, sum(order_total) AS revenue
        FROM v_orders JOIN v_customers USING (customer_id) JOIN v_locations USING (location_id)
        GROUP BY location_name, customer_type""", {f"v_{k}": v for k, v in m.items()})


# -- distinct counts that merge: bitmaps of days become those of weeks and months --------------------------------------

DISTINCT = ["customer_id", "location_id", "order_id"]
for _unit in ("week", "month"):
    @query(f"distinct_by_{_unit}", with_ctes(f"""SELECT date_trunc('{_unit}', ordered_at)::TIMESTAMP AS {_unit},
        count(DISTINCT customer_id) AS customer_id, count(DISTINCT location_id) AS location_id,
        count(DISTINCT order_id) AS order_id FROM stg_orders GROUP BY 1"""))
    def _(spark, d, unit=_unit):
        days = distinct.distinct_states(_stg(spark, d)["stg_orders"], ["ordered_at"], DISTINCT)
        merged = distinct.merge_states(days, **{unit: fn.truncate_to("ordered_at", unit)})
        return distinct.state_counts(merged, [unit], DISTINCT)


@query("distinct_by_location", with_ctes("""SELECT location_id, count(DISTINCT customer_id) AS customer_id,
    count(DISTINCT order_id) AS order_id, count(DISTINCT strftime(ordered_at, '%Y-%m')) AS months
    FROM stg_orders GROUP BY 1"""))
def _(spark, d):
    orders = _stg(spark, d)["stg_orders"].withColumn("months", fn.month_key("ordered_at"))
    return distinct.distinct_counts(orders, ["location_id"], ["customer_id", "order_id", "months"])


# -- staging ----------------------------------------------------------------------------------------------------------

for _name, _money in {"stg_customers": "", "stg_orders": "subtotal tax_paid order_total", "stg_order_items": "",
                      "stg_products": "product_price", "stg_locations": "", "stg_supplies": "supply_cost"}.items():
    query(_name.replace("stg_", "stage_"), whole(_name, _money))(lambda spark, d, n=_name: _stg(spark, d)[n])

# -- scalar functions -------------------------------------------------------------------------------------------------


@query("fn_cents_to_dollars", with_ctes("""SELECT id, (order_total::DECIMAL(18,0) / 100)::DECIMAL(16,2)::DOUBLE
    AS default_usd, (order_total / 100.0)::DOUBLE AS postgres_usd, order_total / 100::DOUBLE AS bigquery_usd,
    (order_total / 100)::DECIMAL(16,2)::DOUBLE AS fabric_usd FROM raw_orders"""))
def _(spark, d):
    return fixture_tables(spark, d)["raw_orders"].select("id", *[
        fn.cents_to_dollars("order_total", v).alias(f"{v}_usd") for v in ("default", "postgres", "bigquery", "fabric")])


@query("fn_surrogate_key", """SELECT c_custkey, md5(c_name || '-' || coalesce(CASE WHEN c_mktsegment <> 'BUILDING'
    THEN c_mktsegment END, '_dbt_utils_surrogate_key_null_')) AS key FROM customer""")
def _(spark, d):
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return spark.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", fn.surrogate_key("c_name", segment).alias("key"))


@query("fn_safe_div", """SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_acctbal / (c_nationkey % 5) END AS q
    FROM customer""")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", fn.safe_div("c_acctbal", F.col("c_nationkey") % 5).alias("q"))


@query("fn_rounding", f"""SELECT o_orderkey, {rnd('o_totalprice / 7', 2)} AS away2, {rnd('o_totalprice')} AS away0,
    {rnd('-o_totalprice / 16', 1)} AS away_neg, {even('o_orderkey / 2', 0)} AS even0,
    {even('o_orderkey / 8', 1)} AS even1 FROM orders""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", fn.round_half_away(F.col("o_totalprice") / 7, 2).alias("away2"),
                    fn.round_half_away("o_totalprice").alias("away0"),
                    fn.round_half_away(-F.col("o_totalprice") / 16, 1).alias("away_neg"),
                    fn.round_half_even(F.col("o_orderkey") / 2).alias("even0"),
                    fn.round_half_even(F.col("o_orderkey") / 8, 1).alias("even1"))


@query("fn_calendar", """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
    datediff('month', o_orderdate, l_shipdate) AS months, datediff('day', o_orderdate, l_shipdate) AS days,
    date_trunc('week', l_shipdate) AS week, date_trunc('month', l_shipdate) AS month,
    date_trunc('quarter', l_shipdate) AS quarter, date_trunc('year', l_shipdate) AS year,
    strftime(l_shipdate, '%Y-%m') AS month_key, strftime(l_shipdate, '%b %Y') AS month_label,
    dayname(l_shipdate) AS day_name, dayofweek(l_shipdate) AS day_num
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    ship = "l_shipdate"
    return spark.read.parquet(f"{d}/lineitem.parquet").join(o, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", ship,
        fn.months_between_boundaries("o_orderdate", ship).alias("months"),
        fn.days_between("o_orderdate", ship).alias("days"),
        *[fn.truncate_to(ship, u).alias(u) for u in ("week", "month", "quarter", "year")],
        fn.month_key(ship).alias("month_key"), fn.month_label(ship).alias("month_label"),
        fn.day_name(ship).alias("day_name"), fn.weekday_number(ship).alias("day_num"))


@query("fn_value_map", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open'
    ELSE 'Other' END AS label, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS bare
    FROM orders""")
def _(spark, d):
    labels = {"F": "Finished", "O": "Open"}
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", fn.value_map("o_orderstatus", labels, "Other").alias("label"),
        fn.value_map("o_orderstatus", labels).alias("bare"))


# -- filters ----------------------------------------------------------------------------------------------------------

_NAMES = ", ".join(f"'{n}'" for n in PART_NAMES)


@query("flt_scope", with_ctes(f"""SELECT order_id, location_name, ordered_at, order_total::DOUBLE AS order_total
    FROM {SCOPED} WHERE ordered_at BETWEEN '{PART_START}' AND '{PART_END}' AND location_name IN ({_NAMES})"""))
def _(spark, d):
    m = _marts(spark, d)
    return scopes.scope(m["orders"], m["locations"], PART_START, PART_END, PART_NAMES).select(
        "order_id", "location_name", "ordered_at", "order_total")


@query("flt_prior_scope", with_ctes(f"""SELECT order_id, location_name, ordered_at,
    order_total::DOUBLE AS order_total FROM {SCOPED} WHERE ordered_at BETWEEN DATE '{PART_START}' - INTERVAL 1 YEAR
    AND DATE '{PART_END}' - INTERVAL 1 YEAR AND location_name IN ({_NAMES})"""))
def _(spark, d):
    m = _marts(spark, d)
    return scopes.prior_scope(m["orders"], m["locations"], PART_START, PART_END, PART_NAMES).select(
        "order_id", "location_name", "ordered_at", "order_total")


@query("flt_positive_spend", with_ctes("""SELECT customer_id, lifetime_spend::DOUBLE AS lifetime_spend
    FROM m_customers WHERE lifetime_spend IS NOT NULL AND lifetime_spend > 0"""))
def _(spark, d):
    return _marts(spark, d)["customers"].filter("lifetime_spend is not null and lifetime_spend > 0").select(
        "customer_id", "lifetime_spend")


@query("flt_split_at_cutoff", with_ctes("""WITH b AS (SELECT max(ordered_at) - INTERVAL 30 DAY AS c FROM stg_orders)
    SELECT order_id, ordered_at, CASE WHEN ordered_at <= c THEN 'train' ELSE 'holdout' END AS part
    FROM stg_orders, b"""))
def _(spark, d):
    train, holdout = scopes.split_at_cutoff(_stg(spark, d)["stg_orders"], 30)
    return train.withColumn("part", F.lit("train")).unionByName(holdout.withColumn("part", F.lit("holdout"))).select(
        "order_id", "ordered_at", "part")


# -- marts and facts --------------------------------------------------------------------------------------------------

for _name, _money in {
    "order_items": "product_price supply_cost",
    "orders": "subtotal tax_paid order_total order_cost order_items_subtotal",
    "customers": "lifetime_spend_pretax lifetime_tax_paid lifetime_spend",
}.items():
    query(f"mart_{_name}", whole(f"m_{_name}", _money))(lambda spark, d, n=_name: _marts(spark, d)[n])
for _name, _money in {"locations": "", "products": "product_price", "supplies": "supply_cost"}.items():
    query(f"mart_{_name}", whole(f"stg_{_name}", _money))(lambda spark, d, n=_name: _marts(spark, d)[n])


@query("fct_daily_revenue", whole("fct_daily_revenue", "total_revenue total_cost gross_profit"))
def _(spark, d):
    m = _marts(spark, d)
    return facts.daily_revenue(m["orders"], m["locations"])


@query("fct_product_performance",
       whole("fct_product_performance", "total_revenue total_supply_cost gross_profit"))
def _(spark, d):
    return facts.product_performance(_sales(spark, d, monthly=True))


_COGS_MONEY = ("total_revenue total_supply_cost perishable_cost_per_unit non_perishable_cost_per_unit "
               "total_perishable_cost total_non_perishable_cost gross_profit")
query("fct_supply_cogs", whole("fct_supply_cogs", _COGS_MONEY))(_cogs)


@query("fct_product_performance_from_mart",
       whole("fct_product_performance", "total_revenue total_supply_cost gross_profit"))
def _(spark, d):
    return facts.product_performance(_marts(spark, d)["order_items"])


@query("fct_supply_cogs_from_mart", whole("fct_supply_cogs", _COGS_MONEY))
def _(spark, d):
    m = _marts(spark, d)
    return facts.supply_cogs(m["order_items"], m["supplies"])


query("fct_location_performance",
      whole("fct_location_performance", "total_revenue total_cost total_gross_profit"))(_locations_fact)
query("fct_cohorts", whole("fct_cohorts", ""))(_cohorts)
query("fct_customer_churn_features", whole("fct_customer_churn_features", "lifetime_spend"))(_features)
query("fct_customer_churn_features_365",
      with_ctes(f"SELECT * REPLACE (lifetime_spend::DOUBLE AS lifetime_spend) FROM ({churn_sql(365)}) /* m_ */"))(
    lambda spark, d: _features(spark, d, 365))

# -- business analyses ------------------------------------------------------------------------------------------------


@query("revenue_trends", with_ctes(f"""
  WITH w AS (SELECT date_trunc('week', ordered_at) AS week_start, count(order_id) AS orders,
                    sum(order_total) AS revenue, {rnd(div('sum(order_total)', 'count(order_id)'), 2)} AS aov,
                    count(DISTINCT customer_id) AS unique_customers FROM m_orders GROUP BY 1)
  SELECT week_start, orders, revenue::DOUBLE AS revenue, aov, unique_customers,
         lag(revenue) OVER o::DOUBLE AS prev_week_revenue,
         {div('sum(revenue) OVER (ORDER BY week_start ROWS 3 PRECEDING)',
              'count(*) OVER (ORDER BY week_start ROWS 3 PRECEDING)')} AS ma_4week_revenue,
         {rnd(div('revenue - lag(revenue) OVER o', 'lag(revenue) OVER o') + ' * 100', 1)} AS wow_growth_pct,
         (sum(revenue) OVER o)::DOUBLE AS cumulative_revenue
  FROM w WINDOW o AS (ORDER BY week_start)""".replace("lag(revenue) OVER o::DOUBLE", "(lag(revenue) OVER o)::DOUBLE")))
def _(spark, d):
    return analyses.revenue_trends(_marts(spark, d)["orders"])


@query("retention_matrix", with_ctes("SELECT strftime(cohort_month, '%Y-%m') AS cohort, cohort_size, " + ", ".join(
    f"max(CASE WHEN months_since_first_order = {i} THEN {rnd('retention_rate * 100', 1)} END) AS \"Month {i}\""
    for i in range(12)) + " FROM fct_cohorts GROUP BY 1, 2"))
def _(spark, d):
    return analyses.retention_matrix(_cohorts(spark, d))


@query("bcg_quadrants", with_ctes("SELECT * FROM bcg"))
def _(spark, d):
    return analyses.bcg_quadrants(_cogs(spark, d))


@query("location_benchmark", with_ctes(f"""
  WITH w AS (SELECT date_trunc('month', ordered_at) AS month, l.location_id, location_name, opened_date,
                    count(order_id) AS orders, sum(order_total) AS revenue,
                    {rnd(div('sum(order_total)', 'count(order_id)'), 2)} AS aov,
                    count(DISTINCT customer_id) AS unique_customers,
                    datediff('month', opened_date, date_trunc('month', ordered_at)) AS months_since_open
             FROM m_orders o LEFT JOIN stg_locations l ON l.location_id = o.location_id GROUP BY 1, 2, 3, 4)
  SELECT * REPLACE (revenue::DOUBLE AS revenue), (lag(revenue) OVER o)::DOUBLE AS prev_month_revenue,
         {rnd(div('revenue - lag(revenue) OVER o', 'lag(revenue) OVER o') + ' * 100', 1)} AS mom_growth_pct,
         {div('sum(revenue) OVER (PARTITION BY location_id ORDER BY month ROWS 2 PRECEDING)',
              'count(*) OVER (PARTITION BY location_id ORDER BY month ROWS 2 PRECEDING)')} AS ma_3month_revenue,
         rank() OVER (PARTITION BY month ORDER BY revenue DESC) AS monthly_revenue_rank
  FROM w WINDOW o AS (PARTITION BY location_id ORDER BY month)"""))
def _(spark, d):
    m = _marts(spark, d)
    return analyses.location_benchmark(m["orders"], m["locations"])


_ACTION = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in analyses.SEGMENT_ACTIONS.items())


@query("rfm_segments", with_ctes(f"""SELECT * REPLACE (monetary::DOUBLE AS monetary),
    CASE rfm_segment {_ACTION} END AS recommended_action FROM rfm"""))
def _(spark, d):
    return analyses.rfm_segments(_features(spark, d))


@query("margin_erosion", with_ctes(f"""
  WITH p AS (SELECT date_trunc('month', ordered_at) AS month, product_id, product_name, is_food_item,
                    sum(product_price) AS revenue, sum(supply_cost) AS supply_cost,
                    count(order_item_id) AS units_sold FROM m_order_items GROUP BY 1, 2, 3, 4),
  q AS (SELECT p.* REPLACE (p.revenue::DOUBLE AS revenue, p.supply_cost::DOUBLE AS supply_cost),
               perishable_cost_per_unit::DOUBLE AS perishable_cost_per_unit,
               non_perishable_cost_per_unit::DOUBLE AS non_perishable_cost_per_unit,
               (perishable_cost_per_unit * p.units_sold)::DOUBLE AS monthly_perishable_cost,
               (p.revenue - p.supply_cost)::DOUBLE AS gross_profit,
               {rnd(div('p.revenue - p.supply_cost', 'p.revenue') + ' * 100', 1)} AS gross_margin_pct,
               {rnd(div('perishable_cost_per_unit * p.units_sold', 'p.revenue') + ' * 100', 1)}
                 AS perishable_pct_of_revenue
        FROM p LEFT JOIN fct_supply_cogs USING (product_id))
  SELECT *, gross_margin_pct - lag(gross_margin_pct) OVER (PARTITION BY product_id ORDER BY month)
              AS margin_mom_change_pts,
         coalesce(round(gross_margin_pct * 10)::BIGINT * count(*) OVER w < sum(round(gross_margin_pct * 10)::BIGINT)
                  OVER w, false) AS is_margin_declining,
         rank() OVER (PARTITION BY month ORDER BY perishable_pct_of_revenue DESC NULLS LAST) AS perishable_risk_rank
  FROM q WINDOW w AS (PARTITION BY product_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""))
def _(spark, d):
    return analyses.margin_erosion(_sales(spark, d, monthly=True), _stg(spark, d)["stg_supplies"])


# -- dashboard and report queries -------------------------------------------------------------------------------------

_STATS = f"""{rnd('sum(order_total)')} AS revenue, count(order_id) AS orders,
    {rnd(div('sum(order_total)', 'count(order_id)'), 2)} AS aov"""


@query("overview", with_ctes(f"""
  SELECT count(DISTINCT customer_id) AS customers, orders_now AS orders, revenue_now AS revenue,
         {rnd(div('sum(order_total)', 'count(*)'), 2)} AS aov,
         {rnd(div('sum(order_total - order_cost)', 'sum(order_total)') + ' * 100', 1)} AS margin_pct,
         prev_revenue, prev_orders,
         {even(div('revenue_now - prev_revenue', 'prev_revenue') + ' * 100')} AS revenue_delta_pct,
         {even(div('orders_now - prev_orders', 'prev_orders') + ' * 100')} AS orders_delta_pct
  FROM {SCOPED}, (SELECT count(*) AS orders_now, {rnd('sum(order_total)')} AS revenue_now FROM {SCOPED}
                  WHERE ordered_at BETWEEN '1999-01-01' AND '2000-12-31') n,
       (SELECT count(*) AS prev_orders, {rnd('sum(order_total)')} AS prev_revenue FROM {SCOPED}
        WHERE ordered_at BETWEEN '1998-01-01' AND '1999-12-31') p
  WHERE ordered_at BETWEEN '1999-01-01' AND '2000-12-31' GROUP BY ALL"""))
def _(spark, d):
    m = _marts(spark, d)
    return reports.overview(m["orders"], m["locations"], "1999-01-01", "2000-12-31")


@query("monthly_trend", with_ctes(f"""
  SELECT *, {even('(' + div('revenue', 'lag(revenue) OVER (ORDER BY month)') + ' - 1) * 100', 1)} AS mom_pct,
         strftime(month, '%b %Y') AS month_label
  FROM (SELECT date_trunc('month', ordered_at) AS month, {_STATS}, count(DISTINCT customer_id) AS customers
        FROM {SCOPED} GROUP BY 1)"""))
def _(spark, d):
    return reports.monthly_trend(_scoped(spark, d))


@query("weekly_trend", with_ctes(f"""
  SELECT *, CASE WHEN count(*) OVER w = 4 THEN {even('sum(revenue) OVER w / 4')} END AS ma4,
         {even('(' + div('revenue', 'lag(revenue) OVER (ORDER BY week)') + ' - 1) * 100', 1)} AS wow
  FROM (SELECT date_trunc('week', ordered_at) AS week, {_STATS} FROM {SCOPED} GROUP BY 1)
  WINDOW w AS (ORDER BY week ROWS 3 PRECEDING)"""))
def _(spark, d):
    return reports.weekly_trend(_scoped(spark, d))


@query("revenue_by_location",
       with_ctes(f"SELECT location_name, {rnd('sum(order_total)')} AS revenue FROM {SCOPED} GROUP BY 1"))
def _(spark, d):
    return reports.revenue_by_location(_scoped(spark, d))


@query("revenue_by_location_month", with_ctes(f"""SELECT date_trunc('month', ordered_at) AS month, location_name,
    {_STATS} FROM {SCOPED} GROUP BY 1, 2"""))
def _(spark, d):
    return reports.revenue_by_location_month(_scoped(spark, d))


@query("revenue_by_location_month_all", with_ctes(f"""SELECT date_trunc('month', ordered_at) AS month, location_id,
    location_name, {rnd('sum(order_total)')} AS revenue FROM m_orders LEFT JOIN stg_locations USING (location_id)
    GROUP BY 1, 2, 3"""))
def _(spark, d):
    m = _marts(spark, d)
    return reports.revenue_by_location_month_all(m["orders"], m["locations"])


@query("day_of_week", with_ctes(f"""SELECT dayname(ordered_at) AS day_of_week, dayofweek(ordered_at) AS day_num,
    {_STATS} FROM {SCOPED} GROUP BY 1, 2"""))
def _(spark, d):
    return reports.day_of_week(_scoped(spark, d))


def _composition_sql(labels: dict[str, str]) -> str:
    return with_ctes(f"""
  SELECT order_type, orders, {rnd('orders * 100.0::DOUBLE / sum(orders) OVER ()', 1)} AS pct, aov
  FROM (SELECT CASE WHEN is_food_order AND is_drink_order THEN '{labels["both"]}'
                    WHEN is_food_order AND NOT is_drink_order THEN '{labels["food"]}'
                    WHEN is_drink_order THEN '{labels["drink"]}' ELSE '{labels["none"]}' END AS order_type,
               count(*) AS orders, {rnd(div('sum(order_total)', 'count(*)'), 2)} AS aov FROM m_orders GROUP BY 1)""")


@query("order_composition", _composition_sql(reports.DASHBOARD_TYPES))
def _(spark, d):
    return reports.order_composition(_scoped(spark, d))


@query("order_composition_report", _composition_sql(reports.REPORT_TYPES))
def _(spark, d):
    return reports.order_composition(_marts(spark, d)["orders"], reports.REPORT_TYPES)


@query("variance_decomposition", with_ctes(f"""
  WITH m AS (SELECT date_trunc('month', ordered_at) AS month, count(order_id) AS orders,
                    {rnd(div('sum(order_total)', 'count(order_id)'), 4)} AS aov FROM {SCOPED} GROUP BY 1),
  e AS (SELECT *, lag(orders) OVER (ORDER BY month) AS po, lag(aov) OVER (ORDER BY month) AS pa FROM m)
  SELECT month, strftime(month, '%b %Y') AS month_label, 'Volume (more/fewer orders)' AS effect,
         {even('(orders - po) * pa')} AS value FROM e WHERE po IS NOT NULL
  UNION ALL SELECT month, strftime(month, '%b %Y'), 'Price (AOV change)', {even('(aov - pa) * po')}
  FROM e WHERE po IS NOT NULL"""))
def _(spark, d):
    return reports.variance_decomposition(_scoped(spark, d))


@query("product_monthly", with_ctes(f"""
  SELECT date_trunc('month', i.ordered_at) AS month, product_name, is_food_item,
         {rnd('sum(product_price)')} AS revenue, count(order_item_id) AS units
  FROM m_order_items i JOIN m_orders o USING (order_id) JOIN stg_locations USING (location_id) GROUP BY 1, 2, 3"""))
def _(spark, d):
    return reports.product_monthly(_sales(spark, d, _scoped(spark, d), costs=False))


@query("product_treemap", with_ctes(f"""
  SELECT category, product_name, sum(revenue) AS revenue, grouping(category, product_name)::BIGINT AS level
  FROM (SELECT product_name, CASE WHEN is_food_item THEN 'Food' ELSE 'Beverage' END AS category,
               {rnd('sum(product_price)')} AS revenue FROM m_order_items GROUP BY 1, 2)
  GROUP BY ROLLUP (category, product_name)"""))
def _(spark, d):
    return reports.product_treemap(_sales(spark, d, costs=False))


@query("product_ranking", with_ctes(f"""SELECT product_name, product_type, units_sold,
    {rnd('total_revenue')} AS revenue, {rnd('gross_margin_pct', 1)} AS margin_pct,
    {rnd('perishable_pct_of_revenue', 1)} AS perishable_risk_pct FROM fct_supply_cogs"""))
def _(spark, d):
    return reports.product_ranking(_cogs(spark, d))


@query("perishable_risk", with_ctes("""SELECT product_name, product_type, gross_margin_pct,
    perishable_pct_of_revenue, total_revenue::DOUBLE AS total_revenue FROM fct_supply_cogs"""))
def _(spark, d):
    return reports.perishable_risk(_cogs(spark, d))


_STRATEGY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.QUADRANT_STRATEGY.items())


@query("quadrant_summary", with_ctes(f"""
  SELECT bcg_quadrant, count(product_name) AS products, {even('sum(total_revenue)')} AS total_revenue,
         {even(div('sum(gross_margin_pct::DECIMAL(16,2))', 'count(gross_margin_pct)'), 1)} AS avg_margin,
         CASE bcg_quadrant {_STRATEGY} END AS strategy
  FROM fct_supply_cogs f JOIN (SELECT product_id, bcg_quadrant FROM bcg) q USING (product_id) GROUP BY 1"""))
def _(spark, d):
    cogs = materialize(_cogs(spark, d))  # read for the quadrants and for the sums
    return reports.quadrant_summary(analyses.bcg_quadrants(cogs), cogs)


@query("cost_breakdown", with_ctes("""
  SELECT product_id, product_name, product_type, total_revenue::DOUBLE AS total_revenue, gross_margin_pct,
         'Perishable' AS cost_type, total_perishable_cost::DOUBLE AS cost FROM fct_supply_cogs
  UNION ALL SELECT product_id, product_name, product_type, total_revenue::DOUBLE, gross_margin_pct,
         'Non-Perishable', total_non_perishable_cost::DOUBLE FROM fct_supply_cogs"""))
def _(spark, d):
    return reports.cost_breakdown(_cogs(spark, d))


@query("product_trends", with_ctes("""
  SELECT month, product_id, product_name, total_revenue::DOUBLE AS total_revenue, gross_margin_pct
  FROM fct_product_performance WHERE product_name IN (
    SELECT product_name FROM (SELECT product_name, row_number() OVER (ORDER BY month, product_id) AS r
                              FROM fct_product_performance) GROUP BY 1 ORDER BY min(r) LIMIT 5)"""))
def _(spark, d):
    return reports.product_trends(facts.product_performance(_sales(spark, d, monthly=True)))


@query("retention_heatmap", with_ctes("SELECT strftime(cohort_month, '%b %Y') AS cohort_label, " + ", ".join(
    f"max(CASE WHEN months_since_first_order = {i} THEN {rnd('retention_rate * 100', 1)} END) AS \"M{i}\""
    for i in range(12)) + " FROM fct_cohorts WHERE months_since_first_order <= 11 GROUP BY 1"))
def _(spark, d):
    return reports.retention_heatmap(_cohorts(spark, d))


@query("retention_curve", with_ctes(f"""
  SELECT months_since_first_order, count(*) AS cohorts_included,
         {div(f"sum({rnd('retention_rate * 100', 1)}::DECIMAL(6,1))", 'count(*)')} AS avg_retention
  FROM fct_cohorts WHERE months_since_first_order <= 11 GROUP BY 1"""))
def _(spark, d):
    return reports.retention_curve(_cohorts(spark, d))


@query("retention_summary", with_ctes(f"""
  SELECT months_since_first_order AS month_n, count(DISTINCT cohort_month) AS cohorts,
         {rnd(div("sum(retention_rate::DECIMAL(10,4))", 'count(*)') + ' * 100', 1)} AS avg_retention_pct
  FROM fct_cohorts WHERE months_since_first_order <= 6 GROUP BY 1"""))
def _(spark, d):
    return reports.retention_summary(_cohorts(spark, d))


def _buckets_sql(limits, top: str) -> str:
    cases = " ".join(f"WHEN lifetime_spend < {n} THEN '{label}'" for n, label in limits)
    return with_ctes(f"""
  SELECT ltv_bucket, customers, total_revenue::DOUBLE AS total_revenue,
         {even(div('total_revenue', 'sum(total_revenue) OVER ()') + ' * 100', 1)} AS revenue_pct
  FROM (SELECT CASE {cases} ELSE '{top}' END AS ltv_bucket, count(customer_id) AS customers,
               sum(lifetime_spend) AS total_revenue FROM m_customers WHERE lifetime_spend > 0 GROUP BY 1)""")


@query("ltv_buckets", _buckets_sql(reports.LTV_BUCKETS, reports.LTV_TOP_BUCKET))
def _(spark, d):
    return reports.ltv_buckets(_marts(spark, d)["customers"])


# Limits of the same order as the spend in the fixture tables, so that every bucket is used.
_WIDE_BUCKETS = [(1_000_000, "< 1M"), (2_000_000, "1-2M"), (3_000_000, "2-3M")]


@query("ltv_buckets_wide", _buckets_sql(_WIDE_BUCKETS, "> 3M"))
def _(spark, d):
    return reports.ltv_buckets(_marts(spark, d)["customers"], _WIDE_BUCKETS, "> 3M")


@query("ltv_distribution", with_ctes("""
  WITH v AS (SELECT lifetime_spend::DOUBLE AS x FROM m_customers WHERE lifetime_spend > 0),
  e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM v)
  SELECT least(floor((x - lo) / w), 49)::BIGINT AS bin, lo + w * least(floor((x - lo) / w), 49)::BIGINT AS bin_start,
         count(*) AS rows FROM v, e GROUP BY ALL"""))
def _(spark, d):
    return reports.ltv_distribution(_marts(spark, d)["customers"], 50)


@query("ltv_center", with_ctes(f"""SELECT {div('sum(lifetime_spend)', 'count(*)')} AS mean_spend,
    median(lifetime_spend::DOUBLE) AS median_spend FROM m_customers WHERE lifetime_spend > 0"""))
def _(spark, d):
    return reports.ltv_center(_marts(spark, d)["customers"])


_PARETO_SQL = f"""
  SELECT customer_id, lifetime_spend::DOUBLE AS lifetime_spend, spend_rank,
         {even(div('cum', 'total') + ' * 100', 1)} AS cum_revenue_pct,
         {even(div('spend_rank', 'n') + ' * 100', 1)} AS customer_pct
  FROM (SELECT customer_id, lifetime_spend, row_number() OVER o AS spend_rank, sum(lifetime_spend) OVER o AS cum,
               sum(lifetime_spend) OVER () AS total, count(*) OVER () AS n
        FROM m_customers WHERE lifetime_spend > 0
        WINDOW o AS (ORDER BY lifetime_spend DESC, customer_id ROWS UNBOUNDED PRECEDING))"""


@query("pareto_curve", with_ctes(_PARETO_SQL))
def _(spark, d):
    return reports.pareto_curve(_marts(spark, d)["customers"])


@query("pareto_at_20", with_ctes(
    f"SELECT max(cum_revenue_pct) AS cum_revenue_pct FROM ({_PARETO_SQL}) WHERE customer_pct <= 20"))
def _(spark, d):
    return reports.pareto_at(reports.pareto_curve(_marts(spark, d)["customers"]), 20)


_PAGE_ACTION = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.SEGMENT_PAGE_ACTIONS.items())
_RFM_SUMMARY_SQL = f"""
  SELECT rfm_segment, customers, total_revenue::DOUBLE AS total_revenue,
         {even(div('total_revenue', 'sum(total_revenue) OVER ()') + ' * 100', 1)} AS revenue_pct,
         {even(div('total_revenue', 'customers'))} AS avg_spend, avg_recency,
         CASE rfm_segment {_PAGE_ACTION} END AS action
  FROM (SELECT rfm_segment, count(*) AS customers, sum(monetary) AS total_revenue,
               {even(div('sum(recency_days)', 'count(recency_days)'))} AS avg_recency FROM rfm GROUP BY 1)"""


@query("rfm_summary", with_ctes(_RFM_SUMMARY_SQL))
def _(spark, d):
    return reports.rfm_summary(analyses.rfm_segments(_features(spark, d)))


@query("top_segments", with_ctes(f"""
  WITH s AS ({_RFM_SUMMARY_SQL})
  SELECT sum(customers)::BIGINT AS customers,
         {even(div('sum(customers)', '(SELECT sum(customers) FROM s)') + ' * 100')} AS customer_pct,
         sum(revenue_pct::DECIMAL(6,1))::DOUBLE AS revenue_pct
  FROM (SELECT * FROM s ORDER BY revenue_pct DESC, rfm_segment LIMIT 2)"""))
def _(spark, d):
    return reports.top_segments(reports.rfm_summary(analyses.rfm_segments(_features(spark, d))))


@query("order_frequency", with_ctes("""SELECT count_lifetime_orders AS n_orders, count(*) AS customers
    FROM m_customers WHERE count_lifetime_orders IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return reports.order_frequency(_marts(spark, d)["customers"])


@query("dataset_overview", with_ctes(f"""
  SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT order_id) AS orders,
         (SELECT count(*) FROM m_order_items) AS line_items, count(DISTINCT location_id) AS active_locations,
         min(ordered_at) AS first_order, max(ordered_at) AS last_order, sum(order_total)::DOUBLE AS total_revenue,
         {rnd(div('sum(order_total)', 'count(*)'), 2)} AS avg_order_value,
         {rnd(div('sum(order_total)', 'count(DISTINCT customer_id)'), 2)} AS avg_ltv FROM m_orders"""))
def _(spark, d):
    return reports.dataset_overview(_marts(spark, d)["orders"], _stg(spark, d)["stg_order_items"])


@query("customer_breakdown", with_ctes(f"""
  SELECT customer_type, count(*) AS customer_count, {rnd(div('sum(lifetime_spend)', 'count(*)'), 2)} AS avg_ltv,
         {rnd(div('sum(count_lifetime_orders)', 'count(*)'), 1)} AS avg_orders,
         sum(lifetime_spend)::DOUBLE AS total_revenue
  FROM m_customers WHERE count_lifetime_orders IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    return reports.customer_breakdown(_marts(spark, d)["customers"])


@query("churn_breakdown", with_ctes(f"""
  SELECT is_churned, count(*) AS customers, {rnd(div('sum(lifetime_spend)', 'count(*)'), 2)} AS avg_ltv,
         {rnd(div('sum(days_since_last_order)', 'count(*)'))} AS avg_days_since_order
  FROM fct_customer_churn_features GROUP BY 1"""))
def _(spark, d):
    return reports.churn_breakdown(_features(spark, d))


@query("location_monthly", with_ctes(f"""
  SELECT date_trunc('month', ordered_at) AS month, location_name, {_STATS},
         count(DISTINCT customer_id) AS customers,
         datediff('month', opened_date, date_trunc('month', ordered_at)) AS months_since_open
  FROM {SCOPED} GROUP BY 1, 2, opened_date"""))
def _(spark, d):
    m = _marts(spark, d)
    return reports.location_monthly(m["orders"], m["locations"])


@query("location_margins", with_ctes(f"""
  SELECT location_name, total_orders, {rnd('total_revenue')} AS revenue, {rnd('avg_order_value', 2)} AS aov,
         months_open, {rnd('revenue_per_month_open')} AS rev_per_month, margin_pct, revenue_rank
  FROM fct_location_performance JOIN (
    SELECT location_id, {rnd(div('total_gross_profit', 'total_revenue') + ' * 100', 1)} AS margin_pct
    FROM fct_location_performance) USING (location_id)"""))
def _(spark, d):
    return reports.location_margins(_locations_fact(spark, d))


@query("location_metrics_long", with_ctes(" UNION ALL ".join(
    f"SELECT location_name, '{label}' AS metric, {m}::DOUBLE AS value FROM fct_location_performance"
    for m, label in reports.LOCATION_METRICS.items())))
def _(spark, d):
    return reports.location_metrics_long(_locations_fact(spark, d))


@query("location_revenue_cost", with_ctes(" UNION ALL ".join(
    f"SELECT location_name, '{m}' AS variable, {m}::DOUBLE AS value FROM fct_location_performance"
    for m in ("total_revenue", "total_cost"))))
def _(spark, d):
    return reports.location_revenue_cost(_locations_fact(spark, d))


@query("location_radar", with_ctes("SELECT location_name, " + ", ".join(
    f"CASE WHEN max({m}) OVER () > min({m}) OVER () THEN ({m}::DOUBLE - min({m}::DOUBLE) OVER ()) / "
    f"(max({m}::DOUBLE) OVER () - min({m}::DOUBLE) OVER ()) ELSE 1.0 END AS {m}" for m in reports.RADAR_DIMS)
    + " FROM fct_location_performance"))
def _(spark, d):
    return reports.location_radar(_locations_fact(spark, d))


_RATIO_METRICS = ("total_revenue", "total_orders", "avg_order_value", "revenue_per_month_open")


@query("location_ratio_vs", with_ctes("SELECT a.location_name, " + ", ".join(
    even(f"({div(f'a.{m}', f'b.{m}')} - 1) * 100") + f" AS {m}_vs_base" for m in _RATIO_METRICS)
    + " FROM fct_location_performance a, fct_location_performance b WHERE b.location_name = 'NATION_3'"))
def _(spark, d):
    return reports.location_ratio_vs(_locations_fact(spark, d), "NATION_3", _RATIO_METRICS)


@query("share_of_total", with_ctes(f"""
  SELECT location_id, rows, {rnd('rows * 100.0::DOUBLE / sum(rows) OVER ()', 1)} AS pct
  FROM (SELECT location_id, count(*) AS rows FROM stg_orders GROUP BY 1)"""))
def _(spark, d):
    return aggregates.share_of_total(_stg(spark, d)["stg_orders"], ["location_id"])


@query("top_customers_by_spend", with_ctes("""SELECT customer_id, lifetime_spend::DOUBLE AS lifetime_spend
    FROM m_customers ORDER BY lifetime_spend DESC NULLS LAST, customer_id LIMIT 10"""))
def _(spark, d):
    return _marts(spark, d)["customers"].select("customer_id", "lifetime_spend").orderBy(
        F.col("lifetime_spend").desc_nulls_last(), "customer_id").limit(10)


@query("sample_rows_ordered", with_ctes("""SELECT order_id, customer_id, ordered_at FROM m_orders
    ORDER BY order_id LIMIT 20"""))
def _(spark, d):
    return reports.sample_rows(_marts(spark, d)["orders"], 20, ["order_id"]).select("order_id", "customer_id", "ordered_at")


query("sample_rows")(lambda spark, d: reports.sample_rows(_marts(spark, d)["orders"], 20))

# -- metrics ----------------------------------------------------------------------------------------------------------


@query("metric_orders_simple", with_ctes("""SELECT sum(order_total)::DOUBLE AS order_total, count(*) AS orders,
    sum(tax_paid)::DOUBLE AS tax_paid, sum(order_cost)::DOUBLE AS order_cost FROM m_orders"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["order_total", "orders", "tax_paid", "order_cost"])


@query("metric_orders_filtered", with_ctes("""SELECT location_name,
    count(*) FILTER (customer_order_number = 1) AS new_customer_orders,
    count(*) FILTER (order_total >= 20) AS large_orders, count(*) FILTER (is_food_order) AS food_orders,
    count(*) FILTER (is_drink_order) AS drink_orders FROM m_orders LEFT JOIN stg_locations USING (location_id)
    GROUP BY 1"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["new_customer_orders", "large_orders", "food_orders",
                                                   "drink_orders"], ["location_name"])


@query("metric_items", with_ctes(f"""SELECT date_trunc('month', ordered_at) AS metric_time, product_type,
    sum(product_price)::DOUBLE AS revenue,
    sum(CASE WHEN i.is_food_item THEN i.product_price ELSE 0 END)::DOUBLE AS food_revenue,
    sum(CASE WHEN i.is_drink_item THEN i.product_price ELSE 0 END)::DOUBLE AS drink_revenue,
    median(i.product_price::DOUBLE) AS median_revenue
    FROM m_order_items i LEFT JOIN (SELECT product_id, product_type FROM stg_products) USING (product_id)
    GROUP BY 1, 2"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["revenue", "food_revenue", "drink_revenue", "median_revenue"],
                                ["product_type"], "month")


@query("metric_ratios", with_ctes(f"""SELECT date_trunc('month', ordered_at) AS metric_time,
    {div('sum(CASE WHEN is_food_item THEN product_price ELSE 0 END)', 'sum(product_price)')} AS food_revenue_pct,
    {div('sum(CASE WHEN is_drink_item THEN product_price ELSE 0 END)', 'sum(product_price)')} AS drink_revenue_pct
    FROM m_order_items GROUP BY 1"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["food_revenue_pct", "drink_revenue_pct"], grain="month")


@query("metric_revenue_growth_mom", with_ctes(f"""
  WITH m AS (SELECT date_trunc('month', ordered_at) AS t, sum(product_price) AS r FROM m_order_items GROUP BY 1)
  SELECT m.t AS metric_time, m.r::DOUBLE AS current_revenue, p.r::DOUBLE AS revenue_prev_month,
         {div('(m.r - p.r) * 100', 'p.r')} AS revenue_growth_mom
  FROM m LEFT JOIN m p ON p.t = m.t - INTERVAL 1 MONTH"""))
def _(spark, d):
    return doubles(metrics.revenue_growth_mom(_revenue_marts(spark, d)))


@query("metric_revenue_growth_mom_daily", with_ctes(f"""
  WITH m AS (SELECT ordered_at AS t, sum(product_price) AS r FROM m_order_items GROUP BY 1)
  SELECT m.t AS metric_time, m.r::DOUBLE AS current_revenue, p.r::DOUBLE AS revenue_prev_month,
         {div('(m.r - p.r) * 100', 'p.r')} AS revenue_growth_mom
  FROM m LEFT JOIN m p ON p.t = m.t - INTERVAL 1 MONTH"""))
def _(spark, d):
    return metrics.revenue_growth_mom(_revenue_marts(spark, d), "day")


@query("metric_order_gross_profit", with_ctes("""
  SELECT coalesce(a.t, b.t) AS metric_time, r::DOUBLE AS revenue, c::DOUBLE AS order_cost,
         (r - c)::DOUBLE AS order_gross_profit
  FROM (SELECT ordered_at AS t, sum(product_price) AS r FROM m_order_items GROUP BY 1) a
  FULL JOIN (SELECT ordered_at AS t, sum(order_cost) AS c FROM m_orders GROUP BY 1) b ON a.t = b.t"""))
def _(spark, d):
    return metrics.order_gross_profit(_revenue_marts(spark, d))


@query("metric_cumulative_revenue", with_ctes("""
  WITH s AS (SELECT unnest(generate_series(min(ordered_at), max(ordered_at), INTERVAL 1 DAY)) AS t FROM m_order_items),
  r AS (SELECT ordered_at AS t, sum(product_price) AS v FROM m_order_items GROUP BY 1)
  SELECT s.t AS metric_time, (sum(v) OVER (ORDER BY s.t))::DOUBLE AS cumulative_revenue
  FROM s LEFT JOIN r ON r.t = s.t"""))
def _(spark, d):
    return metrics.cumulative_revenue(_revenue_marts(spark, d))


@query("metric_customers", with_ctes(f"""
  SELECT date_trunc('month', first_ordered_at) AS metric_time, customer_type,
         count(DISTINCT customer_id) AS customers, sum(count_lifetime_orders)::BIGINT AS count_lifetime_orders,
         sum(lifetime_spend_pretax)::DOUBLE AS lifetime_spend_pretax, sum(lifetime_spend)::DOUBLE AS lifetime_spend,
         {div('sum(lifetime_spend_pretax)', 'sum(count_lifetime_orders)')} AS average_order_value
  FROM m_customers GROUP BY 1, 2"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["customers", "count_lifetime_orders", "lifetime_spend_pretax",
                                                   "lifetime_spend", "average_order_value"],
                                ["customer_type"], "month")


@query("metric_locations", with_ctes("""SELECT date_trunc('quarter', opened_date) AS metric_time,
    avg(tax_rate) AS average_tax_rate FROM stg_locations GROUP BY 1"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["average_tax_rate"], grain="quarter")


@query("metric_across_marts", with_ctes("""
  SELECT coalesce(a.t, b.t) AS metric_time, r::DOUBLE AS revenue, n AS orders, m AS median_revenue
  FROM (SELECT date_trunc('week', ordered_at) AS t, sum(product_price) AS r, median(product_price::DOUBLE) AS m
        FROM m_order_items GROUP BY 1) a
  FULL JOIN (SELECT date_trunc('week', ordered_at) AS t, count(*) AS n FROM m_orders GROUP BY 1) b ON a.t = b.t"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["revenue", "orders", "median_revenue"], grain="week")


_ITEMS = "m_order_items JOIN m_orders o USING (order_id)"


@query("metric_revenue_by_location", with_ctes(f"""SELECT location_name, sum(product_price)::DOUBLE AS revenue
    FROM {_ITEMS} LEFT JOIN stg_locations USING (location_id) GROUP BY 1"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["revenue"], ["location_name"])


@query("metric_revenue_by_customer_type", with_ctes(f"""SELECT customer_type, date_trunc('quarter', o.ordered_at)
    AS metric_time, sum(product_price)::DOUBLE AS revenue, {div(
        'sum(CASE WHEN is_food_item THEN product_price ELSE 0 END)', 'sum(product_price)')} AS food_revenue_pct
    FROM {_ITEMS} LEFT JOIN m_customers USING (customer_id) GROUP BY 1, 2"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["revenue", "food_revenue_pct"], ["customer_type"], "quarter")


@query("metric_revenue_by_three", with_ctes(f"""SELECT product_type, location_name, is_food_order, customer_order_number,
    sum(product_price)::DOUBLE AS revenue FROM {_ITEMS} LEFT JOIN stg_locations USING (location_id)
    LEFT JOIN (SELECT product_id, product_type FROM stg_products) USING (product_id) GROUP BY 1, 2, 3, 4"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["revenue"],
                                ["product_type", "location_name", "is_food_order", "customer_order_number"])


@query("metric_median_by_customer_type", with_ctes(f"""SELECT customer_type, median(product_price::DOUBLE)
    AS median_revenue FROM {_ITEMS} LEFT JOIN m_customers USING (customer_id) GROUP BY 1"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["median_revenue"], ["customer_type"])


@query("metric_growth_by_product_type", with_ctes(f"""
  WITH m AS (SELECT product_type AS k, date_trunc('month', ordered_at) AS t, sum(product_price) AS r FROM m_order_items
             LEFT JOIN (SELECT product_id, product_type FROM stg_products) USING (product_id) GROUP BY 1, 2)
  SELECT m.k AS product_type, m.t AS metric_time, m.r::DOUBLE AS current_revenue, p.r::DOUBLE AS revenue_prev_month,
         {div('(m.r - p.r) * 100', 'p.r')} AS revenue_growth_mom
  FROM m LEFT JOIN m p ON p.t = m.t - INTERVAL 1 MONTH AND p.k IS NOT DISTINCT FROM m.k"""))
def _(spark, d):
    return metrics.revenue_growth_mom(_revenue_marts(spark, d), "month", ["product_type"])


@query("metric_gross_profit_by_location", with_ctes(f"""
  SELECT location_name, r::DOUBLE AS revenue, c::DOUBLE AS order_cost, (r - c)::DOUBLE AS order_gross_profit
  FROM (SELECT location_name, sum(product_price) AS r FROM {_ITEMS} LEFT JOIN stg_locations USING (location_id) GROUP BY 1)
  FULL JOIN (SELECT location_name, sum(order_cost) AS c FROM m_orders LEFT JOIN stg_locations USING (location_id)
             GROUP BY 1) USING (location_name)"""))
def _(spark, d):
    return metrics.order_gross_profit(_revenue_marts(spark, d), None, ["location_name"])


_RUNNING = """
  s AS (SELECT unnest(generate_series(min(ordered_at), max(ordered_at), INTERVAL 1 DAY)) AS t FROM m_order_items)"""


@query("metric_cumulative_monthly", with_ctes(f"""
  WITH {_RUNNING}, r AS (SELECT ordered_at AS t, sum(product_price) AS v FROM m_order_items GROUP BY 1)
  SELECT date_trunc('month', t) AS metric_time, max_by(c, t)::DOUBLE AS cumulative_revenue
  FROM (SELECT s.t, sum(v) OVER (ORDER BY s.t) AS c FROM s LEFT JOIN r ON r.t = s.t) GROUP BY 1"""))
def _(spark, d):
    return metrics.cumulative_revenue(_revenue_marts(spark, d), "month")


@query("metric_cumulative_by_type", with_ctes(f"""
  WITH {_RUNNING}, r AS (SELECT is_food_item AS k, ordered_at AS t, sum(product_price) AS v FROM m_order_items
                         WHERE ordered_at IS NOT NULL GROUP BY 1, 2)
  SELECT k AS is_food_item, s.t AS metric_time, (sum(v) OVER (PARTITION BY k ORDER BY s.t))::DOUBLE AS cumulative_revenue
  FROM (SELECT DISTINCT k FROM r) ks CROSS JOIN s LEFT JOIN r USING (k, t)"""))
def _(spark, d):
    return metrics.cumulative_revenue(_revenue_marts(spark, d), "day", ["is_food_item"])


@query("metric_filtered_where", with_ctes(f"""SELECT location_name, sum(product_price)::DOUBLE AS revenue
    FROM {_ITEMS} LEFT JOIN stg_locations USING (location_id) LEFT JOIN m_customers USING (customer_id)
    WHERE customer_type = 'returning' AND o.order_total >= 20 GROUP BY 1"""))
def _(spark, d):
    return metrics.metric_query(_revenue_marts(spark, d), ["revenue"], ["location_name"],
                                where="customer_type = 'returning' and order_total_dim >= 20")


@query("metric_dimension_values", with_ctes("""SELECT DISTINCT supply_name, is_perishable_supply,
    supply_cost::DOUBLE AS supply_cost FROM stg_supplies"""))
def _(spark, d):
    return metrics.dimension_values(_marts(spark, d), "supplies", ["supply_name", "is_perishable_supply", "supply_cost"])


@query("saved_order_metrics", ORACLES["export_order_metrics"])
def _(spark, d):
    return metrics.saved_query(_revenue_marts(spark, d), "order_metrics")


@query("saved_revenue_metrics", with_ctes("""SELECT ordered_at AS metric_time, sum(product_price)::DOUBLE AS revenue,
    sum(CASE WHEN is_food_item THEN product_price ELSE 0 END)::DOUBLE AS food_revenue,
    sum(CASE WHEN is_drink_item THEN product_price ELSE 0 END)::DOUBLE AS drink_revenue FROM m_order_items GROUP BY 1"""))
def _(spark, d):
    return metrics.saved_query(_revenue_marts(spark, d), "revenue_metrics")


@query("saved_customer_order_metrics", with_ctes(f"""SELECT customer_id, count_lifetime_orders,
    lifetime_spend_pretax::DOUBLE AS lifetime_spend_pretax,
    {div('lifetime_spend_pretax', 'count_lifetime_orders')} AS average_order_value FROM m_customers"""))
def _(spark, d):
    return metrics.saved_query(_revenue_marts(spark, d), "customer_order_metrics")


# -- data-quality checks ----------------------------------------------------------------------------------------------


@query("check_not_null", with_ctes("SELECT order_id, ordered_at FROM m_orders WHERE order_cost IS NULL"))
def _(spark, d):
    return checks.check_not_null(_marts(spark, d)["orders"], "order_cost").select("order_id", "ordered_at")


@query("check_unique", with_ctes("""SELECT order_item_id, count(*) AS n_rows FROM stg_order_items
    WHERE order_item_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""))
def _(spark, d):
    return checks.check_unique(_stg(spark, d)["stg_order_items"], "order_item_id")


@query("check_unique_customer_day", with_ctes("""SELECT customer_day, count(*) AS n_rows FROM (
    SELECT customer_id || '/' || strftime(ordered_at, '%Y-%m-%d') AS customer_day FROM stg_orders)
    GROUP BY 1 HAVING count(*) > 1"""))
def _(spark, d):
    day = F.concat_ws("/", F.col("customer_id").cast("string"), F.date_format("ordered_at", "yyyy-MM-dd"))
    return checks.check_unique(_stg(spark, d)["stg_orders"].select(day.alias("customer_day")), "customer_day")


@query("check_relationship", with_ctes("""SELECT order_id, count(*) AS n_rows FROM stg_orders
    WHERE order_id NOT IN (SELECT order_id FROM stg_order_items WHERE order_id IS NOT NULL) GROUP BY 1"""))
def _(spark, d):
    s = _stg(spark, d)
    return checks.check_relationship(s["stg_orders"], "order_id", s["stg_order_items"], "order_id")


@query("check_accepted", with_ctes("""SELECT product_id, product_type FROM stg_products
    WHERE product_type NOT IN ('jaffle', 'beverage')"""))
def _(spark, d):
    return checks.check_accepted(_stg(spark, d)["stg_products"], "product_type", ["jaffle", "beverage"]).select(
        "product_id", "product_type")


@query("check_expression", with_ctes("""SELECT order_id, order_items_subtotal::DOUBLE AS order_items_subtotal,
    subtotal::DOUBLE AS subtotal FROM m_orders WHERE NOT (order_items_subtotal = subtotal)"""))
def _(spark, d):
    return checks.check_expression(_marts(spark, d)["orders"], "order_items_subtotal = subtotal").select(
        "order_id", "order_items_subtotal", "subtotal")


_UNIQUE, _NOT_NULL = "unique", "not_null"
# The declared checks of every layer: (kind, column or expression, ...).
DECLARED_CHECKS: dict[str, list[tuple]] = {
    "stg_customers": [(_NOT_NULL, "customer_id"), (_UNIQUE, "customer_id")],
    "stg_locations": [(_NOT_NULL, "location_id"), (_UNIQUE, "location_id")],
    "stg_order_items": [(_NOT_NULL, "order_item_id"), (_UNIQUE, "order_item_id"), (_NOT_NULL, "order_id"),
                        ("relationship", "order_id", "stg_orders", "order_id")],
    "stg_orders": [("expression", "order_total - tax_paid = subtotal"), (_NOT_NULL, "order_id"),
                   (_UNIQUE, "order_id")],
    "stg_products": [(_NOT_NULL, "product_id"), (_UNIQUE, "product_id")],
    "stg_supplies": [(_NOT_NULL, "supply_uuid"), (_UNIQUE, "supply_uuid")],
    "customers": [("expression", "lifetime_spend_pretax + lifetime_tax_paid = lifetime_spend"),
                  (_NOT_NULL, "customer_id"), (_UNIQUE, "customer_id"),
                  ("accepted", "customer_type", ["new", "returning"])],
    "order_items": [(_NOT_NULL, "order_item_id"), (_UNIQUE, "order_item_id"),
                    ("relationship", "order_id", "orders", "order_id")],
    "orders": [("expression", "order_items_subtotal = subtotal"), ("expression", "order_total = subtotal + tax_paid"),
               (_NOT_NULL, "order_id"), (_UNIQUE, "order_id"),
               ("relationship", "customer_id", "stg_customers", "customer_id")],
    "fct_daily_revenue": [(_NOT_NULL, "date_day"), (_NOT_NULL, "location_id"), (_NOT_NULL, "total_revenue"),
                          (_NOT_NULL, "gross_profit"), ("expression", "gross_profit >= 0")],
    "fct_cohorts": [(_NOT_NULL, "cohort_month"), (_NOT_NULL, "months_since_first_order"),
                    ("expression", "months_since_first_order >= 0"), (_NOT_NULL, "retention_rate"),
                    ("expression", "retention_rate between 0 and 1")],
    "fct_customer_churn_features": [
        (_NOT_NULL, "customer_id"), (_UNIQUE, "customer_id"), (_NOT_NULL, "is_churned"),
        ("accepted", "is_churned", [True, False]), (_NOT_NULL, "days_since_last_order"),
        ("expression", "days_since_last_order >= 0")],
    "fct_product_performance": [(_NOT_NULL, "product_id"), (_NOT_NULL, "month"),
                                ("expression", "gross_margin_pct between -100 and 100")],
    "fct_location_performance": [(_NOT_NULL, "location_id"), (_UNIQUE, "location_id"),
                                 (_NOT_NULL, "revenue_per_month_open"), ("expression", "revenue_per_month_open > 0")],
    "fct_supply_cogs": [(_NOT_NULL, "product_id"), (_UNIQUE, "product_id"), (_NOT_NULL, "gross_margin_pct"),
                        ("expression", "gross_margin_pct between -100 and 100")],
}


def _check_sql(table: str, rule: tuple) -> str:
    relation = {"customers": "m_customers", "orders": "m_orders", "order_items": "m_order_items"}.get(table, table)
    kind, col = rule[0], rule[1]
    if kind == "not_null":
        n = f"SELECT count(*) FROM {relation} WHERE {col} IS NULL"
    elif kind == "unique":
        n = (f"SELECT count(*) FROM (SELECT {col} FROM {relation} WHERE {col} IS NOT NULL GROUP BY 1 "
             f"HAVING count(*) > 1)")
    elif kind == "relationship":
        parent = {"orders": "m_orders"}.get(rule[2], rule[2])
        n = f"SELECT count(*) FROM {relation} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {rule[3]} FROM {parent})"
    elif kind == "accepted":
        values = ", ".join(repr(v).lower() if isinstance(v, bool) else f"'{v}'" for v in rule[2])
        n = f"SELECT count(*) FROM {relation} WHERE {col} NOT IN ({values})"
    else:
        n = f"SELECT count(*) FROM {relation} WHERE NOT ({col})"
    return f"SELECT '{checks.rule_name(table, rule)}' AS check_name, ({n}) AS failures"


def _declared(tables: list[str]) -> dict[str, list[tuple]]:
    return {t: DECLARED_CHECKS[t] for t in tables}


def _checks_sql(tables: list[str]) -> str:
    return with_ctes("\nUNION ALL ".join(_check_sql(t, r) for t in tables for r in DECLARED_CHECKS[t]))


_LAYERS = {
    "staging": ["stg_customers", "stg_locations", "stg_order_items", "stg_orders", "stg_products", "stg_supplies"],
    "marts": ["customers", "order_items", "orders"],
    "facts": ["fct_daily_revenue", "fct_cohorts", "fct_customer_churn_features", "fct_product_performance",
              "fct_location_performance", "fct_supply_cogs"],
}


@query("run_checks_staging", _checks_sql(_LAYERS["staging"]))
def _(spark, d):
    return checks.run_checks(_stg(spark, d), _declared(_LAYERS["staging"]))


@query("run_checks_marts", _checks_sql(_LAYERS["marts"]))
def _(spark, d):
    s = _stg(spark, d)
    return checks.run_checks({**s, **marts.build_marts(s)}, _declared(_LAYERS["marts"]))


@query("run_checks_facts", _checks_sql(_LAYERS["facts"]))
def _(spark, d):
    rules = _declared(_LAYERS["facts"])
    built = facts.build_facts(layers.marts_stored_once(_stg(spark, d)))
    passes = {name: sum(r[0] not in checks.ROW_RULES for r in some) for name, some in rules.items()}
    return checks.run_checks({name: store(df) if passes[name] else df for name, df in built.items()}, rules)


# The expected rows of the raw tables.
EXPECTED_ROWS = {"raw_customers": 935, "raw_orders": 61948, "raw_items": 90900}


@query("row_counts", with_ctes("\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {r}) AS n_rows, {s} AS status" for t, r, s in [
        *[(t, t, "'OK'") for t in ("raw_products", "raw_stores", "raw_supplies",
                                   "stg_customers", "stg_orders", "stg_order_items", "stg_products", "stg_locations",
                                   "stg_supplies")],
        ("raw_orders", "raw_orders",
         "CASE WHEN (SELECT count(*) FROM raw_orders) = 61948 THEN 'OK' ELSE 'WARN (expected 61948)' END"),
        ("raw_customers", "raw_customers",
         "CASE WHEN (SELECT count(*) FROM raw_customers) = 935 THEN 'OK' ELSE 'WARN (expected 935)' END"),
        ("raw_items", "raw_items",
         "CASE WHEN (SELECT count(*) FROM raw_items) = 90900 THEN 'OK' ELSE 'WARN (expected 90900)' END"),
        *[(t, f"m_{t}", "'OK'") for t in ("customers", "orders", "order_items")],
        *[(t, f"stg_{t}", "'OK'") for t in ("products", "locations", "supplies")],
        *[(t, t, "'OK'") for t in FACT_SQL]])))
def _(spark, d):
    raw = fixture_tables(spark, d)
    m = layers.marts_stored_once(staging.stage_all(raw))
    return checks.row_counts({**raw, **staging.stage_all(raw), **m, **facts.build_facts(m)}, EXPECTED_ROWS)


# The same on stored layers.

@lru_cache(maxsize=2)
def _stored(spark: SparkSession, sf_dir: str) -> layers.Layers:
    return layers.store_layers(fixture_tables(spark, sf_dir), new_folder(spark, "layers"), DECLARED_CHECKS)


@query("stored_run_checks_facts", ORACLES["run_checks_facts"])
def _(spark, d):
    return checks.run_checks(_stored(spark, d), _declared(_LAYERS["facts"]))


@query("stored_run_checks_marts", ORACLES["run_checks_marts"])
def _(spark, d):
    return _stored(spark, d).checks(_declared(_LAYERS["marts"]), _stg(spark, d))


@query("stored_row_counts", ORACLES["row_counts"])
def _(spark, d):
    raw = fixture_tables(spark, d)
    return checks.row_counts({**raw, **staging.stage_all(raw), **_stored(spark, d)}, EXPECTED_ROWS)


@query("stored_revenue_trends", ORACLES["revenue_trends"])
def _(spark, d):
    return analyses.revenue_trends(_stored(spark, d)["orders"])


@query("stored_churn_features", ORACLES["fct_customer_churn_features"])
def _(spark, d):
    return layers.stored_churn_features(_stored(spark, d))


for _name in ("order_items", "orders", "customers"):
    query(f"stored_mart_{_name}", ORACLES[f"mart_{_name}"])(lambda spark, d, n=_name: _stored(spark, d)[n])


# Facts by month, first made while the orders of the last LATE_DAYS days had not come in yet.
LATE_DAYS = 45


@query("refreshed_fct_daily_revenue", ORACLES["fct_daily_revenue"])
def _(spark, d):
    m, folder = _marts(spark, d), new_folder(spark, "refreshed")
    orders = store(m["orders"])  # read for the cutoff, and twice for marks and for months
    early, _late = scopes.split_at_cutoff(orders, LATE_DAYS)
    layers.refresh_daily_revenue(early, m["locations"], folder)
    return layers.refresh_daily_revenue(orders, m["locations"], folder)


@query("refreshed_fct_product_performance", ORACLES["fct_product_performance"])
def _(spark, d):
    m, folder = _marts(spark, d), new_folder(spark, "refreshed")
    items = store(m["order_items"])  # read for the cutoff, and twice for marks and for months
    early, _late = scopes.split_at_cutoff(items, LATE_DAYS)
    layers.refresh_product_performance(early, folder)
    return layers.refresh_product_performance(items, folder)


models.register(query, _features, _marts)

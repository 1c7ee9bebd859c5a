"""Marts and facts written once, for later work to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import checks
from ..operators.scope import cutoff_date
from ..operators.partitions import partition_count, slices
from ..operators.shared_storage import store, store_sliced
from ..sources.buckets import Bucketed, align, aligned, bucket_count, heavy_keys, save_bucketed
from ..sources.versions import month_part, publish, refresh
from . import facts, marts
from .staging import stage_all


class Layers(dict):
    """Stored tables by name. ``parts`` holds the bucketed ones, and ``checks`` the rules counted while writing."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: dict[str, Bucketed] = {}
        self._watched: dict[str, checks.Watched] = {}

    def _keep(self, name: str, table: Bucketed) -> Bucketed:
        self.parts[name], self[name] = table, table.whole()
        return table

    def checks(self, rules: dict[str, Sequence[tuple]], others: dict[str, DataFrame]) -> DataFrame:
        """(check_name, failures) of the declared rules of the watched tables: row rules as counted while writing, the
        rules about more than one row from the stored tables and ``others``."""
        counted = [f for name in rules if name in self._watched for f in self._watched[name].failures()]
        seen = {name for name, _ in counted}
        rest = {t: [r for r in some if checks.rule_name(t, r) not in seen] for t, some in rules.items()}
        spark = next(iter(self.values())).sparkSession
        known = spark.createDataFrame(counted, "check_name string, failures bigint")
        return known.unionByName(checks.run_checks({**others, **self}, rest)) if any(rest.values()) else known

    def row_counts(self) -> dict[str, int]:
        """Rows of each watched table, as counted while writing."""
        return {name: w.n_rows() for name, w in self._watched.items()}


def store_layers(raw: dict[str, DataFrame], path: str, rules: dict[str, Sequence[tuple]] | None = None) -> Layers:
    """Staging to marts, then facts from the stored marts, as Parquet under ``path``; all of them read back.

    Items and orders are bucketed by order, then orders and customers by customer, so each is shuffled once for all joins,
    groupings and windows on these keys. Daily and monthly facts are written by month, and again only where their inputs
    changed. ``rules`` are the declared checks, of which row rules are counted while the tables are written.
    """
    stg, out = stage_all(raw), Layers()
    buckets = bucket_count(stg["stg_orders"].sparkSession)

    def watched(name: str, df: DataFrame) -> DataFrame:
        if not rules or name not in rules:
            return df
        return out._watched.setdefault(name, checks.Watched(name, rules[name])).watch(df)

    def bucketed(layer: str, name: str, parts: Bucketed, key: str, finish=lambda even: even, **how) -> Bucketed:
        return save_bucketed(Bucketed(parts.even, watched(name, parts.heavy)), key, f"{path}/{layer}/{name}", buckets,
                             finish=lambda even: watched(name, finish(even)), **how)

    for name in ("products", "locations", "supplies"):
        out[name] = publish(watched(name, stg[f"stg_{name}"]), f"{path}/marts/{name}")

    big = heavy_keys(stg["stg_order_items"], "order_id", buckets)
    orders = bucketed("staging", "stg_orders", align(stg["stg_orders"], "order_id", big), "order_id")
    # Heavy items come apart before prices join, so that the others are not priced a second time.
    priced = store(marts.product_dimension(out["products"], out["supplies"]), "product_dimension")
    items = aligned(lambda i: marts.price_items(i, priced), align(stg["stg_order_items"], "order_id", big))
    items = bucketed("marts", "order_items", Bucketed(items.even, marts.dated_items(items.heavy, orders.heavy)), "order_id",
                     lambda even: marts.dated_items(even, orders.even), sliced=True)
    out._keep("order_items", items)

    big = heavy_keys(stg["stg_orders"], "customer_id", buckets)
    summed = align(aligned(marts.join_item_summary, orders, items).whole(), "customer_id", big)
    within = W.partitionBy("customer_id").orderBy(F.asc_nulls_last("ordered_at"), F.asc_nulls_last("order_id"))
    number = F.row_number().over(within).cast("bigint")
    mart = bucketed("marts", "orders", Bucketed(summed.even, marts.number_customer_orders(summed.heavy)), "customer_id",
                    lambda even: even.withColumn("customer_order_number", number), sort_by=["ordered_at"])
    out._keep("orders", mart)
    people = bucketed("staging", "stg_customers", align(stg["stg_customers"], "customer_id", big), "customer_id")
    out._keep("customers", bucketed("marts", "customers", aligned(marts.customers, people, mart), "customer_id", placed=True))

    out["fct_daily_revenue"] = refresh_daily_revenue(out["orders"], out["locations"], f"{path}/facts/fct_daily_revenue")
    out["fct_product_performance"] = refresh_product_performance(out["order_items"], f"{path}/facts/fct_product_performance")
    built = facts.build_facts(out, [name for name in facts.FACTS if name not in out and name != "fct_customer_churn_features"])
    built["fct_customer_churn_features"] = stored_churn_features(out)
    for name, df in built.items():
        out[name] = publish(watched(name, df), f"{path}/facts/{name}")
    return out


def marts_stored_once(stg: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``marts.build_marts`` with the marts that need joins in storage, for work that reads them several times."""
    priced = store(marts.product_dimension(stg["stg_products"], stg["stg_supplies"]), "product_dimension")
    made = marts.build_marts(stg)
    orders = store(marts.orders(stg["stg_orders"], marts.price_items(stg["stg_order_items"], priced)), "orders")
    items = marts.order_items(stg["stg_order_items"], stg["stg_orders"], priced)
    by_order = slices("order_id", partition_count(orders.sparkSession))
    return {**made, "orders": orders, "order_items": store_sliced(items, "order_items", by_order),
            "customers": store(marts.customers(stg["stg_customers"], orders), "customers")}


def refresh_daily_revenue(orders: DataFrame, locations: DataFrame, target: str) -> DataFrame:
    """The daily fact stored by month; months whose orders, or whose orders' place in a customer's history, changed."""
    return refresh(orders, target, month_part("ordered_at"), lambda o: facts.daily_revenue(o, locations), month_part("date_day"),
                   [locations])


def refresh_product_performance(order_items: DataFrame, target: str) -> DataFrame:
    """The monthly product fact stored by month; months whose items changed."""
    dated = order_items.filter(F.col("ordered_at").isNotNull())
    return refresh(dated, target, month_part("ordered_at"), facts.product_performance, month_part("month"))


def stored_churn_features(stored: Layers, holdout_days: int = 30) -> DataFrame:
    """Churn features from the bucketed marts: no shuffle of orders or customers, but for those of heavy customers."""
    cutoff = cutoff_date(stored["orders"], holdout_days)
    return aligned(lambda c, o: facts.churn_features(c, o, holdout_days, cutoff), stored.parts["customers"], stored.parts["orders"]).whole()

"""Partitions in proportion to the input, and work that the marts and facts share."""

import datetime as dt
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tillmart.operators import ordered, partitions, shared_storage
from tillmart.plans import facts, layers, marts, staging
from tillmart.sources import buckets, fixture_tables, versions


@pytest.fixture
def restored(spark):
    kept = {key: spark.conf.get(key, None) for key in (partitions.INITIAL, partitions.SPLIT, partitions.ADVISORY)}
    yield
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shuffles_begin_with_partitions_in_proportion_to_the_input(spark, restored):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions.size_partitions(spark, 1)
    assert partitions.partition_count(spark) == least
    partitions.size_partitions(spark, 3 * least * partitions.PART_BYTES)
    assert partitions.partition_count(spark) == buckets.bucket_count(spark) == 3 * least
    ordered = spark.range(100).repartitionByRange("id")
    assert "rangepartitioning(id" in (plan := ordered._jdf.queryExecution().executedPlan().toString()) and f", {3 * least})" in plan
    assert int(spark.conf.get(partitions.SPLIT).removesuffix("b")) <= partitions.SPLIT_BYTES


def test_bytes_of_files_and_folders(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c").write_bytes(b"x" * 5)
    assert partitions.stored_bytes(spark, [f"{tmp_path}/{name}" for name in ("a", "b", "none")]) == 15


def test_marts_stored_once_equal_marts(spark):
    stg = staging.stage_all(fixture_tables(spark, SF))
    stored, made = layers.marts_stored_once(stg), marts.build_marts(stg)
    for name in ("orders", "order_items", "customers"):
        assert stored[name].dtypes == made[name].dtypes
        assert sorted(map(repr, stored[name].collect())) == sorted(map(repr, made[name].collect())), name
        plan = stored[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_layers_rank_products_once(spark, tmp_path, monkeypatch):
    built = []
    rank = facts.product_performance
    monkeypatch.setattr(facts, "product_performance", lambda items: built.append(1) or rank(items))
    out = layers.store_layers(fixture_tables(spark, SF), str(tmp_path))
    assert set(facts.FACTS) <= set(out) and len(built) == 1


def test_heavy_items_come_apart_before_prices_join(spark, tmp_path, monkeypatch):
    seen = []
    price = marts.price_items
    monkeypatch.setattr(marts, "price_items", lambda items, *a: seen.append(items) or price(items, *a))
    layers.store_layers(fixture_tables(spark, SF), str(tmp_path))
    even, heavy = seen
    assert heavy.count() == 0 and even.count() == staging.stage_all(fixture_tables(spark, SF))["stg_order_items"].filter(F.col("order_id").isNotNull()).count()


def shuffle_files(spark) -> set[str]:
    """Shuffle files on the disk of a local session."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in found.splitlines() if "/shuffle_" in name}


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path, no_broadcast):
    before, setting = shuffle_files(spark), spark.conf.get(shared_storage.CLEANUP)
    rows = spark.range(5000).select((F.col("id") % 700).alias("k"), "id")
    df = rows.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    heavy = buckets.heavy_keys(rows, "k", 4)
    kept = [shared_storage.store(df), versions.publish(df, f"{tmp_path}/a"), ordered.number_rows(df, [F.col("id")]),
            buckets.save_bucketed(buckets.align(df, "k", heavy), "k", f"{tmp_path}/b", 4).whole(),
            versions.refresh(df.withColumn("m", F.col("k") % 3), f"{tmp_path}/c", (F.col("k") % 3).cast("string"), lambda d: d,
                             F.col("m").cast("string"))]
    until = time.time() + 20  # files go in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(shared_storage.CLEANUP) == setting
    assert [t.count() for t in kept] == [5000] * 5


def test_tables_made_in_slices_are_whole(spark, tmp_path, monkeypatch):
    """Rows without a key, repeated keys, and a key with most rows; some buckets at a time."""
    rows = [(i, None if i % 7 == 0 else 5 if i % 2 else i % 60) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k int")
    whole = sorted(map(tuple, df.collect()), key=repr)
    monkeypatch.setattr(partitions, "SLICE", 3)
    cuts, made = partitions.slices("k", 8), []
    assert len(cuts) == 3 and len(partitions.slices("k", 3)) == 1
    stored = shared_storage.store_sliced(df, "sliced", cuts)
    assert sorted(map(tuple, stored.collect()), key=repr) == whole
    heavy = buckets.heavy_keys(df, "k", 8)
    saved = buckets.save_bucketed(buckets.align(df, "k", heavy), "k", str(tmp_path), 8, sliced=True,
                                  finish=lambda d: made.append(d.count()) or d)
    assert sorted(map(tuple, saved.whole().collect()), key=repr) == whole
    assert len(made) == 3 and max(made) < sum(made) == saved.even.count() == sum(k not in (None, 5) for _, k in rows)
    counted = saved.even.groupBy("k").count()  # still one file per bucket, read without an exchange
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.agg(F.sum("count")).first()[0] == sum(made)


def test_layers_in_slices_equal_marts_made_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partitions, "SLICE", 3)
    monkeypatch.setattr(versions, "BATCH_ROWS", 1000)
    stg = staging.stage_all(fixture_tables(spark, SF))
    made, once = marts.build_marts(stg), layers.marts_stored_once(stg)
    out = layers.store_layers(fixture_tables(spark, SF), str(tmp_path))
    for name in ("orders", "order_items", "customers"):
        wanted = sorted(map(repr, made[name].collect()))
        assert sorted(map(repr, once[name].collect())) == wanted, name
        assert sorted(map(repr, out[name].select(made[name].columns).collect())) == wanted, name
    wanted = sorted(map(repr, facts.product_performance(made["order_items"]).collect()))
    assert sorted(map(repr, out["fct_product_performance"].collect())) == wanted
    assert sorted(map(repr, facts.build_facts(once, ["fct_product_performance"])["fct_product_performance"].collect())) == wanted


def test_parts_with_many_inputs_are_made_some_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "BATCH_ROWS", 25)
    days = [dt.datetime(2024, 1 + i % 4, 1 + i % 20) for i in range(40)] + [dt.datetime(2024, 5, 1)] * 30 + [None] * 3
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, day timestamp").withColumn(
        "day", F.col("day").cast("timestamp_ntz"))
    built = []
    month = versions.month_part("day")
    got = versions.refresh(df, str(tmp_path), month, lambda d: built.append(d.count()) or d, month)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert built == [20, 20, 30, 3]
    versions.refresh(df, str(tmp_path), month, lambda d: built.append(d.count()) or d, month)
    assert built[4:] == [0]

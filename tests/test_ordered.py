"""Distributed windows against Spark's own one-task windows, on data where one value and one group are very common."""

import statistics

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillmart.operators import ordered


@pytest.fixture(scope="module", params=[False, True], ids=["spread", "one_partition"])
def skewed(spark, request):
    """20,000 rows; half share one group and a third share one value; some values and groups are NULL."""
    rows = spark.range(20000, numPartitions=6).select(
        "id", F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 97 == 0, None)
        .otherwise(F.pmod(F.hash("id"), F.lit(7))).alias("g"),
        F.when(F.pmod(F.hash("id", F.lit(1)), F.lit(3)) == 0, 500).when(F.col("id") % 41 == 0, None)
        .otherwise(F.pmod(F.hash("id", F.lit(2)), F.lit(1000))).cast("bigint").alias("v"))
    # Many partitions, so that groups and ties cross partition borders.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param).lower())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield rows.persist()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")


def same(a, b, key="id"):
    assert sorted(map(tuple, a.select(*sorted(a.columns)).collect()), key=repr) == sorted(
        map(tuple, b.select(*sorted(b.columns)).collect()), key=repr)


def order():
    return [F.col("v").desc_nulls_last(), F.col("id").asc()]


def test_partitions_are_used_and_balanced(skewed):
    parts = ordered._sorted(skewed, order()).groupBy("_part").count().collect()
    assert len(parts) == 1 or (len(parts) >= 6 and max(r["count"] for r in parts) < 20000 / 3)


def test_number_rows(skewed):
    got = ordered.number_rows(skewed, order(), "rn", total="n")
    want = skewed.withColumn("rn", F.row_number().over(W.orderBy(*order()))).withColumn("n", F.lit(20000))
    same(got, want)


def test_prefix_sum(skewed):
    filled = skewed.fillna(0, ["v"])
    got = ordered.prefix_sum(filled, order(), "v", "cum", total="all", position="rn", count="n")
    w = W.orderBy(*order())
    want = (filled.withColumn("cum", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("all", F.sum("v").over(W.partitionBy(F.lit(1)))).withColumn("rn", F.row_number().over(w))
            .withColumn("n", F.lit(20000)))
    same(got, want)


def test_number_rows_within(skewed):
    got = ordered.number_rows_within(skewed, ["g"], order(), "rn")
    same(got, skewed.withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy(*order()))))


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("descending", [True, False])
def test_rank_rows(skewed, by, descending):
    key = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    got = ordered.rank_rows(skewed, "v", "r", by, descending=descending, tie_break=["id"])
    same(got, skewed.withColumn("r", F.rank().over(W.partitionBy(*by).orderBy(key))))


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 1003])
def test_ntile(spark, n):
    df = spark.range(n).withColumn("v", F.pmod(F.hash("id"), F.lit(5)))
    got = ordered.ntile_rows(df, 5, order(), "t")
    same(got, df.withColumn("t", F.ntile(5).over(W.orderBy(*order()))))


def test_exact_quantiles(skewed):
    values = sorted(r.v for r in skewed.select("v").collect() if r.v is not None)
    row = ordered.exact_quantiles(skewed, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    quartiles = statistics.quantiles(values, n=4, method="inclusive")
    assert list(row) == [values[0], *quartiles, values[-1]]


def test_exact_medians_by_group(skewed):
    both = skewed.withColumn("w", F.col("v") * 2)
    got = {r.g: (r.v, r.w) for r in ordered.exact_medians(both, ["v", "w"], ["g"]).collect()}
    want = {}
    for g in got:
        vals = [r.v for r in skewed.filter(F.col("g").eqNullSafe(F.lit(g))).collect() if r.v is not None]
        want[g] = (statistics.median(vals), statistics.median(vals) * 2)
    assert got == want and len(got) == 8


def test_quantiles_of_values_in_any_order_of_size(spark):
    """Signs, both zeros, tiny and huge values, infinities, not-a-number, ties and nulls; weights; groups with a null key."""
    nan, inf = float("nan"), float("inf")
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, inf, -inf, 1.5, -1.5, 1.5, None, 2.0 ** 53, 3.0, -7.25, 0.1]
    rows = [(None if i % 5 == 4 else i % 5, odd[(i * 7 + i // 16) % 16], 1 + i % 3) for i in range(600)]
    rows += [(9, None, 1), (10, nan, 1), (10, 1.0, 2)]
    df = spark.createDataFrame(rows, "g int, v double, n int").repartition(5)
    probs = [0.0, 0.13, 0.5, 0.77, 1.0]
    got = {r["g"]: list(r)[1:] for r in ordered.exact_quantiles(df, ["v"], probs, ["g"], weight="n").collect()}
    wanted = {}
    for g in {r[0] for r in rows} - {9}:
        values = sorted((x for h, x, n in rows for _ in range(n) if h == g and x is not None), key=lambda x: (x != x, x))
        wanted[g] = []
        for p in probs:
            place = (len(values) - 1) * p
            lo, part = int(place), place - int(place)
            wanted[g].append(values[lo] * (1 - part) + values[lo + (part > 0)] * part)
    assert {g: [repr(x + 0.0) for x in row] for g, row in got.items()} == {
        g: [repr(x + 0.0) for x in row] for g, row in wanted.items()}


def test_quantiles_sort_nothing(spark):
    df = spark.range(3000).selectExpr("id % 7 AS g", "rand(1) AS v")
    plan = ordered.exact_medians(df, ["v"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert ordered.exact_medians(df.limit(0), ["v"], ["g"]).count() == 0
    assert ordered.exact_medians(df.limit(0), ["v"]).collect()[0][0] is None


def test_empty_input(spark):
    df = spark.createDataFrame([], "id bigint, g int, v bigint")
    assert ordered.rank_rows(df, "v", "r", ["g"], tie_break=["id"]).count() == 0
    assert ordered.number_rows(df, order(), "rn").count() == 0


def test_runs_across_partitions_with_values_that_compare_oddly(spark):
    """Nulls, not-a-number and both zeros are equal to themselves, in groups and values that span partitions and batches."""
    nan = float("nan")
    rows = [(i, [None, nan, 0.0, -0.0, 1.0][i % 5] if i % 3 else 7.0, [None, nan, 0.0, -0.0, 2.0, 2.0, 2.0][i % 7]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, g double, v double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        ranked = ordered.rank_rows(df, "v", "r", ["g"], tie_break=["id"])
        numbered = ordered.number_rows_within(ranked, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], "n")
        window = W.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
        wanted = numbered.withColumn("r2", F.rank().over(window)).withColumn("n2", F.row_number().over(window.orderBy(
            F.col("v").desc_nulls_last(), "id")))
        assert wanted.count() == 4000 and wanted.filter("r <> r2 OR n <> n2").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_range_exchange_per_rank(spark):
    df = spark.range(2000).selectExpr("id", "id % 3 AS g", "id % 50 AS v")
    ranked = ordered.rank_rows(df, "v", "r", ["g"], tie_break=["id"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()  # from the stored rows on
    assert plan.count("Exchange") == plan.count("BroadcastExchange") and "Window" not in plan


def test_a_run_goes_on_through_whole_partitions():
    """Partitions of one run only, between others: the carry adds up."""
    scan = ordered._run_starts([["g"], ["g", "v"]])
    batches = [pa.RecordBatch.from_pydict({"g": [1, 1], "v": [5, 5]}), pa.RecordBatch.from_pydict({"g": [], "v": []}, schema=pa.schema(
        [("g", pa.int64()), ("v", pa.int64())])), pa.RecordBatch.from_pydict({"g": [1, 2, 2], "v": [4, 4, 4]})]
    out = pa.Table.from_batches(list(scan(iter(batches)))).to_pydict()
    assert out["_s0"] == [0, 0, 0, 3, 3] and out["_s1"] == [0, 0, 2, 3, 3]

"""Distinct counts by bitmaps against Spark's own."""

import random

from pyspark.sql import functions as F

from tillmart.operators import distinct


def rows(spark):
    rng = random.Random(8)
    ids = [None, 0, -1, 1, -32768, -32769, 32768, 32769, 2 ** 62, -(2 ** 62), *range(100, 160)]
    data = [(rng.choice([None, "a", "b", "b", "b"]), rng.choice(ids), rng.choice(ids[:9]), rng.choice([None, "", "x", "y"]),
             f"2024-0{rng.randrange(1, 4)}-{rng.randrange(1, 28):02d}") for _ in range(3000)]
    data.append(("lone", None, None, None, "2024-01-01"))
    return spark.createDataFrame(data, "g string, k long, m long, t string, d string").withColumn("day", F.col("d").cast("date"))


def table(df):
    return sorted(map(repr, df.collect()))


def test_counts_equal_count_distinct(spark):
    df = rows(spark)
    got = distinct.distinct_counts(df, ["g"], ["k", "m", "t"])
    want = df.groupBy("g").agg(*[F.countDistinct(c).alias(c) for c in ("k", "m", "t")])
    assert table(got) == table(want)
    assert distinct.distinct_counts(df.limit(0), ["g"], ["k", "t"]).count() == 0


def test_days_merge_to_months(spark):
    df = rows(spark)
    days = distinct.distinct_states(df, ["g", "day"], ["k", "m"])
    months = distinct.merge_states(days, g=F.col("g"), month=F.trunc("day", "month"))
    want = df.groupBy("g", F.trunc("day", "month").alias("month")).agg(F.countDistinct("k").alias("k"), F.countDistinct("m").alias("m"))
    assert table(distinct.state_counts(months, ["g", "month"], ["k", "m"])) == table(want.filter("k + m > 0"))
    all_of_them = distinct.state_counts(distinct.merge_states(days), [], ["k", "m"])
    assert table(all_of_them) == table(df.agg(F.countDistinct("k").alias("k"), F.countDistinct("m").alias("m")))


def test_no_expand_and_bitmaps_before_the_exchange(spark):
    df = spark.range(100_000).selectExpr("CAST(id % 3 AS int) AS g", "id AS k", "id % 7 AS m")
    states = distinct.distinct_states(df, ["g"], ["k", "m"])
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1
    assert plan.index("partial_bitmap_construct_agg") > plan.index("Exchange")  # below it in the plan
    assert states.count() == (5 + 4 + 4) + 3 * 2  # ranges of ids, not ids; 0 is a range of its own


def test_one_group_with_a_third_of_all_rows(spark):
    df = spark.range(200_000).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 1000)) AS g", "id % 50000 AS k")
    want = df.groupBy("g").agg(F.countDistinct("k").alias("k"))
    assert table(distinct.distinct_counts(df, ["g"], ["k"])) == table(want)

"""Exact distinct counts that merge: bitmaps over whole-number ids.

``countDistinct`` over several columns copies every row per column and moves every distinct value; and counts of days do not
add up to those of a week. Here a state holds one bitmap per group, column and range of 32,768 ids; days merge to weeks and
months by OR, and a count is the number of bits. Bitmaps are made before anything moves, so what moves grows with the ranges
of ids a group has, not with its rows; a group with a third of all rows is as many rows as its ids have ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = ("tinyint", "smallint", "int", "bigint")


def distinct_states(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, _value, _range, _bits): one row per group, column and range of ids with an id in it. Nulls are no ids."""
    one = F.explode(F.array(*[F.struct(F.lit(v).alias("_value"), F.col(v).cast("bigint").alias("_id")) for v in values]))
    ids = df.select(*by, one.alias("_one")).select(*by, "_one.*").filter(F.col("_id").isNotNull())
    return ids.groupBy(*by, "_value", F.bitmap_bucket_number("_id").alias("_range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("_bits"))


def merge_states(states: DataFrame, **by: Column) -> DataFrame:
    """States of coarser groups: ``by`` names their columns, from those of the finer ones."""
    return states.groupBy(*[c.alias(name) for name, c in by.items()], "_value", "_range").agg(
        F.bitmap_or_agg("_bits").alias("_bits"))


def state_counts(states: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per group that has an id, with the number of distinct ids of each column under the column's name."""
    return states.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("_value") == v, F.bitmap_count("_bits"))), F.lit(0)).alias(v)
                                     for v in values])


def distinct_counts(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per group, null groups too, with exact distinct counts of ``values`` under their names: whole-number columns by
    bitmaps, columns of other types by their distinct values."""
    kinds = dict(df.dtypes)
    whole = [v for v in values if kinds[v] in WHOLE]
    groups = df.select(*by).distinct()
    sides = [state_counts(distinct_states(df, by, whole), by, whole)] if whole else []
    sides += [df.select(*by, v).filter(F.col(v).isNotNull()).distinct().groupBy(*by).agg(F.count("*").alias(v))
              for v in values if v not in whole]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(*[F.col(b).alias(f"_{b}") for b in by], *[c for c in right.columns if c not in by])
        same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True))
        return left.join(other, same, "left").drop(*[f"_{b}" for b in by])

    return reduce(joined, sides, groups).select(*by, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])

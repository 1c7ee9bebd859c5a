"""Windows over a whole relation without a one-task sort.

``Window.orderBy`` without ``partitionBy`` sends every row to one task, and ``Window.partitionBy(group)`` sends one
group to one task. The operators here range-partition on the sort key instead, number rows inside each partition, and
add what the earlier partitions hold: one number per partition. Every sort key ends in a unique tie-break, so a
value shared by many rows is still cut into several partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..deploy import ship
from .shared_storage import new_folder, write_parquet

ROW_BITS = 33  # monotonically_increasing_id: partition number above 33 bits of row position
DIGIT_BITS = 16  # of the 64 that a selection counts in each pass


def _sorted(df: DataFrame, order: Sequence[Column], runs: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Range-sort and store the rows with their partition number and position; for each of ``runs``, columns that lead the
    order, ``_s0``, ``_s1``, ... tell the position at which the row's run of equal values began in the partition.

    Stored because the partition bounds are sampled: both passes below must see the same ones. Stored as Parquet, so a
    pass reads only the columns it needs.
    """
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if runs:
        ship(df.sparkSession)
        starts = StructType(list(df.schema.fields))
        for i in range(len(runs)):
            starts = starts.add(f"_s{i}", "long")
        ranged = ranged.mapInArrow(_run_starts(runs), starts)
    numbered = ranged.withColumn("_row", row)
    numbered = (numbered.withColumn("_part", F.shiftright("_row", ROW_BITS))
                .withColumn("_pos", F.col("_row").bitwiseAND((1 << ROW_BITS) - 1)).drop("_row"))
    folder = new_folder(df.sparkSession, "sorted")
    write_parquet(numbered, folder)
    return df.sparkSession.read.schema(numbered.schema).parquet(folder)


def _unlike(now: pa.Array, before: pa.Array) -> np.ndarray:
    """Where two columns differ; null equals null, and not-a-number itself."""
    same = pc.fill_null(pc.equal(now, before), False)
    same = pc.or_(same, pc.and_(pc.is_null(now), pc.is_null(before)))
    if pa.types.is_floating(now.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(before)), False))
    return ~same.to_numpy(zero_copy_only=False)


def _run_starts(runs: Sequence[Sequence[str]]) -> Callable:
    """Adds the starts of runs to the batches of one sorted partition; between batches only the last row is kept."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, begun = None, 0, [0] * len(runs)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            out = list(batch.columns)
            for i, columns in enumerate(runs):
                new = np.zeros(n, bool)
                new[0] = last is None
                for name in columns:
                    now = batch.column(name)
                    first = now.slice(0, 1) if last is None else last.column(name)
                    new |= _unlike(now, pa.concat_arrays([first, now.slice(0, n - 1)]))
                starts = np.maximum.accumulate(np.where(new, at + np.arange(n), begun[i]))
                begun[i] = int(starts[-1])
                out.append(pa.array(starts, pa.int64()))
            last, at = batch.slice(n - 1, 1), at + n
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *[f"_s{i}" for i in range(len(runs))]])

    return scan


def _with_carries(rows: DataFrame, runs: Sequence[Sequence[str]]) -> DataFrame:
    """``rows`` of ``_sorted`` with ``_c0``, ``_c1``, ...: the rows in earlier partitions of the run that the partition
    begins with. Only rows whose run starts at 0 belong to it. The driver sees one row per partition."""
    ends = []
    for i, columns in enumerate(runs):
        key = F.struct(F.lit(0).alias("_none"), *columns)
        ends += [F.min_by(key, "_pos").alias(f"_first{i}"), F.max_by(key, "_pos").alias(f"_last{i}"),
                 F.max_by(f"_s{i}", "_pos").alias(f"_start{i}")]
    found = rows.groupBy("_part").agg((F.max("_pos") + 1).alias("_n"), *ends).collect()
    carries, open_ = [], [(None, 0)] * len(runs)
    for part in sorted(found, key=lambda r: r["_part"]):
        carry = []
        for i in range(len(runs)):
            first, last = _comparable(part[f"_first{i}"]), _comparable(part[f"_last{i}"])
            carry.append(open_[i][1] if open_[i][0] == first else 0)
            begun = carry[-1] if part[f"_start{i}"] == 0 else 0
            open_[i] = (last, begun + part["_n"] - part[f"_start{i}"])
        carries.append((part["_part"], *carry))
    names = "_part long" + "".join(f", _c{i} long" for i in range(len(runs)))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(carries, names)), "_part")  # one row per partition


def _comparable(key) -> str:
    """Equal for values that sort as equal: 0.0 and -0.0, or two that are no numbers."""
    return repr(tuple(x + 0.0 if isinstance(x, float) else x for x in key))


def _with_earlier(rows: DataFrame, weight: Column) -> DataFrame:
    """Add ``_before`` (weight in earlier partitions) and ``_all`` (total weight)."""
    per_part = rows.groupBy("_part").agg(F.sum(weight).alias("_w"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    whole = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier = per_part.select("_part", F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_before"),
                              F.sum("_w").over(whole).alias("_all"))
    return rows.join(F.broadcast(earlier), "_part")


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_number", total: str | None = None
                ) -> DataFrame:
    """``row_number() over (order by ...)``; ``total`` also adds the row count. ``order`` must be unique."""
    rows = _with_earlier(_sorted(df, order), F.lit(1))
    out = rows.withColumn(name, (F.col("_before") + F.col("_pos") + 1).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_all").cast("bigint"))
    return out.drop("_part", "_pos", "_before", "_all")


def prefix_sum(df: DataFrame, order: Sequence[Column], value: str, name: str, total: str | None = None,
               position: str | None = None, count: str | None = None) -> DataFrame:
    """``sum(value) over (order by ... rows unbounded preceding)``, optionally with the grand total, the row number
    and the row count."""
    rows = _with_earlier(_sorted(df, order), F.col(value))
    inside = W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn(name, F.col("_before") + F.sum(value).over(inside))
    if total:
        out = out.withColumn(total, F.col("_all"))
    out = out.drop("_before", "_all")
    if position or count:
        out = _with_earlier(out, F.lit(1))
        if position:
            out = out.withColumn(position, (F.col("_before") + F.col("_pos") + 1).cast("bigint"))
        if count:
            out = out.withColumn(count, F.col("_all").cast("bigint"))
        out = out.drop("_before", "_all")
    return out.drop("_part", "_pos")


def number_rows_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "row_number"
                       ) -> DataFrame:
    """``row_number() over (partition by ... order by ...)`` for groups of any size. ``order`` must be unique.

    A row's place in its group's run in the partition goes on from the group's rows in earlier partitions.
    """
    runs = [list(by)]
    rows = _with_carries(_sorted(df, [F.col(b).asc_nulls_last() for b in by] + list(order), runs), runs)
    number = F.col("_pos") - F.col("_s0") + 1 + F.when(F.col("_s0") == 0, F.col("_c0")).otherwise(0)
    return rows.withColumn(name, number.cast("bigint")).select(*df.columns, name)


def rank_rows(df: DataFrame, value: str, name: str, by: Sequence[str] = (), *, descending: bool = True,
              tie_break: Sequence[str]) -> DataFrame:
    """``rank() over (partition by ... order by value)``, NULL values last, for groups of any size.

    The rank is the place of the row's first equal in its group. Rows of the partition's first group add the group's rows in
    earlier partitions, except those that tie with them: these can only tie with the partition's first value.
    """
    key = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    order = [F.col(b).asc_nulls_last() for b in by] + [key] + [F.col(t).asc_nulls_last() for t in tie_break]
    runs = [list(by), [*by, value]]
    rows = _with_carries(_sorted(df, order, runs), runs)
    earlier = F.col("_c0") - F.when(F.col("_s1") == 0, F.col("_c1")).otherwise(0)
    rank = F.col("_s1") - F.col("_s0") + 1 + F.when(F.col("_s0") == 0, earlier).otherwise(0)
    return rows.withColumn(name, rank.cast("bigint")).select(*df.columns, name)


def ntile_rows(df: DataFrame, tiles: int, order: Sequence[Column], name: str) -> DataFrame:
    """``ntile(tiles) over (order by ...)``: the first ``n mod tiles`` tiles hold one row more. ``order`` is unique."""
    numbered = number_rows(df, order, "_r", total="_total")
    small = F.expr(f"_total div {tiles}")
    larger = F.col("_total") % tiles
    in_larger = larger * (small + 1)
    tile = F.when(F.col("_r") <= in_larger, F.floor((F.col("_r") - 1) / (small + 1)) + 1).otherwise(
        larger + F.floor((F.col("_r") - 1 - in_larger) / F.greatest(small, F.lit(1))) + 1)
    return numbered.withColumn(name, tile.cast("bigint")).drop("_r", "_total")


@F.pandas_udf(LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    """Whole numbers that sort as the doubles do: 0.0 and -0.0 are one, not-a-number comes last."""
    numbers = values.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(numbers), np.nan, numbers).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))


def exact_quantiles(df: DataFrame, values: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                    weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: columns ``<value>_q<i>``, one row per group of ``by``.

    ``weight`` names a column that tells how often the row's values occur.

    Selection by counting: every value becomes a whole number of 64 bits in the same order. A pass counts the rows by the
    next ``DIGIT_BITS`` of it, among those that share the digits found so far, and the running counts tell the next digit
    of each wanted place. Nothing is sorted or stored but the counts, at most 2^``DIGIT_BITS`` for each group, value column
    and prefix, so neither a frequent value nor a large group reaches one task. All passes are one query over ``df``, whose
    last exchange they share.
    """
    ship(df.sparkSession)
    times = F.lit(1) if weight is None else F.col(weight)
    long = df.select(times.alias("_times"), *by, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_which"), F.col(v).cast("double").alias("_value")) for i, v in enumerate(values)
    ])).alias("_s")).filter("_s._value is not null")
    long = long.select(F.struct(*by, "_s._which").alias("_group"), "_times", F.col("_s._value").alias("_value"))
    long = long.withColumn("_bits", _ordered_bits("_value"))

    found = None  # rows (group, prefix, places): the wanted places of the group among the values with this prefix
    for left in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        if found is None:
            rows, keys = long.withColumn("_prefix", F.lit(0).cast("long")), ["_group", "_prefix"]
        else:
            found = found.drop("_value")
            rows = long.withColumn("_prefix", F.shiftright("_bits", left + DIGIT_BITS)).join(
                found if by else F.broadcast(found), ["_group", "_prefix"])  # without groups: two rows a quantile at most
            keys = ["_group", "_prefix", "_places"]  # the places follow from the rest, and need no second join this way
        counts = rows.groupBy(*keys, F.shiftright("_bits", left).alias("_next")).agg(
            F.sum("_times").alias("_count"), F.max("_value").alias("_value"))
        inside = W.partitionBy("_group", "_prefix")  # one row per digit
        running = counts.withColumn("_to", F.sum("_count").over(inside.orderBy("_next")))
        if found is None:
            running = running.withColumn("_places", _places(F.sum("_count").over(inside), probs))
        here = F.filter("_places", lambda p: (p["rank"] <= F.col("_to")) & (p["rank"] > F.col("_to") - F.col("_count")))
        found = running.select("_group", F.col("_next").alias("_prefix"), "_value", F.transform(here, lambda p: F.struct(
            p["j"].alias("j"), (p["rank"] - F.col("_to") + F.col("_count")).alias("rank"), p["part"].alias("part"),
            p["upper"].alias("upper"))).alias("_places")).filter(F.size("_places") > 0)

    picked = found.select("_group", "_value", F.explode("_places").alias("_p")).select("_group.*", "_value", "_p.*")

    def pick(i: int, j: int, what: Column, upper: bool) -> Column:
        return F.max(F.when((F.col("_which") == i) & (F.col("j") == j) & (F.col("upper") == upper), what))

    result = [(pick(i, j, F.col("_value") * (1 - F.col("part")), False) + pick(i, j, F.col("_value") * F.col("part"), True)
               ).alias(f"{v}_q{j}") for i, v in enumerate(values) for j in range(len(probs))]
    return picked.groupBy(*by).agg(*result)


def _places(size: Column, probs: Sequence[float]) -> Column:
    """The ranks on both sides of each quantile among ``size`` rows, and how far it lies towards the upper one."""
    out = []
    for j, p in enumerate(probs):
        place = (size - 1) * F.lit(float(p))
        for upper, rank in [(False, F.floor(place)), (True, F.ceil(place))]:
            out.append(F.struct(F.lit(j).alias("j"), (rank + 1).cast("long").alias("rank"),
                                (place - F.floor(place)).alias("part"), F.lit(upper).alias("upper")))
    return F.array(*out)


def exact_medians(df: DataFrame, values: Sequence[str], by: Sequence[str] = (), weight: str | None = None
                  ) -> DataFrame:
    """Exact medians of several numeric columns under their own names, one row per group of ``by``."""
    return exact_quantiles(df, values, [0.5], by, weight).select(*by, *[F.col(f"{v}_q0").alias(v) for v in values])

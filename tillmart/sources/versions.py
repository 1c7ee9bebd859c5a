"""Stored tables in versions: a run that breaks off leaves the version before it, and only changed parts are written.

A table is a folder with data folders, which never change once written, and a list of versions: which part (a month, say)
lies in which data folder, with a mark of what it was made from. A run writes data first and then adds its version to the
list as one file, so readers see the old version or the new one. One writer at a time. Data folders that no version in
use names may be removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.shared_storage import COMPRESSION, shuffles_released, write_parquet

VERSIONS = "version bigint, part string, folder string, mark string"
WHOLE, UNDATED = "all", "none"
BATCH_ROWS = 1 << 25  # of inputs to the parts that are made at a time


def month_part(ts: str) -> Column:
    """The part of a row by its month."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(UNDATED))


def _versions(spark: SparkSession, target: str) -> list:
    """The parts of the newest version: one row per part, and parts are few (months)."""
    listed = spark.read.schema(VERSIONS).parquet(f"{target}/versions")
    with shuffles_released(spark):
        newest = listed.agg(F.max("version").alias("_newest")).scalar()
        return listed.filter(F.col("version") == newest).collect()


def _exists(spark: SparkSession, target: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/versions")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def current(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The newest version of the table."""
    folders = [r["folder"] for r in _versions(spark, target) if r["folder"]]
    return spark.read.schema(schema).parquet(*folders).select(*schema.names) if folders else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, target: str, version: int, parts: dict[str, tuple[str, str]]) -> None:
    rows = [(version, part, folder, mark) for part, (folder, mark) in parts.items()]
    spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{target}/versions")


def publish(df: DataFrame, target: str) -> DataFrame:
    """Write ``df`` whole as the newest version and return it read back."""
    spark, folder = df.sparkSession, f"{target}/data-{uuid.uuid4().hex}"
    write_parquet(df, folder)
    last = max((r["version"] for r in _versions(spark, target)), default=0) if _exists(spark, target) else 0
    _commit(spark, target, last + 1, {WHOLE: (folder, "")})
    return current(spark, target, df.schema)


def marks(rows: DataFrame, part: Column, columns: Sequence[str]) -> dict[str, str]:
    """A mark of each part's rows, whatever their order: their number and sums of two hashes. One pass, one row per part."""
    def total(*extra: Column) -> Column:
        return F.sum(F.xxhash64(*[F.col(c) for c in columns], *extra).cast("decimal(38,0)"))

    with shuffles_released(rows.sparkSession):
        found = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), total().alias("a"), total(F.lit(1)).alias("b"))
        return {r["_part"]: f"{r['n']}:{r['a']}:{r['b']}" for r in found.collect()}


def _batches(changed: dict[str, str]) -> list[list[str]]:
    """Parts, given with their marks, with about ``BATCH_ROWS`` inputs together: so much is shuffled before the disk has it back.
    One batch without parts where nothing changed."""
    out, rows = [[]], 0
    for name in sorted(changed):
        n = int(changed[name].split(":")[0])
        if out[-1] and rows + n > BATCH_ROWS:
            out, rows = [*out, []], 0
        out[-1].append(name)
        rows += n
    return out


def refresh(inputs: DataFrame, target: str, part: Column, build: Callable[[DataFrame], DataFrame], built_part: Column,
            others: Sequence[DataFrame] = ()) -> DataFrame:
    """``build(inputs)`` as a stored table in which only parts with changed inputs are computed and written.

    ``part`` tells the part of an input row, ``built_part`` that of a row built from it: a part is built from its own inputs
    and from ``others`` alone, and a change of those changes every part. Parts with many inputs are made some at a time.
    """
    spark = inputs.sparkSession
    beside = "".join(f"/{m}" for o in others for m in marks(o, F.lit(WHOLE), o.columns).values())
    wanted = {p: m + beside for p, m in marks(inputs, part, inputs.columns).items()}
    old = {r["part"]: r for r in _versions(spark, target)} if _exists(spark, target) else {}
    changed = [p for p, m in wanted.items() if p not in old or old[p]["mark"] != m]
    written: dict[str, str] = {}
    for batch in _batches({p: wanted[p] for p in changed}):
        out = build(inputs.filter(part.isin(batch)))
        if not batch:
            break
        folder = f"{target}/data-{uuid.uuid4().hex}"
        # Tasks of even size, whatever the size of a month.
        with shuffles_released(spark):
            out.withColumn("_part", built_part).hint("rebalance", "_part").write.partitionBy("_part").parquet(
                folder, compression=COMPRESSION)
            stored = spark.read.schema(StructType(out.schema.fields).add("_part", "string")).parquet(folder)
            written |= {r["_part"]: f"{folder}/_part={r['_part']}" for r in stored.select("_part").distinct().collect()}
    if not changed and set(old) == set(wanted) and old:
        return current(spark, target, out.schema)
    last = max((r["version"] for r in old.values()), default=0)
    _commit(spark, target, last + 1, {p: (written.get(p, "") if p in changed else old[p]["folder"], m) for p, m in wanted.items()})
    return current(spark, target, out.schema)

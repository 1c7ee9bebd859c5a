"""Raw CSV tables with declared schemas (no inference pass over the files)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..operators.shared_storage import materialize

BAD_LINE = "_bad_line"

# The raw column names and order.
RAW_SCHEMAS = {
    "raw_customers": "id string, name string",
    "raw_orders": "id string, customer string, ordered_at timestamp_ntz, store_id string, subtotal bigint, "
                  "tax_paid bigint, order_total bigint",
    "raw_items": "id string, order_id string, sku string",
    "raw_products": "sku string, name string, type string, price bigint, description string",
    "raw_stores": "id string, name string, opened_at timestamp_ntz, tax_rate double",
    "raw_supplies": "id string, name string, cost bigint, perishable boolean, sku string",
}

# Raw product types that count as food and as drink.
FOOD_TYPE = "jaffle"
DRINK_TYPE = "beverage"


def _reader(spark: SparkSession, schema: str, mode: str) -> DataFrameReader:
    return (spark.read.schema(schema)
            .option("header", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("enforceSchema", False).option("mode", mode))


def read_raw(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read ``<directory>/<name>.csv``, a file or a folder of part files. Quoted commas and outer blanks are kept; a line
    that does not fit the schema ends the load."""
    return _reader(spark, RAW_SCHEMAS[name], "FAILFAST").csv(f"{directory}/{name}.csv")


class Quarantined(NamedTuple):
    """The rows of a raw table that fit its schema, and the lines that do not."""

    good: DataFrame
    bad: DataFrame


def read_raw_quarantined(spark: SparkSession, directory: str, name: str) -> Quarantined:
    """As ``read_raw``, but lines with a value of another type, or with too few or too many fields, come back apart:
    ``table_name``, ``file``, ``block_start`` (where the part of the file begins that one task read) and the ``line`` itself.

    The files are parsed once and stored, so both frames come from the same pass. A header that does not fit still raises.
    """
    fields = RAW_SCHEMAS[name]
    parsed = (_reader(spark, f"{fields}, {BAD_LINE} string", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
              .option("columnPruning", False).csv(f"{directory}/{name}.csv"))
    origin = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = materialize(parsed.select("*", *origin))
    bad = rows.filter(F.col(BAD_LINE).isNotNull()).select(
        F.lit(name).alias("table_name"), F.col("_file").alias("file"), F.col("_block").alias("block_start"),
        F.col(BAD_LINE).alias("line"))
    return Quarantined(rows.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE, "_file", "_block"), bad)


def load_raw(spark: SparkSession, directory: str, quarantine: str, names: Sequence[str] = tuple(RAW_SCHEMAS)
             ) -> dict[str, DataFrame]:
    """Good rows of all raw tables; bad lines are added to the Parquet table ``quarantine``, a folder for each table name."""
    out = {}
    for name in names:
        out[name], bad = read_raw_quarantined(spark, directory, name)
        bad.write.mode("append").partitionBy("table_name").parquet(quarantine)
    return out


def check_bad_lines(tables: dict[str, Quarantined]) -> DataFrame:
    """(check_name, failures): the bad lines of each table, as the checks of ``operators.checks`` count failing rows."""
    counts = [q.bad.agg(F.lit(f"{name}: readable lines").alias("check_name"), F.count("*").alias("failures"))
              for name, q in tables.items()]
    return reduce(DataFrame.unionByName, counts)

"""Compare registered queries with their SQL: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(columns, rows):
    """Column names in order, and the rows as sorted text tuples in that column order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal; else a description of the first differences."""
    a_cols, a = canonical(spark_df.columns, spark_df.collect())
    rel = con.sql(sql)
    b_cols, b = canonical(rel.columns, rel.fetchall())
    if a_cols != b_cols:
        return f"columns {sorted(set(a_cols) ^ set(b_cols))}"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"rows {len(a)} vs {len(b)}\n  cols  {a_cols}\n  spark {only_a}\n  sql   {only_b}"
    return None


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = difference(build(spark, sf_dir), con, oracles[name])
            else:
                diff = f"no SQL; {build(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            diff = "ERROR " + str(e)[:900]
        ok = diff is None or diff.startswith("no SQL")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:36s} {time.time() - t:6.2f}s {'' if diff is None else diff}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

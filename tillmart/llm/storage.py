"""Results that later steps read more than once, as Parquet in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillmart.operators.shared_storage import new_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

"""Standard scores with the population standard deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale_parameters(df: DataFrame, cols: Sequence[str]) -> Column:
    """One-row scalar of (mean, sd) per column."""
    return df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in cols])).scalar()


def standardize(df: DataFrame, cols: Sequence[str], parameters: Column, suffix: str = "_z") -> DataFrame:
    """Add ``<col>_z``; a constant column becomes 0."""
    out = df
    for c in cols:
        mean, sd = parameters.getField(c).getField("mean"), parameters.getField(c).getField("sd")
        out = out.withColumn(c + suffix, (F.col(c) - mean) / F.when(sd > 0, sd).otherwise(1.0))
    return out


def assemble(df: DataFrame, cols: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=output).transform(df)

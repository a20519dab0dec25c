"""Rows with a signed multiplicity in the column diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consolidated(df: DataFrame) -> DataFrame:
    """One row per different row, multiplicities added up, zeros gone."""
    return df.groupBy(*[c for c in df.columns if c != "diff"]).agg(F.sum("diff").alias("diff")).where("diff <> 0")


def negated(df: DataFrame) -> DataFrame:
    return df.withColumn("diff", -F.col("diff"))


def threshold(df: DataFrame, rule: Column) -> DataFrame:
    """Multiplicities rewritten by an expression of diff, after consolidation."""
    return consolidated(df).withColumn("diff", rule).where("diff <> 0")


def distinct(df: DataFrame) -> DataFrame:
    return threshold(df, F.when(F.col("diff") > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))


def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Multiplicities of joined rows multiply."""
    return a.withColumnRenamed("diff", "da").join(b.withColumnRenamed("diff", "db"), on).withColumn("diff", F.col("da") * F.col("db")).drop("da", "db")


def semijoined(a: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a whose key is in keys, times the key's multiplicity."""
    return joined(a, consolidated(keys.select(*on, "diff")), on)


def counted(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.sum("diff").alias("count")).where("count <> 0")

"""Readers with explicit schemas for the file formats of the workloads. Splits end at line ends, as Spark's do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "u LONG, v LONG"
POINT = "x DOUBLE, y DOUBLE"
ACCIDENT = "date STRING, borough STRING, killed INT, factor1 STRING, factor2 STRING, factor3 STRING, factor4 STRING, factor5 STRING"


def lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """value: a row per line, or one per file."""
    return spark.read.text(path, wholetext=whole)


def line_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """value: the lines of the files of a folder as a stream, so many files a trigger."""
    reader = spark.readStream
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).text(path)


def records(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = ",", first: int | None = None, order: str | None = None) -> DataFrame:
    """Delimited records by position. first rows are taken in the order of a column, as files have none."""
    rows = spark.read.csv(path, schema=schema, header=header, sep=sep, quote='"', enforceSchema=True)
    return rows if first is None else rows.orderBy(order or rows.columns[0]).limit(first)


def edge_file(spark: SparkSession, path: str, header: bool = False, sep: str = ",") -> DataFrame:
    return records(spark, path, PAIR, header, sep)


def point_file(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, POINT)


def vertex_file(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """id: every number of a file of ids."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), f"[{sep}\\s]+")).alias("id")).where("id <> ''").select(F.col("id").cast("long").alias("id"))


def counted_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records below a first line that holds only their number: the first line of each file is passed over."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def accident_file(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Accident reports with a header; columns maps names in the file to those of ACCIDENT; dates are M/D/YYYY."""
    rows = spark.read.csv(path, header=True, quote='"').select(*[F.col(f"`{a}`").alias(b) for a, b in columns.items()])
    return rows.withColumns({"date": F.to_date("date", "M/d/yyyy"), "killed": F.col("killed").cast("int")})

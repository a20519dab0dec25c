"""Tokenizers and other expressions on strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_words(line: Column) -> Column:
    """Array of runs of A-Z and a-z, lower-cased after they are found."""
    return F.transform(F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def spaced_words(line: Column) -> Column:
    """Array of what white space separates, in lower case."""
    return F.filter(F.split(F.lower(line), r"\s+"), lambda w: w != "")


def ascii_rows(df: DataFrame, line: Column, name: str = "word") -> DataFrame:
    """A row per word of ascii_words(). Words are lower-cased as rows, inside generated code, not as array elements."""
    return df.select(F.explode(F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias(name))


def spaced_rows(df: DataFrame, line: Column, name: str = "word") -> DataFrame:
    """A row per word of spaced_words(), lower-cased as rows, inside generated code."""
    return df.select(F.explode(F.split(line, r"\s+")).alias("w")).where("w <> ''").select(F.lower("w").alias(name))


def cut_words(word: Column, bytes_: int = 34) -> Column:
    """The first bytes of a word; a character that does not fit whole keeps the bytes that do."""
    return F.substring(word.cast("binary"), 1, bytes_).cast("string")


def week(date: Column) -> Column:
    """Weeks of a year as days since its beginning div 7."""
    return F.floor(F.dayofyear(date) / 7).cast("int")

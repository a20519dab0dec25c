"""Word counts and count windows over the words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_rows, spaced_rows
from tidemark.operators.windows import count_windows
from tidemark.sources.tables import table


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ascii_rows(table(spark, sf_dir, "documents"), F.col("text"))


def counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n"))


def wc_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(_words(spark, sf_dir))


def wc_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spaced_rows(table(spark, sf_dir, "documents"), F.col("text")))


def wc_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wc_ascii(spark, sf_dir).orderBy(F.desc("n"), "word").limit(10)


def wc_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).agg(F.countDistinct("word").alias("n_words"))


def ww_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_windows(_words(spark, sf_dir), "word")


def ww_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_windows(_words(spark, sf_dir), "word", flush=True)


QUERIES = {f.__name__: f for f in (wc_ascii, wc_whitespace, wc_top10, wc_distinct, ww_slide, ww_flush)}

_ASCII = "words AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents), counts AS (SELECT word, count(*) AS n FROM words GROUP BY word)"
SQL = {
    "wc_ascii": f"WITH {_ASCII} SELECT word, n FROM counts",
    "wc_whitespace": r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word",
    "wc_top10": f"WITH {_ASCII} SELECT word, n FROM counts ORDER BY n DESC, word LIMIT 10",
    "wc_distinct": f"WITH {_ASCII} SELECT count(*) AS n_words FROM counts",
    "ww_slide": f"WITH {_ASCII}, fires AS (SELECT word, unnest(range(1, n // 5 + 1)) AS fire FROM counts WHERE n >= 5) SELECT word, fire, least(fire * 5, 10) AS n FROM fires",
    "ww_flush": f"WITH {_ASCII}, fires AS (SELECT word, n AS total, unnest(range(1, (n + 4) // 5 + 1)) AS fire FROM counts) SELECT word, fire, least(10, total - (fire - 1) * 5) AS n FROM fires",
}

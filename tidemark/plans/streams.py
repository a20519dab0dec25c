"""Streaming twins; each has the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import auctions, reports, words
from tidemark.streaming import streams


def stream_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.word_counts(spark, sf_dir)


def stream_nx_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.converted(spark, sf_dir)


def stream_nx_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.selected(spark, sf_dir)


def stream_nx_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.local_items(spark, sf_dir, auctions.STATES)


def stream_nx_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.hot_items(spark, sf_dir, "24 hours", "6 hours")


def stream_nx_q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.highest_bids(spark, sf_dir)


def stream_nx_q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.new_users(spark, sf_dir)


def stream_nx_q8_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.new_users_interval(spark, sf_dir)


def stream_rt_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.top_words(spark, sf_dir, "2 hours", "1 hour")


def stream_nx_q0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.to_ntz(streams.run(streams.bids(spark, sf_dir)), "date_time")


def stream_nx_winning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners of auctions, each once the watermark has passed its end."""
    return streams.won_auctions(spark, sf_dir)


def stream_nx_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.category_means(spark, sf_dir)


def stream_nx_q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.seller_means(spark, sf_dir)


def stream_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.key_counts(spark, sf_dir)


def stream_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.running_sums(spark, sf_dir)


QUERIES = {f.__name__: f for f in (stream_word_count, stream_nx_q0, stream_nx_winning, stream_nx_q4, stream_nx_q6, stream_nx_q1, stream_nx_q2, stream_nx_q3, stream_nx_q5, stream_nx_q7, stream_nx_q8, stream_nx_q8_interval, stream_rt_top5, stream_key_count, stream_running_sum)}

SQL = {
    "stream_word_count": words.SQL["wc_ascii"],
    "stream_rt_top5": reports.SQL["rt_top5"],
    "stream_key_count": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "stream_running_sum": "SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events",
} | {f"stream_{k}": auctions.SQL[k] for k in ("nx_q0", "nx_winning", "nx_q4", "nx_q6", "nx_q1", "nx_q2", "nx_q3", "nx_q5", "nx_q7", "nx_q8", "nx_q8_interval")}

"""The workloads' tables as views over the driver's Parquet tables; sources and their SQL in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days that an auction stays open, and the reserve in cents.
OPEN_DAYS, RESERVE = 365, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, city, state: customers with the names of nation and region (25 and 5 rows, broadcast)."""
    place = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("state"))


def auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seller, category, date_time, expires, reserve: orders that stay open for OPEN_DAYS."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), F.substring("o_orderpriority", 1, 1).cast("int").alias("category"),
        F.col("o_orderdate").alias("date_time"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(OPEN_DAYS))).alias("expires"), F.lit(RESERVE).cast("long").alias("reserve"),
    )


def bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """auction, bidder, price in cents, date_time: line items."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.col("l_shipdate").alias("date_time"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (u, v), u <> v: parts and suppliers of all line items as nodes of one graph."""
    return table(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")).distinct()


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, borough, killed, factor1..factor5: events as accident reports; an empty factor is an empty string."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"), F.col("event_type").alias("borough"), (F.col("value") > 150).cast("int").alias("killed"),
        F.concat(F.lit("k"), (k % 7).cast("string")).alias("factor1"), F.concat(F.lit("k"), (k % 5).cast("string")).alias("factor2"),
        F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).alias("factor3"), F.lit("").alias("factor4"), F.lit("").alias("factor5"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points: size and price."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


#: The same views for SQL twins, to stand at the head of a WITH clause.
VIEWS = f"""
person AS (SELECT c_custkey AS id, c_name AS name, n_name AS city, r_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
auction AS (SELECT o_orderkey AS id, o_custkey AS seller, CAST(substr(o_orderpriority, 1, 1) AS INT) AS category, o_orderdate AS date_time,
  o_orderdate + INTERVAL {OPEN_DAYS} DAY AS expires, CAST({RESERVE} AS BIGINT) AS reserve FROM orders),
bid AS (SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate AS date_time FROM lineitem)"""
EDGES = "edges AS (SELECT DISTINCT l_partkey AS u, l_suppkey AS v FROM lineitem WHERE l_partkey <> l_suppkey)"
ACCIDENTS = """accidents AS (SELECT CAST(ts AS DATE) AS date, event_type AS borough, CASE WHEN value > 150 THEN 1 ELSE 0 END AS killed,
  'k' || (CAST(regexp_extract(props, '[0-9]+') AS INT) % 7) AS factor1, 'k' || (CAST(regexp_extract(props, '[0-9]+') AS INT) % 5) AS factor2,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE 'u' || (user_id % 4) END AS factor3, '' AS factor4, '' AS factor5 FROM events)"""
POINTS = "points AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"

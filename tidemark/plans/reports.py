"""Rolling top words, accident statistics, joins and keyed sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import week
from tidemark.operators.windows import running_sum, top
from tidemark.sources.tables import ACCIDENTS, accidents, table


def rolling_top(words: DataFrame, size: str, slide: str, n: int = 5) -> DataFrame:
    """words (word, ts) -> the n most frequent words of each sliding window; equal counts by word."""
    counts = words.groupBy(F.window("ts", size, slide).alias("w"), "word").agg(F.count("*").alias("n"))
    rows = counts.select(F.col("w.end").alias("window_end"), "word", "n")
    return top(rows, ["window_end"], [F.desc("n"), F.col("word")], n).select("window_end", "word", "n", F.col("rank").cast("long").alias("rank"))


def rt_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_top(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("word"), "ts"), "2 hours", "1 hour")


class TopN:
    """A table function: of rows partitioned and ordered by the caller, the first n with their rank."""

    def __init__(self):
        self.rank = 0

    def eval(self, row, n: int):
        self.rank += 1
        if self.rank <= n:
            yield row["window_end"], row["word"], row["n"], self.rank


def rt_top5_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rt_top5 by a registered table function that SQL calls by its name."""
    spark.udtf.register("tidemark_top_n", F.udtf(TopN, returnType="window_end timestamp_ntz, word string, n long, rank long"))
    words = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("word"), "ts")
    counts = words.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "word").agg(F.count("*").alias("n"))
    counts.select(F.col("w.end").alias("window_end"), "word", "n").createOrReplaceTempView("tidemark_counts")
    return spark.sql("SELECT window_end, word, n, rank FROM tidemark_top_n(TABLE(tidemark_counts) PARTITION BY window_end ORDER BY (n DESC, word), 5)")


def ca_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lethal accidents per year and week."""
    return accidents(spark, sf_dir).groupBy(F.year("date").alias("year"), week(F.col("date")).alias("week")).agg(F.sum((F.col("killed") > 0).cast("long")).alias("lethal"))


def ca_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents and lethal ones per contributing factor; a factor counts once per accident."""
    factors = F.array_distinct(F.filter(F.array(*[f"factor{i}" for i in range(1, 6)]), lambda f: f != ""))
    rows = accidents(spark, sf_dir).select("killed", F.explode(factors).alias("factor"))
    return rows.groupBy("factor").agg(F.count("*").alias("accidents"), F.sum((F.col("killed") > 0).cast("long")).alias("lethal"))


def ca_borough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents, lethal ones and their share per borough and week of the year."""
    rows = accidents(spark, sf_dir).groupBy("borough", week(F.col("date")).alias("week")).agg(F.count("*").alias("accidents"), F.sum((F.col("killed") > 0).cast("long")).alias("lethal"))
    return rows.withColumn("percent", 100.0 * F.col("lethal") / F.col("accidents"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def hj_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag join on one key: the values of both sides, customers' nations and orders."""
    return _customers(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("v1"), F.col("o_orderkey").alias("v2"))


def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the number of their orders, 0 where they have none."""
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return _customers(spark, sf_dir).join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select("o_custkey")
    return _customers(spark, sf_dir).join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey")
    return _customers(spark, sf_dir).join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def key_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each event, how many its user has had and what they add up to in cents."""
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return e.select("event_id", "user_id", running_sum(e, "user_id", ["ts", "event_id"], F.lit(1).cast("long")).alias("n"), running_sum(e, "user_id", ["ts", "event_id"], F.col("cents")).alias("total"))


def key_latest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events joined with their user's last signup, whenever it came; users without one have no rows."""
    e = table(spark, sf_dir, "events")
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("signup"))
    return e.where("event_type = 'purchase'").join(last, "user_id").select("event_id", "user_id", "signup")


QUERIES = {f.__name__: f for f in (rt_top5, rt_top5_by_name, ca_week, ca_factor, ca_borough, hj_pairs, join_left, join_semi, join_anti, key_running_sum, key_latest_join)}

_TOP5 = """WITH e AS (SELECT 'u' || user_id AS word, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
  x AS (SELECT word, unnest(range((t // 3600) * 3600 - 3600, (t // 3600) * 3600 + 1, 3600)) AS s FROM e),
  c AS (SELECT s, word, count(*) AS n FROM x GROUP BY s, word), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, word) AS rank FROM c)
  SELECT make_timestamp((s + 7200) * 1000000) AS window_end, word, n, rank FROM r WHERE rank <= 5"""
SQL = {
    "rt_top5": _TOP5,
    "rt_top5_by_name": _TOP5,
    "ca_week": f"WITH {ACCIDENTS} SELECT CAST(year(date) AS INT) AS year, CAST(dayofyear(date) // 7 AS INT) AS week, CAST(sum(killed) AS BIGINT) AS lethal FROM accidents GROUP BY ALL",
    "ca_factor": f"""WITH {ACCIDENTS}, f AS (SELECT killed, unnest(list_distinct(list_filter([factor1, factor2, factor3, factor4, factor5], lambda f: f <> ''))) AS factor FROM accidents)
  SELECT factor, count(*) AS accidents, CAST(sum(killed) AS BIGINT) AS lethal FROM f GROUP BY factor""",
    "ca_borough": f"WITH {ACCIDENTS}, g AS (SELECT borough, CAST(dayofyear(date) // 7 AS INT) AS week, count(*) AS accidents, CAST(sum(killed) AS BIGINT) AS lethal FROM accidents GROUP BY ALL) SELECT *, 100.0::DOUBLE * lethal / accidents AS percent FROM g",
    "hj_pairs": "SELECT c_nationkey AS v1, o_orderkey AS v2 FROM customer JOIN orders ON c_custkey = o_custkey",
    "join_left": "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000 GROUP BY c_custkey",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "key_running_sum": "SELECT event_id, user_id, count(*) OVER w AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "key_latest_join": "WITH l AS (SELECT user_id, event_id AS signup, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'signup') SELECT e.event_id, e.user_id, l.signup FROM events e JOIN l ON e.user_id = l.user_id AND r = 1 WHERE event_type = 'purchase'",
}

"""The auction queries q0 to q8 over views of orders (auctions), line items (bids), customers (people) and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import euros
from tidemark.operators.windows import last_mean
from tidemark.sources.tables import VIEWS, auction, bid, person, table

STATES = ("AMERICA", "ASIA", "EUROPE")


def nx_q0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bid as it is."""
    return bid(spark, sf_dir)


def nx_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids with prices in another currency."""
    return bid(spark, sf_dir).withColumn("price", euros(F.col("price")))


def nx_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids on every 123rd auction."""
    return bid(spark, sf_dir).where("auction % 123 = 0").select("auction", "price")


def nx_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers of some states, and their auctions of one category."""
    a = auction(spark, sf_dir).where("category = 1").select(F.col("id").alias("auction"), "seller")
    p = person(spark, sf_dir).where(F.col("state").isin(*STATES))
    return a.join(p, F.col("seller") == F.col("id")).select("name", "city", "state", "auction")


def winning(bids: DataFrame, auctions: DataFrame) -> DataFrame:
    """The highest bid of each auction among those at its reserve or over it while it was open (from its time on, before it expires); of equal ones the
    earliest, then the lowest bidder. The join is by auction, the interval a condition on it."""
    a = auctions.select(F.col("id").alias("auction"), "seller", "category", "expires", "reserve", F.col("date_time").alias("opened"))
    rows = bids.join(a, "auction").where("price >= reserve AND date_time >= opened AND date_time < expires")
    best = rows.groupBy("auction").agg(F.min(F.struct((-F.col("price")).alias("p"), "date_time", "bidder", "seller", "category", "expires")).alias("b"))
    return best.select("auction", "b.seller", "b.category", "b.expires", "b.bidder", (-F.col("b.p")).alias("price"))


def nx_winning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winning(bid(spark, sf_dir), auction(spark, sf_dir))


def nx_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean winning price per category."""
    return nx_winning(spark, sf_dir).groupBy("category").agg(F.avg("price").alias("avg_price"))


def hot_items(events: DataFrame, size: str = "24 hours", slide: str = "6 hours") -> DataFrame:
    """Per sliding window the item with most events; of equal ones the highest."""
    n = events.groupBy(F.window("ts", size, slide).alias("w"), "item").agg(F.count("*").alias("n"))
    best = n.groupBy("w").agg(F.max(F.struct("n", "item")).alias("b"))
    return best.select(F.col("w.start").alias("window_start"), "b.item", "b.n")


def nx_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_items(table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("item")))


def nx_q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last ten winning prices of a seller, after each of them."""
    return nx_winning(spark, sf_dir).select("seller", "auction", last_mean("seller", ["expires", "auction"], "price").alias("avg_price"))


def nx_q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest bid of each day; of equal ones that of the lowest auction and bidder."""
    rows = bid(spark, sf_dir).groupBy(F.window("date_time", "1 day").alias("w")).agg(F.min(F.struct((-F.col("price")).alias("p"), "auction", "bidder")).alias("b"))
    return rows.select(F.col("w.start").alias("window_start"), "b.auction", "b.bidder", (-F.col("b.p")).alias("price"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    new = e.where("event_type = 'signup'").select(F.col("user_id").alias("id"), F.col("ts").alias("since"), F.col("event_id").alias("signup"))
    return new, e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"), "value")


def nx_q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and their sales of the same day."""
    new, sold = _sides(spark, sf_dir)
    new = new.withColumn("w", F.window("since", "1 day")["start"])
    sold = sold.withColumn("day", F.window("ts", "1 day")["start"])
    return new.join(sold, (F.col("id") == F.col("user_id")) & (F.col("w") == F.col("day"))).select("id", "signup", "purchase", "value")


def nx_q8_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and their sales of the ten hours after."""
    new, sold = _sides(spark, sf_dir)
    return new.join(sold, (F.col("id") == F.col("user_id")) & (F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("since") + F.expr("INTERVAL 10 HOURS"))).select("id", "signup", "purchase", "value")


def nx_seller_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winning prices by seller with the previous one beside each: per-key state of one value."""
    w = Window.partitionBy("seller").orderBy("expires", "auction")
    return nx_winning(spark, sf_dir).select("seller", "auction", "price", F.lag("price").over(w).alias("previous"))


QUERIES = {f.__name__: f for f in (nx_q0, nx_q1, nx_q2, nx_q3, nx_winning, nx_q4, nx_q5, nx_q6, nx_q7, nx_q8, nx_q8_interval, nx_seller_best)}

_WIN = f"""WITH {VIEWS}, w AS (SELECT b.auction, a.seller, a.category, a.expires, b.bidder, b.price,
  row_number() OVER (PARTITION BY b.auction ORDER BY b.price DESC, b.date_time, b.bidder) AS r
  FROM bid b JOIN auction a ON b.auction = a.id WHERE b.price >= a.reserve AND b.date_time >= a.date_time AND b.date_time < a.expires),
winning AS (SELECT auction, seller, category, expires, bidder, price FROM w WHERE r = 1)"""
_SIDES = "n AS (SELECT user_id AS id, ts AS since, event_id AS signup FROM events WHERE event_type = 'signup'), s AS (SELECT user_id, ts, event_id AS purchase, value FROM events WHERE event_type = 'purchase')"
SQL = {
    "nx_q0": f"WITH {VIEWS} SELECT * FROM bid",
    "nx_q1": f"WITH {VIEWS} SELECT auction, bidder, CAST(trunc(CAST(price AS FLOAT) * CAST(0.908 AS FLOAT)) AS BIGINT) AS price, date_time FROM bid",
    "nx_q2": f"WITH {VIEWS} SELECT auction, price FROM bid WHERE auction % 123 = 0",
    "nx_q3": f"WITH {VIEWS} SELECT p.name, p.city, p.state, a.id AS auction FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 1 AND p.state IN {STATES}",
    "nx_winning": f"{_WIN} SELECT * FROM winning",
    "nx_q4": f"{_WIN} SELECT category, avg(price) AS avg_price FROM winning GROUP BY category",
    "nx_q5": """WITH e AS (SELECT user_id AS item, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
  x AS (SELECT item, unnest(range((t // 21600) * 21600 - 64800, (t // 21600) * 21600 + 1, 21600)) AS s FROM e),
  c AS (SELECT s, item, count(*) AS n FROM x GROUP BY s, item), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, item DESC) AS k FROM c)
  SELECT make_timestamp(s * 1000000) AS window_start, item, n FROM r WHERE k = 1""",
    "nx_q6": f"{_WIN} SELECT seller, auction, avg(price) OVER (PARTITION BY seller ORDER BY expires, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS avg_price FROM winning",
    "nx_q7": f"""WITH {VIEWS}, r AS (SELECT date_trunc('day', date_time) AS d, auction, bidder, price, row_number() OVER (PARTITION BY date_trunc('day', date_time) ORDER BY price DESC, auction, bidder) AS k FROM bid)
  SELECT CAST(d AS TIMESTAMP) AS window_start, auction, bidder, price FROM r WHERE k = 1""",
    "nx_q8": f"WITH {_SIDES} SELECT id, signup, purchase, value FROM n JOIN s ON id = user_id AND date_trunc('day', since) = date_trunc('day', ts)",
    "nx_q8_interval": f"WITH {_SIDES} SELECT id, signup, purchase, value FROM n JOIN s ON id = user_id AND ts >= since AND ts < since + INTERVAL 10 HOUR",
    "nx_seller_best": f"{_WIN} SELECT seller, auction, price, lag(price) OVER (PARTITION BY seller ORDER BY expires, auction) AS previous FROM winning",
}

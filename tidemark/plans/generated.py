"""The auction queries over generated events: one numbered event per row of the events table, routed to people, auctions and
bids. The SQL twins generate the same rows by the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import euros
from tidemark.operators.sinks import latency
from tidemark.operators.windows import last_mean, retracted
from tidemark.plans import auctions
from tidemark.sources import generators as g
from tidemark.sources.tables import table

#: Nanoseconds between events.
DELAY = 10_000_000
HERE = ("OR", "ID", "CA")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.events(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), delay_ns=DELAY)


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    plain = lambda df: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("date_time", "expires") if c in df.columns})
    return tuple(plain(df) for df in g.demuxed(_events(spark, sf_dir)))


def gen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events, how many and on how many ids, and the least one."""
    key = F.coalesce("person.id", "auction.id", "bid.auction")
    return _events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct(key).alias("ids"), F.min(key).alias("least"))


def gen_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[0].withColumn("extra", F.length("extra").cast("long"))


def gen_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[1].withColumn("extra", F.length("extra").cast("long"))


def gen_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids with hot and usual channels; of urls only whether they name the channel."""
    return _parts(spark, sf_dir)[2].withColumns({"extra": F.length("extra").cast("long"), "url": F.regexp_extract("url", "channel_id=([0-9]+)$", 1)})


def gen_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].select("auction", "bidder", euros(F.col("price")).alias("price"), "date_time")


def gen_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].where("auction % 123 = 0").select("auction", "price")


def gen_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers of some states and their auctions of one category; of people with one id the last counts."""
    p, a, _ = _parts(spark, sf_dir)
    last = p.groupBy("id").agg(F.max_by(F.struct("name", "city", "state"), "date_time").alias("p")).select("id", "p.*").where(F.col("state").isin(*HERE))
    return a.where("category = 10").select(F.col("id").alias("auction"), "seller").join(last, F.col("seller") == F.col("id")).select("name", "city", "state", "auction")


def _won(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = _parts(spark, sf_dir)
    return auctions.winning(b.select("auction", "bidder", "price", "date_time"), a)


def gen_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _won(spark, sf_dir).groupBy("category").agg(F.avg("price").alias("avg_price"))


def gen_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The auction with most bids in each ten seconds, every two."""
    return auctions.hot_items(_parts(spark, sf_dir)[2].select(F.col("date_time").alias("ts"), F.col("auction").alias("item")), "10 seconds", "2 seconds")


def gen_q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _won(spark, sf_dir).select("seller", "auction", last_mean("seller", ["expires", "auction"], "price").alias("avg_price"))


def gen_q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest bid of each ten seconds; of equal ones that of the lowest auction and bidder."""
    rows = _parts(spark, sf_dir)[2].groupBy(F.window("date_time", "10 seconds").alias("w")).agg(F.min(F.struct((-F.col("price")).alias("p"), "auction", "bidder")).alias("b"))
    return rows.select(F.col("w.start").alias("window_start"), "b.auction", "b.bidder", (-F.col("b.p")).alias("price"))


def gen_q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and the auctions that they opened within ten seconds."""
    p, a, _ = _parts(spark, sf_dir)
    soon = (F.col("seller") == F.col("pid")) & (F.col("opened") >= F.col("since")) & (F.col("opened") < F.col("since") + F.expr("INTERVAL 10 SECONDS"))
    return p.select(F.col("id").alias("pid"), "name", F.col("date_time").alias("since")).join(a.select("seller", F.col("id").alias("auction"), F.col("date_time").alias("opened")), soon).select("pid", "name", "auction")


def nx_q5_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot items by slices that are added and taken back."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    n = retracted(e, "item", 24 * 3600, 6 * 3600)
    best = n.groupBy("at").agg(F.max(F.struct("n", "item")).alias("b"))
    return best.select(F.timestamp_seconds(F.col("at") - 24 * 3600).cast("timestamp_ntz").alias("window_start"), "b.item", "b.n")


def lat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds from the later of two joined rows to the last event of the table, at most per user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    end = e.agg(F.max("at").alias("now"))
    new = e.where("event_type = 'signup'").select("user_id", F.col("at").alias("since"))
    both = e.where("event_type = 'purchase'").join(new, "user_id").withColumn("k", F.lit(1)).join(F.broadcast(end.withColumn("k", F.lit(1))), "k")
    return both.groupBy("user_id").agg(F.min(latency([F.col("at"), F.col("since")], F.col("now"))).alias("latency"))


QUERIES = {f.__name__: f for f in (gen_events, gen_people, gen_auctions, gen_bids, gen_q1, gen_q2, gen_q3, gen_q4, gen_q5, gen_q6, gen_q7, gen_q8, nx_q5_retraction, lat_join)}


def _draw(salt: str) -> str:
    s = g.salt_of(salt)
    first = f"((n + {s}) * 48271 + 11) % {g.PRIME}"
    return f"((({first}) * ({first}) + {s}) % {g.PRIME} * 16807 % {g.PRIME})"


def _below(salt: str, limit: object) -> str:
    return f"({_draw(salt)} % greatest({limit}, 1))"


def _pick(salt: str, values: tuple[str, ...]) -> str:
    return f"{list(values)}[{_below(salt, len(values))} + 1]"


def _letters(salt: str, n: int) -> str:
    return f"substr(translate(sha256(n || ' {salt}'), '0123456789', 'ghijklmnop') || translate(sha256(n || ' {salt}'), '0123456789', 'ghijklmnop'), 1, {n})"


def _padding(salt: str, size: str, mean: int) -> str:
    wanted = f"({mean} - ({size}))"
    delta = f"(({wanted} + 2) // 5)"
    return f"CASE WHEN {size} > {mean} THEN 0 ELSE {wanted} - {delta} + CASE WHEN {delta} > 0 THEN {_below(f'{salt} size', f'2 * {delta}')} ELSE 0 END END"


def _price(salt: str) -> str:
    return f"CAST(round(pow(10.0::DOUBLE, 6 * ({_draw(salt)} / {g.PRIME}.0::DOUBLE)) * 100) AS BIGINT)"


def _hot(salt: str, ratio: int, whole: str, cold: str) -> str:
    return f"CASE WHEN {_below(salt, ratio)} > 0 THEN {whole} ELSE {cold} END"


_TIME = f"make_timestamp(CAST(n * {DELAY} // 1000000 * 1000 AS BIGINT))"
_SOMEONE = lambda salt: f"lp + 1 - active + {_below(salt, f'active + {g.LEAD}')}"
_CARD = " || ' ' || ".join(f"lpad(CAST({_below(f'card{i}', 10_000)} AS VARCHAR), 4, '0')" for i in range(4))
_REVERSED = "CAST(('0b' || reverse(lpad(CAST(bin(c) AS VARCHAR), 32, '0'))) AS BIGINT)"
#: People, auctions and bids, to stand at the head of a WITH clause.
_GEN = f"""
e AS (SELECT event_id AS n, event_id % {g.PER} AS rem, event_id // {g.PER} AS epoch FROM events),
f AS (SELECT n, rem, epoch * {g.PERSONS} + least(rem, {g.PERSONS - 1}) AS lp, CASE WHEN rem < {g.PERSONS} THEN epoch * {g.AUCTIONS} - 1 WHEN rem < {g.PERSONS + g.AUCTIONS} THEN epoch * {g.AUCTIONS} + rem - {g.PERSONS} ELSE epoch * {g.AUCTIONS} + {g.AUCTIONS - 1} END AS la FROM e),
x AS (SELECT *, least(lp + 1, {g.ACTIVE}) AS active, greatest(la - {g.IN_FLIGHT}, 0) AS oldest FROM f),
person_0 AS (SELECT n, lp + {g.FIRST_PERSON} AS id, {_pick('first', g.FIRST_NAMES)} || ' ' || {_pick('last', g.LAST_NAMES)} AS name, {_letters('mail', 7)} || '@' || {_letters('host', 5)} || '.com' AS email_address, {_CARD} AS credit_card, {_pick('city', g.CITIES)} AS city, {_pick('state', g.STATES)} AS state, {_TIME} AS date_time FROM x WHERE rem < {g.PERSONS}),
person AS (SELECT id, name, email_address, credit_card, city, state, date_time, CAST({_padding('person', '8 + length(name) + length(email_address) + length(credit_card) + length(city) + length(state)', g.PERSON_BYTES)} AS BIGINT) AS extra FROM person_0),
auction AS (SELECT la + {g.FIRST_AUCTION} AS id, {_letters('item', 20)} AS item_name, {_letters('description', 100)} AS description, {_price('bid0')} AS initial_bid, {_price('bid0')} + {_price('reserve')} AS reserve, {_TIME} AS date_time,
  make_timestamp(CAST((n * {DELAY} // 1000000 + 1 + {_below('expires', 2 * (g.IN_FLIGHT * g.PER // g.AUCTIONS * DELAY // 1_000_000))}) * 1000 AS BIGINT)) AS expires,
  CAST({_hot('hot seller', g.HOT_SELLER, f'lp // {g.HOT} * {g.HOT}', _SOMEONE('seller'))} + {g.FIRST_PERSON} AS BIGINT) AS seller, {_below('category', g.CATEGORIES)} + {g.FIRST_CATEGORY} AS category,
  CAST({_padding('extra', '168', g.AUCTION_BYTES)} AS BIGINT) AS extra FROM x WHERE rem >= {g.PERSONS} AND rem < {g.PERSONS + g.AUCTIONS}),
bid_0 AS (SELECT *, CASE WHEN {_below('hot channel', g.HOT_CHANNEL)} > 0 THEN -1 - {_below('which hot channel', len(g.HOT_CHANNELS))} ELSE {_below('channel', g.CHANNELS)} END AS c FROM x WHERE rem >= {g.PERSONS + g.AUCTIONS}),
bid AS (SELECT CAST({_hot('hot auction', g.HOT_AUCTION, f'la // {g.HOT} * {g.HOT}', f"oldest + {_below('auction', f'la - oldest + 1 + {g.LEAD}')}")} + {g.FIRST_AUCTION} AS BIGINT) AS auction,
  CAST({_hot('hot bidder', g.HOT_BIDDER, f'lp // {g.HOT} * {g.HOT} + 1', _SOMEONE('bidder'))} + {g.FIRST_PERSON} AS BIGINT) AS bidder, {_price('price')} AS price, c, {_TIME} AS date_time, CAST({_padding('bid', '32', g.BID_BYTES)} AS BIGINT) AS extra FROM bid_0)"""
_WIN = f"""WITH {_GEN}, w AS (SELECT b.auction, a.seller, a.category, a.expires, b.price, row_number() OVER (PARTITION BY b.auction ORDER BY b.price DESC, b.date_time, b.bidder) AS r
  FROM bid b JOIN auction a ON b.auction = a.id WHERE b.price >= a.reserve AND b.date_time >= a.date_time AND b.date_time < a.expires), winning AS (SELECT * FROM w WHERE r = 1)"""
_URL = f"CASE WHEN c < 0 THEN '' WHEN {_below('has id', 10).replace('(n +', '(c +')} = 0 THEN '' ELSE CAST(CASE WHEN r >= 2147483648 THEN 4294967296 - r ELSE r END AS VARCHAR) END"
SQL = {
    "gen_events": f"WITH {_GEN}, k AS (SELECT 'person' AS kind, id FROM person UNION ALL SELECT 'auction', id FROM auction UNION ALL SELECT 'bid', auction FROM bid) SELECT kind, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS least FROM k GROUP BY kind",
    "gen_people": f"WITH {_GEN} SELECT * FROM person",
    "gen_auctions": f"WITH {_GEN} SELECT * FROM auction",
    "gen_bids": f"WITH {_GEN}, y AS (SELECT *, CASE WHEN c >= 0 THEN (SELECT sum(CAST(((c >> CAST(i AS INT)) & 1) AS BIGINT) << CAST(31 - i AS INT)) FROM range(32) t(i)) END AS r FROM bid) SELECT auction, bidder, price, CASE WHEN c < 0 THEN {list(g.HOT_CHANNELS)}[-c] ELSE 'channel-' || c END AS channel, {_URL} AS url, date_time, extra FROM y",
    "gen_q1": f"WITH {_GEN} SELECT auction, bidder, CAST(trunc(CAST(price AS FLOAT) * CAST(0.908 AS FLOAT)) AS BIGINT) AS price, date_time FROM bid",
    "gen_q2": f"WITH {_GEN} SELECT auction, price FROM bid WHERE auction % 123 = 0",
    "gen_q3": f"WITH {_GEN} SELECT p.name, p.city, p.state, a.id AS auction FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 10 AND p.state IN {HERE}",
    "gen_q4": f"{_WIN} SELECT category, avg(price) AS avg_price FROM winning GROUP BY category",
    "gen_q5": f"""WITH {_GEN}, t AS (SELECT auction AS item, CAST(floor(epoch(date_time)) AS BIGINT) AS t FROM bid), y AS (SELECT item, unnest(range(t // 2 * 2 - 8, t // 2 * 2 + 1, 2)) AS s FROM t),
  z AS (SELECT s, item, count(*) AS n FROM y GROUP BY s, item), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, item DESC) AS k FROM z) SELECT make_timestamp(s * 1000000) AS window_start, item, n FROM r WHERE k = 1""",
    "gen_q6": f"{_WIN} SELECT seller, auction, avg(price) OVER (PARTITION BY seller ORDER BY expires, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS avg_price FROM winning",
    "gen_q7": f"WITH {_GEN}, r AS (SELECT CAST(floor(epoch(date_time)) AS BIGINT) // 10 * 10 AS s, auction, bidder, price, row_number() OVER (PARTITION BY CAST(floor(epoch(date_time)) AS BIGINT) // 10 ORDER BY price DESC, auction, bidder) AS k FROM bid) SELECT make_timestamp(s * 1000000) AS window_start, auction, bidder, price FROM r WHERE k = 1",
    "gen_q8": f"WITH {_GEN} SELECT p.id AS pid, p.name, a.id AS auction FROM person p JOIN auction a ON a.seller = p.id AND a.date_time >= p.date_time AND a.date_time < p.date_time + INTERVAL 10 SECOND",
    "nx_q5_retraction": auctions.SQL["nx_q5"],
    "lat_join": "WITH m AS (SELECT max(epoch_us(ts)) AS now FROM events) SELECT p.user_id, CAST(min(now - greatest(epoch_us(p.ts), epoch_us(s.ts))) AS BIGINT) AS latency FROM events p JOIN events s ON p.user_id = s.user_id, m WHERE p.event_type = 'purchase' AND s.event_type = 'signup' GROUP BY p.user_id",
}

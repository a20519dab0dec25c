"""Generated inputs: auction events, skewed hashtags, random pairs, word ids. Everything follows from the row number by
whole-number arithmetic, so that any number of tasks makes the same rows, streams and batches agree, and other SQL engines
can make them too."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the auction model: 1 person, 3 auctions and 46 bids in 50 events; first ids; hot shares; how many people
# are active, auctions open, and how far ids run ahead; mean bytes of rows; lists to draw from.
PER, PERSONS, AUCTIONS = 50, 1, 3
FIRST_PERSON, FIRST_AUCTION, FIRST_CATEGORY, CATEGORIES = 1000, 1000, 10, 5
HOT, HOT_SELLER, HOT_AUCTION, HOT_BIDDER, HOT_CHANNEL = 100, 4, 2, 4, 2
ACTIVE, IN_FLIGHT, LEAD = 1000, 100, 10
PERSON_BYTES, AUCTION_BYTES, BID_BYTES = 200, 500, 100
CHANNELS = 10_000
STATES = ("AZ", "CA", "ID", "OR", "WA", "WY")
CITIES = ("phoenix", "los angeles", "san francisco", "boise", "portland", "bend", "redmond", "seattle", "kent", "cheyenne")
FIRST_NAMES = ("peter", "paul", "luke", "john", "saul", "vicky", "kate", "julie", "sarah", "deiter", "walter")
LAST_NAMES = ("shultz", "abrams", "spencer", "white", "bartels", "walton", "smith", "jones", "noris")
HOT_CHANNELS = ("Google", "Facebook", "Baidu", "Apple")

#: The modulus of draws, a prime.
PRIME = 2_147_483_647


def salt_of(name: str) -> int:
    return zlib.crc32(name.encode()) % PRIME


def draw(n: Column, salt: str) -> Column:
    """A number below PRIME that follows from n (not negative) and salt: two linear steps around a square."""
    s = salt_of(salt)
    first = ((n + s) * 48271 + 11) % PRIME
    return (first * first + s) % PRIME * 16807 % PRIME


def uniform(n: Column, salt: str) -> Column:
    """A double in [0, 1) that follows from n and salt."""
    return draw(n, salt) / float(PRIME)


def below(n: Column, salt: str, limit: Column | int) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return (draw(n, salt) % F.greatest(limit, F.lit(1))).cast("long")


def _pick(n: Column, salt: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (below(n, salt, len(values)) + 1).cast("int"))


def letters(n: Column, salt: str, length: Column | int) -> Column:
    """A string of that many letters."""
    length = F.lit(length) if isinstance(length, int) else length
    some = F.translate(F.sha2(F.concat_ws(" ", n.cast("string"), F.lit(salt)), 256), "0123456789", "ghijklmnop")
    return F.substring(F.repeat(some, (F.floor(length / 64) + 1).cast("int")), F.lit(1), length.cast("int"))


def delimited(n: Column, salt: str, most: int = 5, delimiter: str = "_") -> Column:
    """A string of three letters at least and fewer than most, one in thirteen of them a delimiter."""
    chars = [F.when(below(n, f"{salt} cut {k}", 13) == 0, F.lit(delimiter)).otherwise(F.char(97 + below(n, f"{salt} {k}", 26))) for k in range(most - 1)]
    return F.substring(F.concat(*chars), F.lit(1), (3 + below(n, f"{salt} length", most - 3)).cast("int"))


def padding(n: Column, salt: str, size: Column, mean: int) -> Column:
    """Letters that bring a row of size bytes to mean bytes, a fifth more or less; none if it is longer."""
    wanted = F.greatest(F.lit(mean) - size, F.lit(0))
    delta = F.floor((wanted + 2) / 5)
    return letters(n, salt, F.when(size > mean, F.lit(0)).otherwise(wanted - delta + F.when(delta > 0, below(n, f"{salt} size", 2 * delta)).otherwise(F.lit(0))))


def delays(first: int, then: int, shape: str = "sine", steps: int = 10, unit_ns: int = 1_000_000_000) -> list[float]:
    """Nanoseconds between events over a period in which the rate goes from first to then and back: one value for a
    constant rate, two for a square, so many steps of a cosine."""
    if first == then:
        return [unit_ns / first]
    if shape == "square":
        return [unit_ns / first, unit_ns / then]
    return [unit_ns / round((first + then) / 2 + (first - then) / 2 * math.cos(2 * math.pi * i / steps)) for i in range(steps)]


def channels(spark: SparkSession) -> DataFrame:
    """(at, channel, url) of CHANNELS channels and, below 0, of the hot ones: a table of a fixed size."""
    n = F.col("id")
    base = F.concat(F.lit("https://auctions.example/"), F.concat_ws("/", *[delimited(n, f"path {k}") for k in range(3)]), F.lit("/item.htm?query=1"))
    named = F.when(below(n, "has id", 10) > 0, F.concat(F.lit("&channel_id="), channel_id(n).cast("string"))).otherwise(F.lit(""))
    usual = spark.range(CHANNELS).select(n.alias("at"), F.concat(F.lit("channel-"), n.cast("string")).alias("channel"), F.concat(base, named).alias("url"))
    hot = spark.range(len(HOT_CHANNELS)).select((-1 - n).alias("at"), F.element_at(F.array(*[F.lit(c) for c in HOT_CHANNELS]), (n + 1).cast("int")).alias("channel"), base.alias("url"))
    return usual.union(hot)


def events(numbers: DataFrame, start_ms: int = 0, delay_ns: int = 10_000_000, disorder: int = 1) -> DataFrame:
    """numbers (id) -> n, kind, ts, person, auction, bid: one struct of the three is not null. disorder is the size of
    groups within which numbers (and so times) are permuted."""
    n = F.col("id") if disorder <= 1 else (F.floor(F.col("id") / disorder) * disorder + (F.col("id") * 953) % disorder).cast("long")
    rows = numbers.select(n.alias("n")).withColumn("rem", F.col("n") % PER)
    n, epoch = F.col("n"), F.floor(F.col("n") / PER).cast("long")
    channel = F.when(below(n, "hot channel", HOT_CHANNEL) > 0, -1 - below(n, "which hot channel", len(HOT_CHANNELS))).otherwise(below(n, "channel", CHANNELS))
    rows = rows.withColumn("at", channel).join(F.broadcast(channels(numbers.sparkSession)), "at")
    ms = F.floor(n * delay_ns / 1_000_000).cast("long") + start_ms
    last_person = epoch * PERSONS + F.least(F.col("rem"), F.lit(PERSONS - 1))
    last_auction = F.when(F.col("rem") < PERSONS, epoch * AUCTIONS - 1).when(F.col("rem") < PERSONS + AUCTIONS, epoch * AUCTIONS + F.col("rem") - PERSONS).otherwise(epoch * AUCTIONS + AUCTIONS - 1)
    hot = lambda salt, ratio, whole, cold: F.when(below(n, salt, ratio) > 0, whole).otherwise(cold)
    price = lambda salt: F.round(F.pow(F.lit(10.0), 6 * uniform(n, salt)) * 100).cast("long")
    head = lambda last: (F.floor(last / HOT) * HOT).cast("long")  # noqa: E731  # the first of its batch of ids
    active = F.least(last_person + 1, F.lit(ACTIVE))
    someone = lambda salt: last_person + 1 - active + below(n, salt, active + LEAD)
    oldest = F.greatest(last_auction - IN_FLIGHT, F.lit(0))
    time, size = F.timestamp_millis(ms), lambda *texts: sum((F.length(t) for t in texts), F.lit(8))
    name, mail = F.concat_ws(" ", _pick(n, "first", FIRST_NAMES), _pick(n, "last", LAST_NAMES)), F.concat(letters(n, "mail", 7), F.lit("@"), letters(n, "host", 5), F.lit(".com"))
    card = F.format_string("%04d %04d %04d %04d", *[below(n, f"card{i}", 10_000) for i in range(4)])
    city, state = _pick(n, "city", CITIES), _pick(n, "state", STATES)
    person = F.struct((last_person + FIRST_PERSON).alias("id"), name.alias("name"), mail.alias("email_address"), card.alias("credit_card"), city.alias("city"), state.alias("state"), time.alias("date_time"), padding(n, "person", size(name, mail, card, city, state), PERSON_BYTES).alias("extra"))
    horizon = IN_FLIGHT * PER // AUCTIONS * delay_ns // 1_000_000
    seller = hot("hot seller", HOT_SELLER, head(last_person), someone("seller")) + FIRST_PERSON
    auction = F.struct((last_auction + FIRST_AUCTION).alias("id"), letters(n, "item", 20).alias("item_name"), letters(n, "description", 100).alias("description"), price("bid0").alias("initial_bid"), (price("bid0") + price("reserve")).alias("reserve"), time.alias("date_time"), F.timestamp_millis(ms + 1 + below(n, "expires", max(2 * horizon, 1))).alias("expires"), seller.cast("long").alias("seller"), (below(n, "category", CATEGORIES) + FIRST_CATEGORY).alias("category"), padding(n, "extra", F.lit(8 + 20 + 100 + 5 * 8), AUCTION_BYTES).alias("extra"))
    on = hot("hot auction", HOT_AUCTION, head(last_auction), oldest + below(n, "auction", last_auction - oldest + 1 + LEAD)) + FIRST_AUCTION
    by = hot("hot bidder", HOT_BIDDER, head(last_person) + 1, someone("bidder")) + FIRST_PERSON
    bid = F.struct(on.cast("long").alias("auction"), by.cast("long").alias("bidder"), price("price").alias("price"), "channel", "url", time.alias("date_time"), padding(n, "bid", F.lit(32), BID_BYTES).alias("extra"))
    kind = F.when(F.col("rem") < PERSONS, "person").when(F.col("rem") < PERSONS + AUCTIONS, "auction").otherwise("bid")
    return rows.select("n", kind.alias("kind"), time.alias("ts"), F.when(kind == "person", person).alias("person"), F.when(kind == "auction", auction).alias("auction"), F.when(kind == "bid", bid).alias("bid"))


def routed(rows: DataFrame, **routes: Column) -> dict[str, DataFrame]:
    """Rows by the first route whose condition holds; rows that none takes are in none."""
    taken, out = F.lit(False), {}
    for name, rule in routes.items():
        rule = F.coalesce(rule, F.lit(False))
        out[name], taken = rows.where(rule & ~taken), taken | rule
    return out


def demuxed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People, auctions and bids of events(), each with its own columns; other columns are not computed."""
    parts = routed(rows, person=F.col("kind") == "person", auction=F.col("kind") == "auction", bid=F.col("kind") == "bid")
    return tuple(parts[k].select(f"{k}.*") for k in ("person", "auction", "bid"))


def channel_id(n: Column) -> Column:
    """The absolute value of the 32 bits of n in reverse order, as a signed number."""
    u = F.conv(F.reverse(F.lpad(F.bin(n), 32, "0")), 2, 10).cast("long")
    return F.when(u >= 1 << 31, (1 << 32) - u).otherwise(u)


def hashtags(numbers: DataFrame, words: list[str], epsilon: float = 0.1, step_ms: int = 10) -> DataFrame:
    """numbers (id) -> word, ts: a walk down the list that stops at each word with a chance of epsilon, from the first
    again after the last; the number of words passed is geometric."""
    passed = F.floor(F.log(1 - uniform(F.col("id"), "walk")) / F.log(F.lit(1 - epsilon))).cast("long") % len(words)
    return numbers.select(F.element_at(F.array(*[F.lit(w) for w in words]), (passed + 1).cast("int")).alias("word"), F.timestamp_millis((F.col("id") * step_ms).cast("long")).alias("ts"))


def pairs(spark: SparkSession, n: int, keys: int, values: int, seed: int = 0) -> DataFrame:
    """n uniform pairs (k, v)."""
    i = F.col("id")
    return spark.range(n).select(below(i, f"k{seed}", keys).alias("k"), below(i, f"v{seed}", values).alias("v"))


def word_ids(spark: SparkSession, n: int, domain: int, preload: bool = True) -> DataFrame:
    """(key, val = 1): every key of the domain once, if preloaded, and n uniform ones."""
    drawn = spark.range(n).select(below(F.col("id"), "key", domain).alias("key"), F.lit(1).cast("long").alias("val"))
    return spark.range(domain).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("val")).union(drawn) if preload else drawn

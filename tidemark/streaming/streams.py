"""Structured Streaming twins of the batch plans.

Sources are folders of files: tables as they are, or replayed in the order of event time, a part per trigger, with a last
row that lets the watermark pass everything (the flush at the end of a stream). Time windows end with the watermark in
append mode; rows later than it are left out. Sinks are Parquet files in the shared folder; nothing is gathered by the
driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import euros
from tidemark.functions.text import ascii_rows
from tidemark.operators.iterate import cut
from tidemark.operators.staging import folder

#: Where the flush of a replayed stream lies: within what pandas times in nanoseconds hold.
END = "2200-01-01"


def instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as timestamps, which watermarks need."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def read(spark: SparkSession, sf_dir: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return instants(reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*"))


def replayed(rows: DataFrame, time: str, parts: int = 4, flush: bool = True) -> DataFrame:
    """Rows as a stream that arrives in the order of time, in so many parts, one per trigger. flush adds a last part with
    one row at END, null in all other columns, that closes every window; rows without a time come first."""
    spark, path = rows.sparkSession, folder(rows.sparkSession, "replay")
    rows = instants(rows)
    seconds = rows.select(F.col(time).cast("double").alias("t"))
    marks = sorted(set(seconds.approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)))
    t = F.coalesce(F.col(time).cast("double"), F.lit(float("-inf")))
    for i, (lo, hi) in enumerate(zip([None, *marks], [*marks, None])):
        part = rows if lo is None else rows.where(t > lo)
        (part if hi is None else part.where(t <= hi)).coalesce(1).write.parquet(f"{path}/{i:04d}")
    if flush:
        last = [F.lit(END).cast("timestamp").alias(time) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        spark.range(1).select(*last).coalesce(1).write.parquet(f"{path}/{len(marks) + 1:04d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def open_loop(spark: SparkSession, per_second: int, domain: int) -> DataFrame:
    """(key, val = 1, ts): uniform word ids that come by the clock, whether or not earlier ones are done."""
    from tidemark.sources.generators import below

    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(below(F.col("value"), "key", domain).alias("key"), F.lit(1).cast("long").alias("val"), F.col("timestamp").alias("ts"))


class Session:
    """Rows with a signed multiplicity, handed over by the driver: update() adds some at the present time, advance_to() sends
    them on and moves the time, close() sends the rest and gives the stream (columns, diff, time), a time per trigger."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.path = spark, schema, folder(spark, "session")
        self.time, self.rows, self.parts = 0, [], 0

    def update(self, rows: list[tuple], diff: int = 1) -> None:
        self.rows += [(*r, diff, self.time) for r in rows]

    def advance_to(self, time: int) -> None:
        if time < self.time:
            raise ValueError("time does not go back")
        if self.rows:
            self.spark.createDataFrame(self.rows, f"{self.schema}, diff long, time long").coalesce(1).write.parquet(f"{self.path}/{self.parts:06d}")
            self.rows, self.parts = [], self.parts + 1
        self.time = time

    def close(self) -> DataFrame:
        self.advance_to(self.time)
        return self.spark.readStream.schema(f"{self.schema}, diff long, time long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(self.path)


def run(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, progress: list | None = None) -> DataFrame:
    """The rows of a stream's sink after all of its present input. append: all rows; complete: the result table of the last
    trigger; update: the last row of each of the keys, each update taking the place of the one before. progress takes the
    reports of the triggers."""
    spark = stream.sparkSession
    path = folder(spark, "sink")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", folder(spark, "query"))
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/trigger={n}")).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if progress is not None:
        progress += query.recentProgress
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(path)
    names = [f"{f.name} {f.dataType.simpleString()}" for f in stream.schema]
    rows = spark.read.schema(", ".join([*names, "trigger long"])).parquet(path)
    if mode == "complete":
        return rows.join(rows.agg(F.max("trigger").alias("trigger")), "trigger", "left_semi").drop("trigger")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("trigger", *values)).alias("last")).select(*keys, *[f"last.{c}" for c in values])


def to_ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ascii_rows(read(spark, sf_dir, "documents"), F.col("text"))
    return run(words.groupBy("word").agg(F.count("*").alias("n")), "complete")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.col("l_shipdate").alias("date_time"))


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_ntz(run(bids(spark, sf_dir).withColumn("price", euros(F.col("price")))), "date_time")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(bids(spark, sf_dir).where("auction % 123 = 0").select("auction", "price"))


def local_items(spark: SparkSession, sf_dir: str, states: tuple[str, ...]) -> DataFrame:
    """A stream of auctions joined with people, a table."""
    from tidemark.sources.tables import person

    a = read(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("auction"), F.col("o_custkey").alias("seller"))
    p = person(spark, sf_dir).where(F.col("state").isin(*states))
    return run(a.join(p, F.col("seller") == F.col("id")).select("name", "city", "state", "auction"))


def hot_items(spark: SparkSession, sf_dir: str, size: str, slide: str) -> DataFrame:
    """Counts per window and item, and of each window the best, both in the stream."""
    e = replayed(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("user_id").alias("item")), "ts").withWatermark("ts", "0 seconds")
    n = e.groupBy(F.window("ts", size, slide).alias("w"), "item").agg(F.count("*").alias("n"))
    best = run(n.groupBy("w").agg(F.max(F.struct("n", "item")).alias("b")))
    return to_ntz(best.select(F.col("w.start").alias("window_start"), "b.item", "b.n"), "window_start")


def top_words(spark: SparkSession, sf_dir: str, size: str, slide: str, most: int = 5) -> DataFrame:
    """The most frequent words of each window: counts and the ordered head of each window's list, both in the stream."""
    words = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("word"), "ts")
    e = replayed(words, "ts").withWatermark("ts", "0 seconds")
    n = e.groupBy(F.window("ts", size, slide).alias("w"), "word").agg(F.count("*").alias("n"))
    lists = n.groupBy("w").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word"))), 1, most).alias("top"))
    rows = run(lists).select(F.col("w.end").alias("window_end"), F.posexplode("top").alias("at", "x"))
    return to_ntz(rows.select("window_end", "x.word", (-F.col("x.minus")).alias("n"), (F.col("at") + 1).cast("long").alias("rank")), "window_end")


def highest_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import bid

    b = replayed(bid(spark, sf_dir), "date_time").withWatermark("date_time", "0 seconds")
    rows = run(b.groupBy(F.window("date_time", "1 day").alias("w")).agg(F.min(F.struct((-F.col("price")).alias("p"), "auction", "bidder")).alias("b")))
    return to_ntz(rows.select(F.col("w.start").alias("window_start"), "b.auction", "b.bidder", (-F.col("b.p")).alias("price")), "window_start")


def new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined on key and day."""
    e = read(spark, sf_dir, "events")
    new = e.where("event_type = 'signup'").withWatermark("ts", "1 day").select(F.col("user_id").alias("id"), F.window("ts", "1 day").alias("w"), F.col("event_id").alias("signup"))
    sold = e.where("event_type = 'purchase'").withWatermark("ts", "1 day").select("user_id", F.window("ts", "1 day").alias("w"), F.col("event_id").alias("purchase"), "value")
    return run(new.join(sold, (F.col("id") == F.col("user_id")) & (new["w"] == sold["w"])).select("id", "signup", "purchase", "value"))


def new_users_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    new = e.where("event_type = 'signup'").select(F.col("user_id").alias("id"), F.col("ts").alias("since"), F.col("event_id").alias("signup")).withWatermark("since", "1 day")
    sold = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"), "value").withWatermark("ts", "1 day")
    return run(new.join(sold, F.expr("id = user_id AND ts >= since AND ts < since + INTERVAL 10 HOURS")).select("id", "signup", "purchase", "value"))


def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last count of each key: an update takes the place of what a key had, the place of retractions."""
    e = replayed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", flush=False)
    return run(e.groupBy("user_id").agg(F.count("*").alias("n")), "update", ["user_id"])


def state_machine(stream: DataFrame, key: str, value: Column, drop_at: int | None = None) -> DataFrame:
    """Keyed running sums in a state of one number: (key, order, total) after every row, rows of a batch by order. A
    state goes once its sum reaches drop_at."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("order")
        total = (state.get[0] if state.exists else 0) + rows["value"].cumsum()
        last = int(total.iloc[-1])
        if drop_at is not None and last >= drop_at:
            state.remove()
        else:
            state.update((last,))
        yield pd.DataFrame({key: k[0], "order": rows["order"].to_numpy(), "total": total.to_numpy()})

    rows = stream.select(key, "order", value.cast("long").alias("value"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, order long, total long", "total long", "append", GroupStateTimeout.NoTimeout)


def running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each event the cents of its user so far; events are in the order of their ids in a batch."""
    e = read(spark, sf_dir, "events").withColumn("order", F.col("event_id"))
    rows = run(state_machine(e, "user_id", F.round(F.col("value") * 100)))
    return rows.select(F.col("order").alias("event_id"), "user_id", "total")


def keyed(stream: DataFrame, key: str, fold, out: str, state: str, due=None) -> DataFrame:
    """A keyed stateful operator. fold(key, rows, state) -> (result rows, new state) gets the rows of a key in a trigger
    as dicts, and its state as a tuple (None at first); a new state of None drops it. due(state) gives the time in ms at
    which the key is to be notified, or None; it is then folded with no rows once the watermark has passed that time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.strip().split()[0] for c in out.split(",")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = [] if held.hasTimedOut else [r for b in batches for r in b.to_dict("records")]
        result, after = fold(k[0], rows, held.get if held.exists else None)
        if after is None:
            if held.exists:
                held.remove()
        else:
            held.update(after)
            at = due(after) if due else None
            if at is not None:
                held.setTimeoutTimestamp(max(int(at), held.getCurrentWatermarkMs() + 1))
        if result:
            yield pd.DataFrame(result, columns=names)

    return stream.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout if due else GroupStateTimeout.NoTimeout)


def two_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two inputs of one keyed operator: their rows with a side (0 or 1) and nulls in the other side's columns."""
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)


def latest_left(stream: DataFrame, key: str, left: str, right: str, kinds: tuple[str, str]) -> DataFrame:
    """two_sided() rows (key, side, order, left, right) -> (key, left, right): a right row meets the latest left row of its
    key; those that come before any wait and leave once, with the first."""

    def fold(k, rows, held):
        latest, waiting = held if held else (None, [])
        waiting, out = list(waiting), []
        for r in sorted(rows, key=lambda r: (r["order"], r["side"])):
            if r["side"] == 0:
                latest = r[left]
                out += [(k, latest, w) for w in waiting]
                waiting = []
            elif latest is None:
                waiting.append(r[right])
            else:
                out.append((k, latest, r[right]))
        return out, (latest, waiting)

    kind = stream.schema[key].dataType.simpleString()
    return keyed(stream, key, fold, f"{key} {kind}, {left} {kinds[0]}, {right} {kinds[1]}", f"latest {kinds[0]}, waiting array<{kinds[1]}>")


def grouped(stream: DataFrame, key: str, groups: int, fold, out: str, due: bool = False) -> DataFrame:
    """keyed() for many small keys: a state holds all keys of one of so many groups, as an Arrow table, and a trigger folds
    whole tables. fold(rows, held, watermark in ms) -> (result rows, state or None, time in ms of the next notice or
    None) gets and gives data frames; rows and held are None where there are none, as rows are at a notice."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.strip().split()[0] for c in out.split(",")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = None if state.hasTimedOut else pd.concat(list(batches)).drop(columns="tm_group")
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        mark = state.getCurrentWatermarkMs() if due else 0
        result, after, at = fold(rows, held, mark)
        if after is None or not len(after):
            if state.exists:
                state.remove()
        else:
            table = pa.Table.from_pandas(after, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            if at is not None:
                state.setTimeoutTimestamp(max(int(at), mark + 1))
        if len(result):
            yield result[names]

    dealt = stream.withColumn("tm_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    return dealt.groupBy("tm_group").applyInPandasWithState(step, out, "held binary", "append", GroupStateTimeout.EventTimeTimeout if due else GroupStateTimeout.NoTimeout)


#: Groups that auctions and sellers are dealt to: a state holds a group's.
GROUPS = 512


def closed_auctions(stream: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(auction, kind, ts, at_ms, ...) rows of both sides of an auction stream -> the winner of each auction once the
    watermark passes its end: bids wait in the state until then, for auctions that are still to come too, as long as
    these may come with a time at or before the bid's. An auction is open from its time on and before it expires. Of an
    auction that is there only the bid that wins so far is kept."""
    terms = {"opened": "at_ms", "expires": "expires_ms", "reserve": "reserve", "seller": "seller", "category": "category"}

    def fold(rows, held, mark):
        parts = [] if held is None else [held]
        if rows is not None:
            parts.append(rows.loc[rows["kind"].isin(("auction", "bid")), ["auction", "kind", *dict.fromkeys(["at_ms", *terms.values()]), "price", "bidder"]])
        every = pd.concat(parts)
        kinds = every["kind"] == "auction"
        known = every[kinds].drop_duplicates("auction", keep="last")
        bids = every.loc[~kinds, ["auction", "at_ms", "price", "bidder"]]
        of = known[["auction", *dict.fromkeys(terms.values())]].rename(columns={v: k for k, v in terms.items()})
        met = bids.merge(of, on="auction")
        met = met[(met["opened"] <= met["at_ms"]) & (met["at_ms"] < met["expires"]) & (met["price"] >= met["reserve"])]
        best = met.sort_values(["price", "at_ms", "bidder"], ascending=[False, True, True]).drop_duplicates("auction")
        over = best["expires"] < mark
        waiting = bids[(bids["at_ms"] > mark) & ~bids["auction"].isin(known["auction"])]
        kept = best.loc[~over, ["auction", "at_ms", "price", "bidder"]]
        open_ = known[known["expires_ms"] >= mark]
        after = pd.concat([open_, pd.concat([kept, waiting]).assign(kind="bid", **{c: 0 for c in dict.fromkeys(terms.values()) if c != "at_ms"})])
        at = open_["expires_ms"].min() if len(open_) else None
        return best[over].rename(columns={"expires": "expires_ms"}), after, at

    return grouped(stream, "auction", groups, fold, "auction long, seller long, category int, expires_ms long, bidder long, price long", due=True)


def auction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auctions and bids as the rows that closed_auctions() takes, in the order of their times and flushed."""
    from tidemark.sources.tables import auction, bid

    a = auction(spark, sf_dir).select(F.col("id").alias("auction"), F.lit("auction").alias("kind"), F.col("date_time").alias("ts"), F.unix_millis(F.col("expires").cast("timestamp")).alias("expires_ms"), "reserve", "seller", "category")
    b = bid(spark, sf_dir).select("auction", F.lit("bid").alias("kind"), F.col("date_time").alias("ts"), "price", "bidder")
    both = a.unionByName(b, allowMissingColumns=True).fillna(0)
    rows = replayed(both, "ts").withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", "0 seconds")
    return rows.withColumns({"auction": F.coalesce("auction", F.lit(-1)), "kind": F.coalesce("kind", F.lit("flush"))}).fillna(0)  # not a filter, which would go before the watermark


def won_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(closed_auctions(auction_rows(spark, sf_dir)))
    return rows.select("auction", "seller", "category", F.timestamp_millis("expires_ms").cast("timestamp_ntz").alias("expires"), "bidder", "price")


def _again(rows: DataFrame) -> DataFrame:
    """The files of a sink as a stream."""
    paths = {f.rsplit("/", 1)[0] for f in rows.inputFiles()}
    return rows.sparkSession.readStream.schema(rows.schema).parquet(*paths) if paths else None


def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean winning price per category, updated as auctions close."""
    closed = run(closed_auctions(auction_rows(spark, sf_dir)))
    return run(_again(closed).groupBy("category").agg(F.avg("price").alias("avg_price")), "update", ["category"])


def last_means(closed: DataFrame, last: int, groups: int = GROUPS) -> DataFrame:
    """(seller, auction, avg_price) of rows (seller, auction, expires_ms, price) as they come: the mean of the seller's last
    prices after each, in a state of so many prices a seller."""

    def fold(rows, held, mark):
        rows = rows[["seller", "auction", "expires_ms", "price"]].sort_values(["expires_ms", "auction"]).assign(new=True)
        every = rows if held is None else pd.concat([held.assign(new=False), rows])
        every = every.sort_values("seller", kind="stable").reset_index(drop=True)
        at, total = every.groupby("seller").cumcount(), every.groupby("seller")["price"].cumsum()
        gone = total.groupby(every["seller"]).shift(last).fillna(0).astype("int64")
        means = every.assign(avg_price=(total - gone) / (at + 1).clip(upper=last))
        after = every.groupby("seller").tail(last)[["seller", "auction", "expires_ms", "price"]]
        return means[every["new"]], after, None

    return grouped(closed, "seller", groups, fold, "seller long, auction long, avg_price double")


def seller_means(spark: SparkSession, sf_dir: str, last: int = 10) -> DataFrame:
    """The mean of a seller's last winning prices after each closed auction."""
    closed = run(closed_auctions(auction_rows(spark, sf_dir)))
    return run(last_means(_again(closed), last))


def snapshot(df: DataFrame) -> DataFrame:
    """A sink's rows, kept apart from the stream that fills it."""
    return cut(df)

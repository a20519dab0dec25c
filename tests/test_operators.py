"""Fixtures with known results for graphs, windows, control messages, multisets and sources."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.operators import clusters, control, graphs, multisets, sinks, stars, windows
from tidemark.sources import files, generators
from tidemark.streaming import streams

# Sample graphs.
COMPONENTS = [(1, 2), (2, 3), (2, 4), (3, 5), (6, 7), (8, 9), (8, 10), (5, 11), (11, 12), (10, 13), (9, 14), (13, 14), (1, 15), (16, 1)]
TRIANGLES = [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 5), (3, 4), (3, 7), (3, 8), (5, 6), (7, 8)]


def frame(spark, rows, schema="u long, v long"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_components(spark):
    got = dict(rows(graphs.components(frame(spark, COMPONENTS), spark.range(1, 18).select(F.col("id").alias("node")))))
    assert got == {n: 1 for n in (1, 2, 3, 4, 5, 11, 12, 15, 16)} | {6: 6, 7: 6} | {n: 8 for n in (8, 9, 10, 13, 14)} | {17: 17}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_star_contraction(spark):
    import random

    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 800)] + [(3, 3)]
    got = dict(rows(stars.components(spark, spark.createDataFrame([*links, (None, 1)], "a long, b long"))))
    want = roots({n for e in links for n in e}, links)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in links)}
    assert set(r for n, r in got.items() if n >= 300) == {300}  # a path of 500 steps has one label
    assert stars.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_staging_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from tidemark.operators import staging

    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.work_dir(Elsewhere)


def test_staging_leaves_no_shuffle_files(spark):
    """Shuffle files of a staged table's plan go with its write, while something still refers to the plan."""
    import time

    from tidemark.operators.staging import stage

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    assert stage(spark, df, "left").count() == 7
    left = files() - before
    for _ in range(50):
        if not (left := left & files()):
            break
        time.sleep(0.2)
    assert not [f for f in left if f.endswith(".data")] and df.count() == 7


def test_closure(spark):
    assert graphs.closure(frame(spark, COMPONENTS)).count() == 35
    assert rows(graphs.closure(frame(spark, [(1, 2), (2, 1)]), loops=True)) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_closure_of_cycles(spark, monkeypatch):
    """Pairs by brute force in any kind of graph; those of a cycle are not staged one by one."""
    rng, staged = random.Random(5), []
    whole = graphs.cut
    for nodes, n in ((12, 18), (40, 44), (9, 40)):
        pairs = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)})
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
            reach |= more
        assert rows(graphs.closure(frame(spark, pairs), loops=True)) == sorted(reach)
        assert rows(graphs.closure(frame(spark, pairs))) == sorted(p for p in reach if p[0] != p[1])
    monkeypatch.setattr(graphs, "cut", lambda df: staged.append(whole(df)) or staged[-1])
    monkeypatch.setattr("tidemark.operators.iterate.cut", graphs.cut)
    monkeypatch.setattr(graphs, "CHUNK", 7)
    ring = [(i, (i + k) % 100) for i in range(100) for k in (1, 10, 31)] + [(i + 1000, i % 100) for i in range(300)]
    got = graphs.closure(frame(spark, ring))
    assert got.count() == got.distinct().count() == 100 * 99 + 300 * 100
    assert max(df.count() for df in staged) <= len(ring)


def test_closure_of_many_sources(spark, monkeypatch):
    """What nodes that no edge leads to can reach is not staged; pairs by brute force, from lists, rows and blocks of pairs."""
    rng, staged, whole = random.Random(7), [], graphs.cut
    pairs = {(1000 + i, rng.randrange(40)) for i in range(200) for _ in range(5)} | {(m, 100 + rng.randrange(40)) for m in range(40) for _ in range(6)}
    pairs = sorted(pairs | {(100, 101), (101, 100), (102, 102), (2000, 2000)})
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    monkeypatch.setattr(graphs, "cut", lambda df: staged.append(whole(df)) or staged[-1])
    monkeypatch.setattr("tidemark.operators.iterate.cut", graphs.cut)
    for limits in ({}, {"SENT": 60, "LIST": 30}):
        for name, value in limits.items():
            monkeypatch.setattr(graphs, name, value)
        assert rows(graphs.closure(frame(spark, pairs), loops=True)) == sorted(reach)
        assert len(reach) > 4 * len(pairs) and max(df.count() for df in staged) <= len(pairs)


def test_triangles(spark):
    assert rows(graphs.triangles(frame(spark, TRIANGLES + [(2, 1), (3, 3)]))) == [(1, 2, 3), (1, 2, 5), (1, 3, 4), (3, 7, 8)]


def plain_rank(edges, rounds, d=0.85):
    nodes = sorted({n for e in edges for n in e})
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        new = {n: (1 - d) / len(nodes) for n in nodes}
        for u, v in edges:
            new[v] += d * r[u] / sum(1 for a, _ in edges if a == u)
        r = new
    return r


def test_pagerank(spark):
    want = plain_rank(COMPONENTS, 7)
    for node, rank in rows(graphs.pagerank(frame(spark, COMPONENTS), 7)):
        assert rank == pytest.approx(want[node], abs=1e-12)
    loop = [(1, 2), (2, 3), (3, 1), (1, 3)]
    settled = dict(rows(graphs.pagerank(frame(spark, loop), 200, tolerance=1e-8)))
    assert sum(settled.values()) == pytest.approx(1.0, abs=1e-6)


def test_whole_pagerank(spark):
    nodes = sorted({n for e in TRIANGLES for n in e})
    r = dict.fromkeys(nodes, 6_000_000)
    for _ in range(4):
        new = dict.fromkeys(nodes, 1_000_000)
        for u, v in TRIANGLES:
            new[v] += r[u] * 5 // (6 * sum(1 for a, _ in TRIANGLES if a == u))
        r = new
    assert dict(rows(graphs.whole_pagerank(frame(spark, TRIANGLES), 4))) == r


def test_allotted(spark):
    got = rows(graphs.allotted(frame(spark, [(1, 5), (1, 6), (1, 7), (2, 9)]), spark.createDataFrame([(1, 8), (2, 3)], "u long, amount long")))
    assert got == [(1, 5, 3), (1, 6, 3), (1, 7, 2), (2, 9, 3)]


@pytest.mark.parametrize("n, slide, flush", [(1, 0, 1), (4, 0, 1), (5, 1, 1), (6, 1, 2), (10, 2, 2), (11, 2, 3), (16, 3, 4), (25, 5, 5)])
def test_count_windows(spark, n, slide, flush):
    w = spark.range(n).select(F.lit("w").alias("word"))
    assert windows.count_windows(w, "word").count() == slide
    got = windows.count_windows(w, "word", flush=True).orderBy("fire").collect()
    assert len(got) == flush and [r["n"] for r in got] == [min(10, n - 5 * i) for i in range(flush)]


def test_running_sum_does_not_depend_on_placement(spark):
    want = sorted([(0, 0), (0, 2), (0, 6), (0, 12), (0, 20), (1, 1), (1, 4), (1, 9), (1, 16), (1, 25)])
    base = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("round"))
    for placed in (base, base.repartition(7, "round"), base.coalesce(1), base.repartition(1 << 5, F.xxhash64("k"))):
        assert rows(placed.select("k", windows.running_sum(placed, "k", ["round"], F.col("round")))) == want


def test_control(spark):
    kind = "sequence long, kind string, map array<int>, bin int, worker int"
    c = spark.createDataFrame([(1, "map", [0, 1, 0, 1], None, None), (2, "move", None, 3, 7), (3, "none", None, None, None), (4, "move", None, 3, 2), (5, "move", None, 0, 5)], kind)
    assert rows(control.folded(c, 2)) == [(0, 5), (1, 1), (2, 0), (3, 2)]
    control.checked(c, 2)
    with pytest.raises(ValueError):
        control.checked(c.union(c.limit(1)), 2)
    with pytest.raises(ValueError):
        control.checked(c, 3)


def test_migration_plans():
    assert control.halved(3, 4) == [0, 2, 2, 0, 0, 2, 2, 0] and control.skewed(3, 4) == [0, 2, 2, 0, 0, 1, 2, 3]
    for a, b in ((control.spread(4, 4), control.halved(4, 4)), (control.halved(5, 8), control.skewed(5, 8)), (control.spread(3, 4), control.spread(3, 4))):
        for kind in ("sudden", "fluid", "batched"):
            now, steps = list(a), control.plan(a, b, kind)
            for step in steps:
                if kind == "batched":
                    assert len({now[x] for x, _ in step}) == len(step) == len({w for _, w in step})
                for x, w in step:
                    now[x] = w
            assert now == b
            if kind == "batched" and a != b:  # as few steps as the busiest worker has bins to send or to get
                moved = [(o, n) for o, n in zip(a, b) if o != n]
                assert len(steps) >= max(max(sum(o == w for o, _ in moved), sum(n == w for _, n in moved)) for w in range(8))


def test_matching_is_a_largest_one():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(60):
        edges = {s: sorted({rng.randrange(5) for _ in range(rng.randint(1, 3))}) for s in range(rng.randint(1, 5))}
        got = control.matching(edges)
        assert all(r in edges[s] for s, r in got.items()) and len(set(got.values())) == len(got)
        most = max(len({r for r in pick if r is not None}) for pick in itertools.product(*[[None, *v] for v in edges.values()]) if len([r for r in pick if r is not None]) == len({r for r in pick if r is not None}))
        assert len(got) == most


def test_placed(spark):
    """Every key lies in one bin, and a bin on one worker, however rows are partitioned."""
    bins = spark.createDataFrame(list(enumerate(control.spread(3, 3))), "bin int, worker int")
    for df in (spark.range(200), spark.range(200).repartition(7)):
        got = rows(control.placed(df.withColumn("k", F.col("id") % 20), F.col("k"), 3, bins))
        assert len({(r[1], r[2], r[3]) for r in [(0, x[2], x[0], x[3]) for x in got]}) == 20
        assert all(x[3] == x[0] % 3 and 0 <= x[0] < 8 for x in got)


def test_plan_file(spark, tmp_path):
    (tmp_path / "plan").write_text("M 0 0 1 0 1\nD 5 3 2 1 9\n")
    assert rows(control.folded(control.plan_lines(spark, str(tmp_path / "plan")), 2)) == [(0, 0), (1, 9), (2, 0), (3, 2)]


def test_multisets(spark):
    d = spark.createDataFrame([("a", 2), ("a", -2), ("b", 3), ("c", -1)], "x string, diff long")
    assert rows(multisets.consolidated(d)) == [("b", 3), ("c", -1)]
    assert rows(multisets.distinct(d)) == [("b", 1)]
    assert rows(multisets.consolidated(d.union(multisets.negated(d)))) == []
    keys = spark.createDataFrame([("b", 2), ("b", 1), ("c", 1)], "x string, diff long")
    assert rows(multisets.semijoined(multisets.consolidated(d), keys, ["x"])) == [("b", 9), ("c", -1)]


@pytest.mark.parametrize("limit, want", [(10, (19, 9)), (100, (118, 97)), (1000, (178, 871))])
def test_collatz(spark, limit, want):
    got = spark.range(1, limit).select(F.struct(numbers.collatz_steps("id"), "id").alias("s")).agg(F.max("s")).first()[0]
    assert tuple(got) == want


def test_kmeans(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 10.0), (2, 0.0, 1.0), (3, 10.0, 11.0)], "id long, x double, y double")
    assert clusters.kmeans(p, 2, 10, 0.1) == [(0.0, 0.5), (10.0, 10.5)]
    assert clusters.kmeans(p.limit(0), 2, 3) == []


def test_expressions(spark):
    one = spark.range(1)
    assert one.select(text.ascii_words(F.lit("Hello wörld-foo_1"))).first()[0] == ["hello", "w", "rld", "foo"]
    assert one.select(text.spaced_words(F.lit(" A  bÉ\tc "))).first()[0] == ["a", "bé", "c"]
    assert one.select(text.week(F.to_date(F.lit("2012-12-31")))).first()[0] == 52
    assert one.select(numbers.euros(F.lit(1000))).first()[0] == 908
    assert one.select(generators.channel_id(F.lit(1).cast("long"))).first()[0] == 1 << 31
    assert one.select(numbers.slice_end(F.lit(17), 5)).first()[0] == 20


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("1,2\n3,4\n")
    assert rows(files.edge_file(spark, str(tmp_path / "e.csv"))) == [(1, 2), (3, 4)]
    assert rows(files.edge_file(spark, str(tmp_path / "e.csv"), header=True)) == [(3, 4)]
    assert rows(files.records(spark, str(tmp_path / "e.csv"), files.POINT, first=1, order="x")) == [(1.0, 2.0)]
    (tmp_path / "v").write_text("1 2\n3\n")
    assert rows(files.vertex_file(spark, str(tmp_path / "v"))) == [(1,), (2,), (3,)]
    (tmp_path / "a.csv").write_text('"DATE","BOROUGH","KILLED","F1"\n"1/2/2013","X, Y","1","speed"\n')
    got = files.accident_file(spark, str(tmp_path / "a.csv"), {"DATE": "date", "BOROUGH": "borough", "KILLED": "killed", "F1": "factor1"}).first()
    assert str(got["date"]) == "2013-01-02" and got["borough"] == "X, Y" and got["killed"] == 1


def test_lines_and_counted_records(spark, tmp_path):
    (tmp_path / "t").write_text("a b\nc\n")
    assert rows(files.lines(spark, str(tmp_path / "t"))) == [("a b",), ("c",)]
    assert rows(files.lines(spark, str(tmp_path / "t"), whole=True)) == [("a b\nc\n",)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x").write_text("a\nb\n")
    assert rows(streams.run(files.line_stream(spark, str(tmp_path / "s"), 1))) == [("a",), ("b",)]
    (tmp_path / "c.csv").write_text("3\n1,2\n,\n5,\n")
    assert rows(files.counted_records(spark, str(tmp_path / "c.csv"), files.PAIR).na.fill(-1)) == [(-1, -1), (1, 2), (5, -1)]
    cut = spark.createDataFrame([("é" * 20,), ("abc",)], "w string").select(text.cut_words(F.col("w"), 35).cast("binary").alias("b"), "w")
    assert {r["w"]: bytes(r["b"]) for r in cut.collect()} == {"é" * 20: ("é" * 20).encode()[:35], "abc": b"abc"}


def test_generators(spark):
    a, b = generators.events(spark.range(1000)), generators.events(spark.range(1000).repartition(9))
    assert sinks.verified(a, b)
    assert {r["kind"]: r["count"] for r in a.groupBy("kind").count().collect()} == {"person": 20, "auction": 60, "bid": 920}
    assert a.where("bid is not null AND bid.auction < 1000").count() == 0
    people, auctions, bids = generators.demuxed(a)
    assert (people.count(), auctions.count(), bids.count()) == (20, 60, 920)
    assert people.where("state IN ('AZ', 'CA', 'ID', 'OR', 'WA', 'WY') AND name LIKE '% %' AND abs(length(extra) + 8 + length(name) + length(email_address) + length(credit_card) + length(city) + length(state) - 200) <= 40").count() == 20
    assert auctions.where("length(item_name) = 20 AND length(description) = 100 AND reserve > initial_bid AND expires > date_time").count() == 60
    assert 0.4 < bids.where("channel IN ('Google', 'Facebook', 'Baidu', 'Apple')").count() / 920 < 0.6
    table = generators.channels(spark)
    assert table.count() == generators.CHANNELS + 4 and 0.85 < table.where("url LIKE '%channel_id=%' AND at >= 0").count() / generators.CHANNELS < 0.95
    assert table.where(r"url RLIKE '^https://auctions.example/[a-z_]{3,4}/[a-z_]{3,4}/[a-z_]{3,4}/item.htm[?]query=1(&channel_id=[0-9]+)?$'").count() == generators.CHANNELS + 4
    late = generators.events(spark.range(100), disorder=10).select("n").collect()
    assert [r["n"] for r in late[:10]] == [i * 953 % 10 for i in range(10)] and sorted(r["n"] for r in late) == list(range(100))
    spread = spark.range(20000).select(generators.uniform(F.col("id"), "x").alias("u")).agg(F.avg("u"), F.stddev("u")).first()
    assert abs(spread[0] - 0.5) < 0.01 and abs(spread[1] - 12**-0.5) < 0.01
    assert generators.word_ids(spark, 50, 20).groupBy("key").count().count() == 20
    assert generators.hashtags(spark.range(500), ["#a", "#b", "#c"]).where("word = '#a'").count() > 0
    assert generators.pairs(spark, 10, 3, 3).count() == 10


def test_routes(spark):
    got = generators.routed(spark.range(10), low=F.col("id") < 4, even=F.col("id") % 2 == 0)
    assert rows(got["low"]) == [(0,), (1,), (2,), (3,)] and rows(got["even"]) == [(4,), (6,), (8,)]  # 5, 7 and 9 are in none


def test_rates_and_time():
    assert generators.delays(1000, 1000) == [1e6] and generators.delays(1000, 500, "square") == [1e6, 2e6]
    wave = generators.delays(1000, 500)
    assert len(wave) == 10 and wave[0] == 1e6 and wave[5] == 2e6 and wave[1] == wave[9]


def test_time_and_distance_expressions(spark):
    one = spark.range(1)
    assert one.select(numbers.contracted(numbers.dilated(F.lit(7), 60) + 59, 60)).first()[0] == 7
    assert one.select(numbers.elbow(*[F.lit(float(x)) for x in (0, 2, 0, 0, 4, 0)])).first()[0] == 0.5
    assert one.select(numbers.near(F.lit(1.0), F.lit(1.05)), numbers.near(F.lit(1.0), F.lit(1.2))).first()[:] == (True, False)


def test_sources_as_streams(spark):
    """An open loop of word ids by the clock, and a session of signed rows."""
    import time

    query = streams.open_loop(spark, 50, 7).writeStream.format("noop").trigger(processingTime="500 milliseconds").option("checkpointLocation", streams.folder(spark, "loop")).start()
    until = time.time() + 30
    while time.time() < until and not sum(p["numInputRows"] for p in query.recentProgress):
        time.sleep(0.3)
    query.stop()
    assert sum(p["numInputRows"] for p in query.recentProgress) > 0
    session = streams.Session(spark, "x string")
    session.update([("a",), ("b",)])
    session.advance_to(1)
    session.update([("a",)], -1)
    session.update([("c",)], 2)
    reports = []
    got = streams.run(session.close().groupBy("x").agg(F.sum("diff").alias("diff")), "update", ["x"], reports)
    assert rows(got) == [("a", 0), ("b", 1), ("c", 2)]
    flow = rows(sinks.throughput(spark, reports))
    assert [r[1] for r in flow if r[1]] == [2, 2] and flow[-1][4] == 4


def test_watching(spark, capfd):
    import time

    df, seen = sinks.observed(spark.range(10), "watch", F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    assert df.count() == 10 and seen.get == {"n": 10, "top": 9}
    assert sinks.printed(spark.range(3), 2).count() == 3 and "|0  |" in capfd.readouterr().out
    with sinks.Resident(0.01) as r:
        time.sleep(0.1)
    assert len(r.samples) >= 3 and all(size > 0 for _, size in r.samples)
    got = spark.range(1).select(sinks.latency([F.lit(3), F.lit(5)], F.lit(9)), sinks.latency([F.lit(3)], F.lit(9))).first()
    assert tuple(got) == (4, 6)


def test_breakdown(spark):
    """Slices count from the first one a slice behind a control time until latency is down again."""
    p = lambda v: f"1\t{v}\t3\t4\t5\t{v * 2}"
    lines = ["latency_ccdf\t10\t0.9", "latency_ccdf\t20\t0.6", "latency_ccdf\t30\t0.1", "control_time\t250", "control_time\t900", "migration_done\t300\t40", "migration_done\t310\t70"]
    lines += [f"summary_timeline\t{t}\t{p(v)}" for t, v in ((100, 90), (200, 95), (300, 5), (400, 50), (500, 60), (600, 7), (700, 99), (800, 3), (900, 2), (1000, 41), (1100, 40))]
    got = sinks.breakdown(sinks.log_lines(spark.createDataFrame([(x,) for x in lines], "value string"))).first().asDict()
    assert got == {"median": 20, "duration": 300, "most_p0": 1, "most_p1": 60, "most_p2": 3, "most_p3": 4, "most_p4": 5, "most_p5": 120, "reported": 110, "reported_most": 70}


def test_latency_sinks(spark, tmp_path):
    lat = spark.range(1, 1001).select(F.timestamp_millis(F.col("id")).alias("ts"), (F.col("id") * 1000).alias("latency_ns"))
    got = sinks.timeline(lat).orderBy("slice_end").collect()
    assert len(got) == 5 and got[-1]["most"] == 1_000_000 and got[0]["p5"] == 125_000
    sinks.centroid_file(spark.createDataFrame([(1.0, 2.0, 3.0, 0.5)], "cx double, cy double, px double, py double"), str(tmp_path / "c"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["1.0000,2.0000,3.0000,0.5000"]


def test_retracted_windows(spark):
    import random

    rng = random.Random(1)
    events = [(rng.choice("ab"), rng.randrange(100)) for _ in range(60)]
    got = rows(windows.retracted(spark.createDataFrame(events, "k string, t long"), "k", 20, 5))
    want = sorted((k, at, n) for k in "ab" for at in range(5, 130, 5) if (n := sum(x == k and at - 20 <= t < at for x, t in events)))
    assert got == want


def test_sinks(spark, tmp_path):
    sinks.sorted_file(spark.createDataFrame([("b", 1), ("a", 2)], "w string, n int"), str(tmp_path / "o"), "w", one=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a,2", "b,1"]
    lat = spark.range(1, 1001).select((F.col("id") * 1000).alias("latency_ns"))
    shares = [r["share"] for r in sinks.ccdf(lat).orderBy("bucket").collect()]
    assert shares == sorted(shares, reverse=True) and shares[-1] == 0
    assert sinks.log_lines(spark.createDataFrame([("summary\t1\t2",)], "value string")).first()["fields"] == ["1", "2"]


def test_closed_auctions(spark, tmp_path):
    """Bids before their auction is known count; one at the very end of an auction, or later, does not."""
    kind = "auction long, kind string, ts timestamp, at_ms long, expires_ms long, reserve long, seller long, category int, price long, bidder long"
    early = [(1, "bid", 500, 0, 0, 0, 0, 70, 9), (1, "auction", 100, 1000, 50, 3, 7, 0, 0), (1, "bid", 1000, 0, 0, 0, 0, 800, 5), (1, "bid", 600, 0, 0, 0, 0, 70, 8), (1, "bid", 700, 0, 0, 0, 0, 20, 7), (1, "bid", 1500, 0, 0, 0, 0, 900, 6)]
    for i, part in enumerate((early, [(2, "auction", 900000, 999000, 1, 4, 7, 0, 0)])):
        df = spark.createDataFrame(part, "auction long, kind string, at_ms long, expires_ms long, reserve long, seller long, category int, price long, bidder long")
        df.withColumn("ts", F.timestamp_millis("at_ms")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    assert rows(streams.run(streams.closed_auctions(stream))) == [(1, 3, 7, 1000, 9, 70)]


def test_auctions_share_states(spark, tmp_path):
    """A state holds many auctions or sellers, over several triggers; each closes once the watermark has passed its end."""
    rng = random.Random(3)
    auctions = {i: (i * 10, i * 10 + rng.choice((40, 5000, 100_000))) for i in range(1, 201)}
    bids = [(a, rng.randrange(auctions[a][0] - 10, auctions[a][0] + 6000), rng.randrange(100), b) for b in range(2000) for a in (rng.choice(list(auctions)),)]
    events = sorted([(a, "auction", o, e, 20, a % 7, 1, 0, 0) for a, (o, e) in auctions.items()] + [(a, "bid", t, 0, 0, 0, 0, p, b) for a, t, p, b in bids], key=lambda r: (r[2], r[1]))
    events.append((-1, "flush", 10**9, 0, 0, 0, 0, 0, 0))
    want = {}
    for a, t, p, b in bids:
        if auctions[a][0] <= t < auctions[a][1] and p >= 20:
            want[a] = min(want.get(a, (0, 0, 0)), (-p, t, b))
    kind = "auction long, kind string, ts timestamp, at_ms long, expires_ms long, reserve long, seller long, category int, price long, bidder long"
    for i in range(4):
        part = events[i * 600 : (i + 1) * 600]
        df = spark.createDataFrame(part, "auction long, kind string, at_ms long, expires_ms long, reserve long, seller long, category int, price long, bidder long")
        df.withColumn("ts", F.timestamp_millis("at_ms")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    progress = []
    got = rows(streams.run(streams.closed_auctions(stream, 3), progress=progress))
    assert got == sorted((a, a % 7, 1, auctions[a][1], b, -p) for a, (p, t, b) in want.items() if p)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 3
    for i in range(3):
        spark.createDataFrame(got[i * 50 : (i + 1) * 50], "auction long, seller long, category int, expires_ms long, bidder long, price long").coalesce(1).write.parquet(str(tmp_path / f"won/{i}"))
    closed = spark.readStream.schema("auction long, seller long, category int, expires_ms long, bidder long, price long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "won"))
    means, held = [], {}
    for i in range(3):
        for a, s, _, _, _, p in sorted(got[i * 50 : (i + 1) * 50], key=lambda r: (r[3], r[0])):
            held[s] = (held.get(s, []) + [p])[-4:]
            means.append((s, a, sum(held[s]) / len(held[s])))
    assert rows(streams.run(streams.last_means(closed, 4, 2))) == sorted(means)


def test_late_rows_and_the_flush(spark):
    """A window closes when the watermark passes it: rows that come later are left out, and the last windows close with
    the flush only."""
    at = lambda *s: spark.createDataFrame([(i,) for i in s], "s long").select(F.timestamp_seconds("s").alias("ts"), F.lit("w").alias("word"))
    first = at(1, 2, 61, 62, 63, 130)
    for flush, want in ((True, [(60, 2), (120, 3), (180, 1)]), (False, [(60, 2), (120, 3)])):
        counts = streams.replayed(first, "ts", 3, flush).withWatermark("ts", "0 seconds").groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n"))
        got = rows(streams.run(counts).select(F.unix_timestamp("w.end"), "n"))
        assert [g for g in got if g in want] == got and (not flush or got == want)
    reports = []
    path = streams.folder(spark, "late")
    for i, part in enumerate((at(1, 2), at(200), at(210), at(3), at(500))):  # 3 comes two triggers behind a watermark of 200
        part.coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path).withWatermark("ts", "0 seconds")
    got = rows(streams.run(stream.groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n")), progress=reports).select(F.unix_timestamp("w.end"), "n"))
    assert got == [(60, 2), (240, 2)]
    assert len(reports) >= 4 and sum(s["numRowsDroppedByWatermark"] for r in reports for s in r["stateOperators"]) == 1


def test_right_rows_wait_for_a_left_one(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 7, "c")], "k long, order long, l string")
    right = spark.createDataFrame([(1, 3, 30), (1, 6, 60), (1, 10, 100), (2, 1, 10), (3, 1, 10)], "k long, order long, r long")
    rows_ = streams.two_sided(left, right, "k").withColumn("ts", F.timestamp_seconds("order"))
    got = streams.run(streams.latest_left(streams.replayed(rows_, "ts", 3, flush=False), "k", "l", "r", ("string", "long")))
    assert rows(got) == [(1, "a", 30), (1, "a", 60), (1, "b", 100), (2, "c", 10)]


def test_update_rows_replace_earlier_ones(spark):
    e = spark.range(100).select((F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("ts"))
    counts = streams.replayed(e, "ts", 4, flush=False).groupBy("k").agg(F.count("*").alias("n"))
    assert rows(streams.run(counts, "update", ["k"])) == [(0, 34), (1, 33), (2, 33)]
    assert rows(streams.run(counts, "complete")) == [(0, 34), (1, 33), (2, 33)]


def test_a_bid_at_the_end_of_an_auction_is_late(spark):
    from tidemark.plans.auctions import winning

    a = spark.sql("SELECT 1L id, 2L seller, 3 category, TIMESTAMP'2020-01-01' date_time, TIMESTAMP'2020-01-02' expires, 5L reserve")
    b = spark.sql("SELECT 1L auction, 7L bidder, 9L price, TIMESTAMP'2020-01-02' date_time UNION ALL SELECT 1, 8, 6, TIMESTAMP'2020-01-01'")
    assert [(r["bidder"], r["price"]) for r in winning(b, a).collect()] == [(8, 6)]


def test_graphs_of_all_orders(spark, sf):
    """The graph queries hold every edge of the table, and what follows from them by brute force."""
    from collections import defaultdict

    from tidemark.plans.graphs import QUERIES, ROUNDS

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    pairs = sorted({(r[0], r[1]) for r in lines if r[0] != r[1]})
    after, near = defaultdict(list), defaultdict(set)
    for u, v in pairs:
        after[u].append(v)
        near[u].add(v)
        near[v].add(u)

    def reached(start, links):
        seen, todo = set(start), list(start)
        while todo:
            todo = [v for u in todo for v in links[u] if v not in seen and not seen.add(v)]
        return seen

    got = lambda name: rows(QUERIES[name](spark, sf))
    assert got("graph_cc") == got("graph_cc_delta") == [(n, min(reached([n], near))) for n in sorted(near)]
    assert got("graph_closure") == sorted((u, v) for u in list(after) for v in reached(after[u], after) if u != v)
    assert got("graph_triangles") == sorted((a, b, c) for a in near for b in near[a] if b > a for c in near[a] & near[b] if c > b)
    rank, whole = {n: 1 / len(near) for n in near}, {n: 6_000_000 for n in near}
    for _ in range(ROUNDS):
        sent, given = defaultdict(float), defaultdict(int)
        for u, v in pairs:
            sent[v] += rank[u] / len(after[u])
            given[v] += whole[u] * 5 // (len(after[u]) * 6)
        rank = {n: 0.15 / len(near) + 0.85 * sent[n] for n in near}
        whole = {n: 1_000_000 + given[n] for n in near}
    assert got("graph_pagerank_int") == sorted(whole.items())
    ranks = dict(got("graph_pagerank"))
    assert set(ranks) == set(rank) and all(abs(ranks[n] - rank[n]) < 2e-8 for n in rank)
    parts = [(u, v, u * 7 % 100 // len(after[u]) + (sorted(after[u]).index(v) < u * 7 % 100 % len(after[u]))) for u, v in pairs]
    assert got("graph_allotted") == parts


def test_loops_that_do_not_settle_are_told(spark):
    """A cap on rounds is an error where it cuts off work; without one there is none."""
    import inspect

    path = frame(spark, [(i, i + 1) for i in range(1, 6)])
    for operator in (graphs.spread_components, graphs.closure):
        assert inspect.signature(operator).parameters["rounds"].default is None
        with pytest.raises(RuntimeError, match="not settled after 2 rounds"):
            operator(path, rounds=2)
    assert [r[1] for r in rows(graphs.components(path))] == [r[1] for r in rows(graphs.spread_components(path))] == [1] * 6
    assert graphs.closure(path, rounds=5).count() == 15

"""The operators against brute force on small tables, with nulls, empty and odd texts, repeated rows, extra columns and
empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, jaccard_join, mixing, pii, quality_classifier, quality_rules, repeats, sentencepieces, token_counts, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, size string, tokens int"


@pytest.fixture(scope="session")
def texts(sf):
    return pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()


def odd_texts(texts):
    rng = random.Random(4)
    base = texts[3]
    words = base.split(" ")
    near = [" ".join(w if i != j else "changed" for i, w in enumerate(words)) for j in (5, 9)]
    return [None, "", " \n\t ", "one", "one two three", "ONE two three", base, base, base.upper(), *near, "a" * 5000, "ab" * 700, "x " * 900, "é日😀 " * 60, texts[0] + "\n" + texts[1], texts[1] * 2, "".join(rng.choice("ab \n") for _ in range(3000)), *texts[:25]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Odd and plain texts, null keys left out, columns that operators use for themselves, and two repeated rows."""
    odd = odd_texts(texts)
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), 1, "x", 2) for i, t in enumerate(odd)]
    return spark.createDataFrame(rows + rows[6:8], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=str)


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


# 1. URL filter


def judged_url(url, weights):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url) if url else None
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(v, r) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return (host, path, *(max(fits, key=lambda x: len(x[1]))[::-1] if fits else (None, None)))


def test_url_filter(spark, sf):
    odd = [None, "", "nourl", "HTTP://WWW.Example.ORG/es/1?x", "https://a.example.org/en/12#y", "x://org", "x://org/", "http://myorg/", "a://b://c/d", "http://É.com/fr/", "http://h.com/de", "http://h.com/de/x", "http://" + "a" * 5000 + "/p"]
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(odd)], "page_id long, url string, html string, host string").union(spark.read.parquet(f"{sf}/pages.parquet").withColumn("host", F.lit("z")))
    got = url_filter.judged(spark, pages).collect()
    urls = {r["page_id"]: r["url"] for r in pages.collect() if r["page_id"] >= len(odd)} | dict(enumerate(odd))
    seen = {r["page_id"]: r for r in got if r["page_id"] >= len(odd) or urls[r["page_id"]] not in urls.values()} or {}
    for r in got:
        options = [judged_url(u, None) for u in ([odd[r["page_id"]]] if r["page_id"] < len(odd) else []) + [urls[r["page_id"]]]] + [judged_url(x["url"], None) for x in pages.where(F.col("page_id") == r["page_id"]).collect()] if r["page_id"] < len(odd) else [judged_url(urls[r["page_id"]], None)]
        assert (r["host"], r["path"], r["rule"]) in [o[:3] for o in options]
        rule = next(o for o in options if o[:3] == (r["host"], r["path"], r["rule"]))
        assert r["verdict"] == (rule[3] or ("block" if r["score"] >= 0.5 else "allow"))
    assert len(got) == pages.count() and seen is not None
    assert url_filter.judged(spark, pages.limit(0)).count() == 0


def test_url_model_learns(spark):
    """The weights of the dual descent are those of plain gradient descent on the features."""
    table = url_filter.labelled(spark).limit(30)
    host, path = url_filter.split(F.col("url"))
    rows = url_filter.features(table.select("url", "label", host.alias("host"), path.alias("path"))).collect()
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for i, r in enumerate(rows):
        for b in r["buckets"]:
            x[i, b] += len(r["buckets"]) ** -0.5
    y, w, bias = np.array([float(r["label"]) for r in rows]), np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(40):
        e = y - 1 / (1 + np.exp(-(x @ w + bias)))
        w, bias = w * (1 - 0.5 * 0.001) + 0.5 * x.T @ e, bias + 0.5 * e.mean()
    got = url_filter.trained(spark, table, rounds=40)
    assert np.allclose(got[:-1], w, atol=1e-9) and got[-1] == pytest.approx(bias)
    assert url_filter.trained(spark, table.limit(0)) == [0.0] * (url_filter.BUCKETS + 1)


def test_url_score_is_the_models(spark):
    """The score is recomputed from the weights and the n-grams' buckets, and tells hosts apart that the labelled table
    does not hold; no host of the table is one of those judged."""
    wanted = ["https://riverschool.example.net/a", "https://www.gardenjournal.example.com/x/1", "http://mountain-weather.example.org/q", "https://forest-history.example.net/2019"]
    unwanted = ["https://big-casinos.example.net/a", "https://www.pokerjackpots.example.net/x/1", "http://cheappills24.example.net/q", "https://free-betting-bonus.example.net/2019"]
    table = {r["url"].split("/")[2] for r in url_filter.labelled(spark).collect()}
    urls = [*wanted, *unwanted, None, "no url", "x://"]
    assert not any(u.split("/")[2] in table for u in wanted + unwanted)
    weights = url_filter.trained(spark, url_filter.labelled(spark))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judged(spark, pages).collect()}
    for i, u in enumerate(urls):
        host, path = (u.split("://")[1].split("/")[0], "/" + u.split("://")[1].partition("/")[2]) if u and "/" in (u.split("://") + [""])[1] else ("", "")
        grams = [t[k : k + n] for t in (f"^{host}$", f"|{path}$") for n in (3, 4) for k in range(len(t) - n + 1)]
        buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(url_filter.BUCKETS))).collect()] if grams else []
        want = 1 / (1 + np.exp(-(weights[-1] + sum(weights[b] for b in buckets) / max(len(buckets), 1) ** 0.5)))
        assert rows[i]["score"] == pytest.approx(want, abs=1e-9)
    assert all(rows[i]["score"] < 0.5 for i in range(4)) and all(rows[i]["score"] >= 0.5 for i in range(4, 8))


def test_url_table_is_bounded(spark):
    many = spark.range(url_filter.TABLE + 1).select(F.concat(F.lit("http://h"), F.col("id").cast("string")).alias("url"), F.lit(1).alias("label"))
    with pytest.raises(ValueError):
        url_filter.trained(spark, many)


# 2. embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(np.float32(v)) for v in x], int(i % 3)) for i, x in enumerate(np.concatenate([base, base[:30] + rng.normal(size=(30, 8)) * 0.08, base[:10]]))]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, None], 1), (503, [1.0] * 8, None), (504, [float("nan")] * 8, 1), (505, [float("inf")] * 8, 1), (506, [], 1), (507, [2.0], 1), (508, [5.0], 1)]
    v = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    sound = {i: (np.array(e) / np.linalg.norm(e), lab) for i, e, lab in rows if e and lab is not None and None not in e and np.isfinite(e).all() and any(e)}
    links = [(a, b) for a in sound for b in sound if a < b and sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0]) and sound[a][0] @ sound[b][0] >= 0.98]
    n, root = Counter(x for e in links for x in e), roots([r[0] for r in rows], links)
    assert len(links) > 10
    assert collected(embedding_dedup.deduplicated(spark, v), "vec_id", "n_links", "component_id", "kept") == sorted(((i, n[i], root[i], root[i] == i) for i, *_ in rows), key=str)
    assert embedding_dedup.deduplicated(spark, v.limit(0)).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    """Crowded cells dealt to block pairs lose nothing and count nothing twice."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones(16) + rng.normal(size=(60, 16)) * 0.1, rng.normal(size=(20, 16))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = (u @ u.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    v = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert [r["n_links"] for r in embedding_dedup.deduplicated(spark, v).orderBy("vec_id").collect()] == sim.sum(1).tolist()


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(4)
    for _ in range(20):
        low1, low2 = rng.random(9), rng.random(7)
        got = list(embedding_dedup.traversal(low1, low2, 0.8))
        every = sorted((a + b, i, j) for i, a in enumerate(low1) for j, b in enumerate(low2))
        assert [round(x[2], 12) for x in got] == [round(x[0], 12) for x in every if x[0] <= 0.8]
        assert {x[:2] for x in got} == {x[1:] for x in every if x[0] <= 0.8}


def test_embedding_recall(spark, monkeypatch):
    """A target recall is reached against brute force with fewer cells, and what is found is right; 1 is complete."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 24))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.09 for _ in range(6)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = int(((u @ u.T >= 0.98) & ~np.eye(len(x), dtype=bool)).sum())
    v = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {r: embedding_dedup.deduplicated(spark, v, recall=r).agg(F.sum("n_links")).first()[0] for r in (1.0, 0.9)}
    assert found[1.0] == links > 1000 and 0.87 * links <= found[0.9] <= links


def test_embeddings_of_extreme_lengths(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1.0, 1.0], 1), (3, [1e-200, 1e-200], 1), (4, [1e200, -1e200], 1), (None, [1.0, 1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert collected(embedding_dedup.deduplicated(spark, v).where("vec_id is not null"), "vec_id", "n_links", "component_id") == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


# 3. personal data

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(texts):
    rng = random.Random(1)
    for x in [*texts, *("".join(rng.choice("a@.1234+- ()5Zé@.12") for _ in range(rng.randint(0, 40))) for _ in range(5000)), "a" * 30000, "1" * 3000 + ".", "@" * 2000, "+1" * 900]:
        assert pii.kept(x, frozenset())[0] == base_spans(x)


def test_pii(spark, docs, empty):
    extra = spark.createDataFrame([(900, "call 212 555 7713 or 212-555-7714, mail bob (at) site (dot) com, x@y.com 4111 1111 1111 1111 10.2.3.4 +1 212 555 7715", None, None, 0, 1, "x", 1)], DOCS)
    for r in pii.found(spark, docs.union(extra)).collect():
        text = dict(docs.union(extra).select("doc_id", "text").collect())[r["doc_id"]]
        base = base_spans(text)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
    hidden = pii.masked(spark, docs.union(extra))
    assert hidden.columns == docs.columns
    text = hidden.where("doc_id = 900").first()
    assert "@" not in text["text"] and "[EMAIL]" in text["text"] and "[CARD]" in text["text"] and text["n_chars"] == len(text["text"])
    assert hidden.where("text is null").count() == docs.where("text is null").count()
    assert pii.found(spark, empty).count() == 0 == pii.masked(spark, empty).count()


def test_added_spans(spark):
    """Spans of looser shapes are added where labelers agree, and not where they do not; overlaps are masked once."""
    good = ["write to bob (at) site (dot) com today", "call me: 212-555-7714 please", "phone (212) 555-7713 now"] * 30
    bad = ["order 212-555-7714x1 build", "version 111-111-1111 serial 5"] * 30
    clean = ["nothing to see here at all"] * 30
    rows = list(enumerate([*good, *bad, *clean]))
    got = {r["doc_id"]: r for r in pii.found(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {"write to bob (at) site (dot) com today": "email:9:32", "call me: 212-555-7714 please": "phone:9:21", "phone (212) 555-7713 now": "phone:6:20"}
    for i, t in rows:
        assert got[i]["spans"] == want.get(t, "") and got[i]["n_added"] == (t in want), t
        assert got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_classifier_sees_the_span_and_its_context():
    """Of two candidates with the same undecided votes, that with the shape of the trusted ones scores higher."""
    yes, no, open_ = pii._coded(3, (1, 1, 1, 1, 1)), pii._coded(3, (-1, -1, -1, -1, -1)), pii._coded(3, (0, 0, 0, 0, 0))
    good, bad = pii._shape("call 212-555-7714 ", 5, 17, 1), pii._shape("x212-555-7714x", 1, 13, 0)
    counts = {yes * pii.SHAPES + good: 50, no * pii.SHAPES + bad: 50, open_ * pii.SHAPES + good: 1, open_ * pii.SHAPES + bad: 1}
    score = pii.trained(counts, {yes: 0.99, no: 0.01, open_: 0.5})
    assert score(open_ * pii.SHAPES + good) > 0.6 > 0.4 > score(open_ * pii.SHAPES + bad)
    x, n = np.array([pii._inputs(c) for c in counts]), np.array(list(counts.values()), float)
    y, w = np.array([0.99, 0.01, 0.5, 0.5]), np.zeros(x.shape[1])
    for _ in range(20000):  # plain gradient descent reaches the same scores
        w -= 0.01 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + w)
    assert [score(c) for c in counts] == pytest.approx((1 / (1 + np.exp(-x @ w))).tolist(), abs=1e-3)
    assert pii.trained({}, {})(0) == 0.5


def test_masked_spans_that_overlap_and_clash(spark):
    rows = [(1, "a@b.com1234567812345670 x", "k"), (2, None, "k"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = {r["doc_id"]: r for r in pii.masked(spark, df).collect()}
    assert got[1]["text"].count("[") == 1 and got[1]["text"].endswith(" x") and got[1]["found"] == "k"
    assert got[2]["text"] is None and got[3]["text"] == ""


def test_reliabilities_find_the_bad_labeler():
    rng = random.Random(7)
    counts = Counter()
    for _ in range(5000):
        truth = rng.random() < 0.5
        vote = lambda p: (1 if truth else -1) if rng.random() < p else (-1 if truth else 1)  # noqa: B023, E731
        counts[pii._coded(1, (vote(0.95), vote(0.9), vote(0.5), vote(0.9), vote(0.85)))] += 1
    _, table = pii.reliabilities(counts)
    assert table[0, 1, 2] > 0.9 and abs(table[2, 1, 2] - 0.5) < 0.06 and table[4, 1, 2] == pytest.approx(0.85, abs=0.05)


# 4. quality rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    again = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark, docs, empty):
    got = quality_rules.judged(spark, docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judged(spark, empty).count() == 0


def test_quality_outliers(spark, sf):
    """Junk goes and clean documents stay, as the labels have them; a group of equal rows rejects none of them."""
    got = quality_rules.judged(spark, spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"))
    m = got.join(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("not base_failed")
    assert m.where("quality = 1 and not kept").count() <= 0.01 * m.where("quality = 1").count()
    assert m.where("quality = 0 and not kept").count() >= 0.9 * m.where("quality = 0").count()
    same = spark.range(300).select("id", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ").alias("text"))
    assert quality_rules.judged(spark, same, "id").where("not kept").count() == 0


def test_quality_of_small_sources(spark):
    """Two sources of 40 rows far from each other and from a third of 150: clean rows stay, and what lies where another
    source is goes."""
    rng = random.Random(5)
    rows = []

    def put(source, n, length, symbols, sort):
        for _ in range(n):
            words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=max(1, round(rng.gauss(length, 0.15 * length))))) for _ in range(120)]
            for k in rng.sample(range(120), round(120 * symbols * rng.uniform(0.9, 1.1))):
                words[k] += "#"
            rows.append((len(rows), " ".join(words), "en", source, sort))

    put("large", 150, 5, 0.0, "clean")
    put("short", 40, 3, 0.5, "clean")
    put("long", 40, 11, 0.15, "clean")
    put("short", 2, 11, 0.15, "junk")
    put("long", 2, 3, 0.5, "junk")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, sort string")
    got = quality_rules.judged(spark, docs).join(docs.select("doc_id", "source", "sort"), "doc_id")
    assert got.where("base_failed").count() == 0
    assert got.where("sort = 'clean' and not kept").count() == 0
    assert got.where("sort = 'junk' and kept").count() == 0


def plain_mcd(x, start, share=0.7):
    """Concentration steps on all rows of a group, the h-th distance's ties by exact rank, to the end."""
    floor, d = np.array(list(quality_rules.STATS.values())) ** 2, x.shape[1]
    h = int(np.ceil(len(x) * 0.5))
    dist = start
    for _ in range(100):
        near = np.argsort(dist, kind="stable")[:h]
        m, c = x[near].mean(0), np.cov(x[near].T, bias=True) + np.diag(floor)
        dist = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        h = int(np.ceil(len(x) * share))
    assert d == 4
    return m, c


def test_estimates_against_plain_steps(spark):
    """Centres and covariances of groups with outliers are those of plain concentration steps, up to a bin's width."""
    rng = np.random.default_rng(8)
    rows, groups = [], {}
    for g, (n, bad) in {"a": (400, 60), "b": (90, 15)}.items():
        x = rng.normal(size=(n, 4)) * [0.2, 0.1, 0.3, 0.2] + rng.normal(size=4)
        x[:, 1] += 0.4 * x[:, 0]
        x[:bad] += [2, -1, 2, 3]
        x = np.round(x * quality_rules.FIXED) / quality_rules.FIXED
        groups[g] = (x, bad)
        rows += [(g, *[int(round(v * quality_rules.FIXED)) for v in r]) for r in x]
    fit = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} long" for c in quality_rules.STATS))
    for r in quality_rules.estimated(spark, fit.cache()).collect():
        x, bad = groups[r["grp"]]
        q = np.median(x, 0)
        a = np.sqrt((1.4826 * np.median(np.abs(x - q), 0)) ** 2 + np.array(list(quality_rules.STATS.values())) ** 2)
        best = min((plain_mcd(x, start) for start in ((((x - q) / a) ** 2).sum(1), (np.tanh((x - q) / a) ** 2).sum(1))), key=lambda e: np.linalg.slogdet(e[1])[1])
        m = np.array([r[f"m_{i}"] for i in range(4)])
        c = np.array([[r[f"c_{max(i, j)}_{min(i, j)}"] for j in range(4)] for i in range(4)])
        sd = np.sqrt(np.diag(best[1]))
        assert np.abs((m - best[0]) / sd).max() < 0.05 and np.abs((c - best[1]) / np.outer(sd, sd)).max() < 0.08
        assert np.abs((m - x[bad:].mean(0)) / sd).max() < 0.4  # outliers do not move it


def test_a_group_of_thirty_has_its_own_estimate(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=n)) for n in rng.choices((k - 1, k, k + 1), k=80)), "en", s) for i, (s, k) in enumerate([("big", 5)] * 300 + [("small", 12)] * 30)]
    got = quality_rules.judged(spark, spark.createDataFrame([*rows, (None, rows[0][1], None, None)], "doc_id long, text string, lang string, source string"))
    assert got.where("not kept and doc_id is not null").count() == 0 and got.count() == 331


def test_filtered_keeps_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, words, "en", "s", "mine", "x") for i in range(30)] + [(99, "short", "en", "s", "mine", "x")], "doc_id long, text string, lang string, source string, n_words string, kept string")
    got = quality_rules.filtered(spark, docs)
    assert got.columns == docs.columns and got.count() == 30 and got.where("n_words = 'mine' and kept = 'x'").count() == 30


# 5. mixing


def shared_plainly(sizes, weights=(5, 2, 1)):
    """Targets by the contract: what goes over three times a source's size is shared again, one source after the other."""
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % 3] for i, k in enumerate(order)}
    fixed = {}
    while True:
        free = [k for k in order if k not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        per = left / sum(weight[k] for k in free) if free else 0
        over = [k for k in free if weight[k] * per > 3 * sizes[k]]
        if not over:
            return fixed | {k: weight[k] * per for k in free}
        fixed |= {k: 3 * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, None: 100}, {"a": 10, "b": 1000, "c": 1000}, {"a": 0}, {}, {f"s{i}": i * i for i in range(40)} | {None: 7, "é": 3, "Z": 90, "": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
    got = {r["source"]: r["target"] for r in mixing.targeted(spark, df).collect()}
    assert got == pytest.approx(shared_plainly(sizes))


def test_newton_steps(spark):
    """Multipliers of many keys and of two features meet their targets, as a plain solver of the dual finds them."""
    rng = np.random.default_rng(3)
    keys, size, x = rng.integers(0, 5, 300), rng.integers(1, 50, 300).astype(float), rng.normal(size=(300, 2))
    truth = np.exp(rng.normal(size=5)[keys] * 0.5 + x @ [0.3, -0.4])
    goal = np.bincount(keys, size * truth)
    totals = (size * truth) @ x
    rows = spark.createDataFrame([(f"k{k}", float(n), v.tolist()) for k, n, v in zip(keys, size, x)] + [("empty", 0.0, [0.0, 0.0])], "key string, size double, features array<double>")
    wanted = spark.createDataFrame([(f"k{k}", float(t)) for k, t in enumerate(goal)] + [("empty", 5.0), ("none", 1.0)], "key string, target double")
    lam, mu = mixing.balanced(spark, rows, wanted, tuple(totals))
    lam = {r["key"]: r["lam"] for r in lam.collect()}
    assert lam["empty"] is None and lam["none"] is None
    rate = np.exp(np.array([lam[f"k{k}"] for k in keys]) + x @ mu)
    assert np.bincount(keys, size * rate) == pytest.approx(goal) and (size * rate) @ x == pytest.approx(totals, abs=1e-4)
    assert rate == pytest.approx(truth, rel=1e-4)  # the tilt that made the targets is the only one
    lam, _ = mixing.balanced(spark, rows.select("key", "size"), wanted)
    assert all(np.exp(r["lam"]) * size[keys == int(r["key"][1])].sum() == pytest.approx(goal[int(r["key"][1])]) for r in lam.where("lam is not null").collect())


def test_mixing(spark, docs, sf, empty):
    for table in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = mixing.digest(spark, table).collect()
        texts = table.select("doc_id", "text", "source").collect()
        want = Counter()
        for r in texts:
            want[r["source"]] += len(WORD.findall(r["text"] or ""))
        goal, size, source = shared_plainly(want), {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in texts}, {r["doc_id"]: r["source"] for r in texts}
        got = Counter()
        for r in rows:
            assert r["size"] == size[r["doc_id"]] and r["source_size"] == want[source[r["doc_id"]]] and r["target"] == pytest.approx(goal[source[r["doc_id"]]])
            assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
            got[source[r["doc_id"]]] += r["taken"]
        if table is not docs:
            assert all(abs(got[s] - goal[s]) <= 0.05 * goal[s] + 60 for s in goal)
        assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.digest(spark, table.repartition(5)).collect()))
    assert mixing.digest(spark, empty).count() == 0 == mixing.repeated(spark, empty).count()


def test_mixing_of_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, "a b c", None, 1.0), (None, "d", "s", 2.0), (3, None, "s", 3.0)], "doc_id long, text string, source string, rate double")
    assert mixing.digest(spark, df).count() == 3 and mixing.repeated(spark, df).columns == df.columns


# 6. token counts


@pytest.fixture(scope="session")
def code():
    with open(token_counts.RANKS, "rb") as f:
        return token_counts.Counter(f.read())


def test_edits(code, texts):
    rng = random.Random(3)
    for i in range(600):
        x = "".join(rng.choice("ab c  \n\t9'sé.#日") for _ in range(rng.randint(0, 600))) if i % 2 else rng.choice(texts)[:3000]
        tree = token_counts.Tree(code, x)
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, len(tree.text))
            b, new = min(len(tree.text), a + rng.choice([0, 0, 1, 5, 80, 500])), "".join(rng.choice("xy z\n'1 s") for _ in range(rng.choice([0, 1, 3, 40, 400])))
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.tokens == len(code.code.encode_ordinary(want))
            assert [p for leaf in tree.leaves for p in leaf[2]] == [len(p) for p in code.split.findall(want)]
            assert tree.tokens == sum(leaf[1] for leaf in tree.leaves)


def test_edits_of_contractions(code):
    """The second letter of 'll, 've and 're may come or go by an edit."""
    rng = random.Random(4)
    tree = token_counts.Tree(code, "we'l")
    tree.edit(4, 4, "l")
    assert [p for leaf in tree.leaves for p in leaf[2]] == [2, 3]
    for _ in range(2000):
        tree = token_counts.Tree(code, "".join(rng.choice("'lvre a") for _ in range(rng.randint(1, 40))))
        a = rng.randint(0, len(tree.text))
        b, new = min(len(tree.text), a + rng.randint(0, 2)), "".join(rng.choice("'lvre ") for _ in range(rng.randint(0, 3)))
        tree.edit(a, b, new)
        assert [p for leaf in tree.leaves for p in leaf[2]] == [len(p) for p in code.split.findall(tree.text)]
        assert tree.tokens == len(code.code.encode_ordinary(tree.text))


def test_edits_touch_little(code):
    """Single edits of a long text encode a few leaves, and the tree is seldom built again."""
    rng = random.Random(7)
    tree = token_counts.Tree(code, " ".join(f"word{i}" for i in range(20000)))
    built = []
    whole = tree._sum
    tree._sum = lambda: built.append(1) or whole()
    for _ in range(300):
        before, a = tree.encoded, rng.randrange(len(tree.text))
        tree.edit(a, a + rng.choice((0, 3)), rng.choice(("", "new words here", "x")))
        assert 0 < tree.encoded - before <= 4 * token_counts.FULL * 12
    assert len(built) <= 10 and tree.tokens == len(code.code.encode_ordinary(tree.text))
    small = token_counts.Tree(code, "one two three")
    small.edit(4, 7, "2")
    assert small.encoded == len("one 2 three")  # all of a text of one leaf


def test_token_columns_that_clash(spark, code):
    df = spark.createDataFrame([(1, "a b", "x", "y", "z"), (None, None, "x", "y", "z")], "doc_id long, text string, n_tokens string, tree string, encoded string")
    rows = token_counts.counted(spark, df).withColumn("edits", token_counts.sample_edits(F.col("doc_id"), F.length("text")))
    got = {r["doc_id"]: r for r in token_counts.edited(spark, rows).collect()}
    assert got[1]["n_tokens"] == len(code.code.encode_ordinary(got[1]["text"])) and isinstance(got[1]["encoded"], int) and len(got) == 2


def test_token_counts(spark, docs, code, empty):
    texts = dict(docs.select("doc_id", "text").collect())
    for r in token_counts.digest(spark, docs).collect():
        assert r["n_tokens"] == len(code.code.encode_ordinary(texts[r["doc_id"]] or ""))
    rows = token_counts.counted(spark, docs).withColumn("edits", token_counts.sample_edits(F.col("doc_id"), F.length("text")))
    for r in token_counts.edited(spark, rows).collect():
        assert r["n_tokens"] == len(code.code.encode_ordinary(r["text"] or ""))
    assert token_counts.digest(spark, empty).count() == 0


# 7. SentencePiece


@pytest.fixture(scope="session")
def model():
    with open(sentencepieces.MODEL, "rb") as f:
        return f.read()


def test_codec(model, texts):
    import sentencepiece

    right = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(2)
    xs = texts[:60] + ["".join(rng.choice(" ab▁é\n日😀 <s>\x00\t") for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", " ", "  a  b ", "<s></s><unk>", "a" * 3000]
    c = sentencepieces.Codec(model)
    ids, ok, back = c.encode(xs)
    assert [np.frombuffer(i, "<i4").tolist() for i in ids] == right.encode(xs) and all(ok)
    assert [x == y for x, y in zip(xs, c.decode(ids))] == back
    assert [e.ids for e in c.ours.encode_batch_fast(xs, add_special_tokens=False)] == right.encode(xs)  # whole texts, without the memory of words
    assert c.decode(ids) == [right.decode(np.frombuffer(i, "<i4").tolist()) for i in ids]


def test_decoding_by_the_bytes_of_pieces(model):
    """Any ids, bytes that are no text among them, decode as the library decodes them, which is asked about those only."""
    rng = random.Random(4)
    c = sentencepieces.Codec(model)
    n = len(c.model.pieces)
    some = [[rng.randrange(n) for _ in range(rng.randint(0, 40))] for _ in range(300)] + [[rng.randrange(min(n, 300)) for _ in range(rng.randint(0, 8))] for _ in range(700)] + [[i] for i in range(n)]
    want = c.ours.decode_batch(some, skip_special_tokens=False)
    assert c.decode([np.array(i, "<i4").tobytes() for i in some]) == want
    texts = ["plain words é 日本", "", "  two  spaces ", "😀 tab\t."]
    ids = c.encode(texts)[0]
    c.ours = None
    assert c.decode(ids) == texts


def test_codec_of_a_unigram_model():
    """A small unigram model, written here field by field."""
    import struct

    import sentencepiece

    def field(number, value):
        if isinstance(value, int):
            return bytes([number * 8 % 128 + (128 if number > 15 else 0)]) + (bytes([number * 8 // 128]) if number > 15 else b"") + bytes([value])
        return bytes([number * 8 + 2, len(value)]) + value

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -3.5, 1), ("▁a", -3.2, 1), ("ba", -4.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0) + field(5, 1))
    c = sentencepieces.Codec(data)
    xs = ["abba ab a", "b  aab", "", "ba ba"]
    ids, ok, back = c.encode(xs)
    assert all(ok) and all(back) and not c.apart
    assert [np.frombuffer(i, "<i4").tolist() for i in ids] == sentencepiece.SentencePieceProcessor(model_proto=data).encode(xs)


def test_encoded(spark, docs, model, empty):
    rows = sentencepieces.encoded(spark, docs)
    assert rows.columns == [*docs.columns, "token_ids", "n_tokens", "parity", "round_trip"]
    texts = dict(docs.select("doc_id", "text").collect())
    back = sentencepieces.decoded(spark, rows)
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in back.collect())
    assert sentencepieces.digests(spark, docs).where("not parity or not round_trip").count() == 0
    assert sentencepieces.digests(spark, empty).count() == 0


def test_ids_are_those_of_the_tokenizers_library(model, monkeypatch):
    """Were the other library to say something else, ids would stay and parity would be false."""
    c = sentencepieces.Codec(model)

    class Other:
        def encode(self, texts, num_threads=1):
            return [[5] for _ in texts]

        def piece_to_id(self, piece):
            return 5

    right = sentencepieces.Codec(model).encode(["hello world", ""])[0]
    c.theirs = Other()
    ids, ok, back = c.encode(["hello world", ""])
    assert ids == right and ok == [False, True] and back == [True, True]


def test_round_trip_is_that_of_the_text(spark, model):
    """Texts that no ids decode to are told."""
    df = spark.createDataFrame([(1, "a ▁b"), (2, "plain text"), (None, None)], "doc_id long, text string").withColumns({"parity": F.lit(7), "token_ids": F.lit("x")})
    got = {r["doc_id"]: (r["parity"], r["round_trip"], r["n_tokens"]) for r in sentencepieces.encoded(spark, df).collect()}
    assert got[1][:2] == (True, False) and got[2][:2] == (True, True) and got[None] == (True, True, 0)


def unigram_model(pieces, charsmap=b"", fallback=False):
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k, value):
        return number(k * 8) + number(value) if isinstance(value, int) else number(k * 8 + 2) + number(len(value)) + value

    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    return data + field(2, field(3, 1) + field(35, int(fallback))) + field(3, field(2, charsmap) + field(3, 1) + field(4, 0) + field(5, 1))


def test_codec_of_byte_fallback_and_user_pieces():
    import sentencepiece

    letters = [(c, -4.0 - i / 10, 1) for i, c in enumerate("abcdeé")]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("▁", -2.0, 1), *letters, ("ab", -3.0, 1), ("▁ab", -3.5, 1), ("cde", -3.2, 1)]
    xs = ["ab cde", "日本 ab", "éé 😀", "", "a\x00b", "xyz"]
    for fallback in (True, False):
        data = unigram_model([p for p in pieces if fallback or p[2] != 6], fallback=fallback)
        ids, ok, back = sentencepieces.Codec(data).encode(xs)
        right = sentencepiece.SentencePieceProcessor(model_proto=data).encode(xs)
        assert ok == [a == b for a, b in zip([np.frombuffer(i, "<i4").tolist() for i in ids], right)]
        if fallback:
            assert all(ok) and all(back)


# 8. quality classifier


def test_classifier(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = quality_classifier.scored(spark, spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    good, bad = [r["score"] for r in held if label[r["doc_id"]] == 1], [r["score"] for r in held if label[r["doc_id"]] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_classifier_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2, 0) for i in range(20)] + [(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.scored(spark, docs, labels).where("score is null").count() == 0
    assert quality_classifier.scored(spark, docs, labels.limit(0)).count() == docs.count()
    assert quality_classifier.scored(spark, empty, labels).count() == 0


def test_word_vectors_against_plain_sums(spark, texts):
    """Word vectors and pooled documents, recomputed word by word."""
    docs = spark.createDataFrame(list(enumerate([*texts[:6], None, "", "one", "one one"])), "doc_id long, text string").repartition(3)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    index = [quality_classifier.index_vectors(n, k) for k, n in enumerate(quality_classifier.ROWS)]
    sums = [np.zeros((n, quality_classifier.DIM + 1)) for n in quality_classifier.ROWS]
    tokens = {}
    for i, raw in rows:
        _, t = quality_classifier._tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        tokens[i] = t
        for k in (0, 1):
            for at, w in enumerate(t[k].tolist()):
                sums[k][w, -1] += 1
                for o in quality_classifier.AROUND:
                    if 0 <= at + o < len(t[k]):
                        sums[k][w, :-1] += index[k][t[k][at + o]]
    tables = []
    for table in sums:
        n, v = table[:, -1], table[:, :-1]
        v = v - v.sum(0) / n.sum() * n[:, None]
        v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
        tables.append(v * (1e-2 / (1e-2 + n / n.sum()))[:, None])
    got = {r["doc_id"]: r["vector"] for r in quality_classifier.pooled(spark, docs, "doc_id").collect()}
    for i, t in tokens.items():
        want = np.concatenate([tables[k][t[k]].mean(0) if len(t[k]) else np.zeros(quality_classifier.DIM) for k in (0, 1)])
        assert np.allclose(got[i], want, atol=1e-5), i


def test_network_against_plain_layers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2 * quality_classifier.DIM))
    y = (x[:, 0] + 0.3 * x[:, 1] ** 2 > 0.3).astype(float)
    net = quality_classifier.Network(x, y)
    w1, b1, w2, b2 = net.w
    for row in x[:20]:
        hidden = [np.tanh(sum((row[i] - net.mean[i]) / net.dev[i] * w1[i, j] for i in range(len(row))) + b1[j]) for j in range(len(b1))]
        want = 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, w2)) + b2[0]) / net.heat))
        assert net.score(row[None])[0] == pytest.approx(want)
    assert np.mean((net.score(x) >= 0.5) == y) > 0.85
    new = rng.normal(size=(2000, 2 * quality_classifier.DIM))  # the temperature is for rows that the layers have not seen
    sign = np.where(new[:, 0] + 0.3 * new[:, 1] ** 2 > 0.3, 1, -1)
    loss = lambda t: np.logaddexp(0, -sign * net.logit(new) / t).mean()
    assert loss(net.heat) < loss(1.0) and min(loss(t) for t in (0.5, 1, 2, 4, 8)) > loss(net.heat) - 0.03


def test_repeated_labelled_rows_count_once(spark, monkeypatch):
    seen = []
    real = quality_classifier.Network
    monkeypatch.setattr(quality_classifier, "Network", lambda x, y: seen.append(len(x)) or real(x, y))
    docs = spark.createDataFrame([(i, f"text {i} {'!' * (i % 2)}", "s") for i in range(12)] * 5, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    assert quality_classifier.scored(spark, docs, labels).count() == 60
    assert seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(12))]


# 9. repeated passages


def removed_plainly(rows, width=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    want = []
    for (key, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        want.append((key, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(want, key=str)


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("few, at_once", [(2048, 500_000), (1, 500_000), (2048, 300)])
def test_repeats(spark, docs, monkeypatch, few, at_once):
    """Few anchors are sorted in tasks, many are spread; both give the windows of the definition. Null keys and rows that
    repeat many times among them."""
    monkeypatch.setattr(repeats, "FEW", few)
    monkeypatch.setattr(repeats, "SORTED", at_once)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows += [(None, rows[3][1]), (None, None)] + [max(rows, key=lambda r: len(r[1] or ""))] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(repeats.removed(spark, df), *REPEATS) == removed_plainly(rows)


def test_radix_orders_by_bytes():
    """Groups after the last digit are those of equal windows, for widths that are no multiple of a digit too."""
    rng = np.random.default_rng(5)
    for width in (32, 37, 200):
        raw = np.concatenate([rng.integers(97, 99, 900, dtype=np.uint8), np.tile(rng.integers(97, 123, width + 60, dtype=np.uint8), 3)])
        at = np.arange(len(raw) - width + 1)
        group = at % 2
        seen = Counter((raw[i : i + width].tobytes(), i % 2) for i in at.tolist())
        assert repeats.radix(raw, at, group, width).tolist() == [seen[raw[i : i + width].tobytes(), i % 2] > 1 for i in at.tolist()]
    assert repeats.radix(raw, at[:0], group[:0], 200).tolist() == []


def test_repeats_are_told_by_bytes(spark, monkeypatch):
    """Were all anchors one, and all runs of one length alike but for their bytes, the sort by bytes would still tell
    windows apart."""
    real = repeats._runs

    def same_anchor(raw, offs, width):
        row, start, count, digit, at, one, two = real(raw, offs, width)
        return row, start, count, np.zeros_like(digit), at, one, two

    monkeypatch.setattr(repeats, "_runs", same_anchor)
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(200))
    rows = [(1, base), (2, base[:500] + "X" + base[501:]), (3, "y" + base[120:700])]
    assert collected(repeats.removed(spark, spark.createDataFrame(rows, "doc_id long, text string")), *REPEATS) == removed_plainly(rows)


def test_repeated_rows_are_linear(spark, monkeypatch):
    """n equal rows make lists of one text's runs, not of n texts'."""
    base = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
    made = {}
    for n in (2, 200):
        df = spark.createDataFrame([(1, base)] * n, "doc_id long, text string")
        lists = repeats._merged(repeats.spans(spark, df.select("doc_id", "text")), 200).collect()
        made[n] = sum(len(r["runs"]) for r in lists)
    assert made[2] == made[200] == 1


def test_repeats_of_nothing(spark, empty):
    assert repeats.removed(spark, empty).count() == 0


# 10. Jaccard join


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def joined_plainly(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(list(sets), links)
    return sorted(((i, len(sets[i]), root[i]) for i, _ in rows), key=str)


def test_jaccard(spark, docs, empty):
    assert collected(jaccard_join.joined(spark, docs), "doc_id", "n_shingles", "component_id") == joined_plainly([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert jaccard_join.joined(spark, empty).count() == 0


def test_jaccard_near_copies(spark, monkeypatch):
    """Groups of edited copies around the threshold, with small blocks and pivots."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = []
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words[: len(words) - rng.randint(0, 6)]) + (" " + common if g % 2 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collected(jaccard_join.joined(spark, df), "doc_id", "n_shingles", "component_id") == joined_plainly(rows)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_words_of_regular_structure(spark, n):
    """A word and its complement, which have equal sums of powers, are different words and different passages."""
    word, other = thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, "hello"), (4, word + " x"), (5, word)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard_join.joined(spark, df), "doc_id", "n_shingles", "component_id") == joined_plainly(rows)


def edited_copies(rng, n, words=100, changes=4):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_jaccard_edges_of_a_large_group(spark, monkeypatch):
    """A group of n near copies makes fewer than n links of components in all rounds together."""
    made = []
    whole = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda *a: made.append(whole(*a).cache()) or made[-1])
    n = 2000
    rows = list(enumerate(edited_copies(random.Random(8), n)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.joined(spark, df).collect()}
    sets, up = [shingles(t) for _, t in rows], list(range(n))
    for i in range(n):  # all pairs but those that are joined already
        for j in range(i):
            if up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    assert got == dict(enumerate(up))
    assert sum(x.count() for x in made) < 2 * n


def test_jaccard_texts_of_a_large_group(spark, monkeypatch):
    """Texts are sent to be compared by group, not by pair: pairs just below the threshold outnumber them."""
    sent = []
    whole = jaccard_join._verified

    def counting(docs, nodes, pairs, *rest):
        pairs = pairs.cache()
        sent.append((pairs.count(), pairs.select("cell", "a").distinct().count() + pairs.select("cell", "b").distinct().count()))
        return whole(docs, nodes, pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counting)
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(1500)], []
    for d in range(100):
        copy = list(base)
        for _ in range(21):
            copy[rng.randrange(1500)] = f"x{rng.randrange(10**9)}"
        rows.append((d, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = collected(jaccard_join.joined(spark, df), "doc_id", "n_shingles", "component_id")
    assert got == joined_plainly(rows)
    pairs, texts = map(sum, zip(*sent))
    assert pairs > 5 * len(rows) and 2 * texts < pairs, (pairs, texts)


def test_jaccard_cells_of_large_sets():
    """A cell holds no more than so many tokens; pairs of the same block of the same list share one otherwise."""
    one, fp = np.ones(4096, np.int64), np.arange(4096)
    for n in (1, 350, 5_000, 1_000_000):
        cells = jaccard_join._cells(one << 40, 0 * one, 0 * one, fp, n * one)
        most = np.unique(cells, return_counts=True)[1].max()
        assert most * n <= 2 * jaccard_join.HELD and (n > 350 or len(set(cells)) == 1)
    assert (jaccard_join._cells(fp << 30, one, one, fp, one) >> 30 == fp).all()


def test_jaccard_sets_that_share_a_name(spark, monkeypatch):
    """Sets are told apart by both fingerprints: one name for all of them changes nothing."""
    whole = jaccard_join._prints

    def one_name(values, edge, apart=None):
        name, other = whole(values, edge)
        name = np.where(name != 0, name % 5 + 1, 0)
        if apart:
            name = np.array([apart.get(k, k[0]) for k in zip(name.tolist(), other.tolist())], np.int64)
        return name, other

    monkeypatch.setattr(jaccard_join, "_prints", one_name)
    rows = list(enumerate(edited_copies(random.Random(9), 12) + edited_copies(random.Random(10), 12)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard_join.joined(spark, df), "doc_id", "n_shingles", "component_id") == joined_plainly(rows)


def test_jaccard_lists_in_parts(spark, monkeypatch):
    """Lists dealt out in parts, and rows without a key."""
    monkeypatch.setattr(jaccard_join, "_parts", lambda table: np.full(len(table), 3, np.int32))
    rows = list(enumerate(edited_copies(random.Random(11), 60, 60, 6)))
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    got = collected(jaccard_join.joined(spark, df).where("doc_id is not null"), "doc_id", "n_shingles", "component_id")
    assert got == joined_plainly(rows)
    assert jaccard_join.joined(spark, df).where("doc_id is null").first()["component_id"] is None


def shuffled(spark, run):
    """What run() returns, and the records and bytes that its shuffles write."""
    sc = spark.sparkContext
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x := stages.apply(i)).stageId(): (x.shuffleWriteRecords(), x.shuffleWriteBytes()) for i in range(stages.size())}

    before = written()
    out = run()
    return out, *map(sum, zip(*[v for k, v in written().items() if k not in before]))


def random_texts(rng, n, words):
    return [" ".join(f"w{rng.randrange(10**9)}" for _ in range(words)) for _ in range(n)]


def test_jaccard_texts_without_a_pair_stay(spark):
    """Of 300 texts, only the two that are compared are sent."""
    texts = random_texts(random.Random(13), 300, 300)
    texts[7] = texts[3] + " more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    raw = "".join(texts).encode()
    values, edge = jaccard_join.shingle_sets(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
    fp = jaccard_join._prints(values, edge)[0].tolist()
    nodes = spark.createDataFrame(list(enumerate(fp)), "doc_id long, fp long")
    pairs = spark.createDataFrame([(fp[3], fp[7], fp[3], fp[7], 1)], "a long, b long, ra long, rb long, cell long")
    docs.persist().count()
    got, _, size = shuffled(spark, lambda: jaccard_join._verified(docs, nodes, pairs, {}, 5, 4, 5).collect())
    docs.unpersist()
    assert sorted(got[0]) == sorted((fp[3], fp[7])) and len(got) == 1
    assert size < len(raw) / 10, (size, len(raw))


def test_jaccard_index_is_packed(spark):
    """The shuffles of a join write far fewer records than the index has rows."""
    texts = random_texts(random.Random(14), 200, 500)
    rows = list(enumerate([*texts, texts[0] + " more"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    docs.count()
    got, records, _ = shuffled(spark, lambda: collected(jaccard_join.joined(spark, docs), "doc_id", "n_shingles", "component_id"))
    docs.unpersist()
    assert got == joined_plainly(rows)
    assert records < 201 * 100 / 2, records


def test_jaccard_rows_without_a_partner(spark, monkeypatch):
    """Every pair of a list that sizes and positions allow has both rows marked, and some rows are not."""
    made = []
    whole = jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda lists, *a: made.append(lists) or whole(lists, *a))
    monkeypatch.setattr(jaccard_join, "PAIRED", 5)
    rng = random.Random(15)
    common = random_texts(rng, 6, 25)
    texts = [" ".join([a, rng.choice(common), b]) for n in range(10, 60) for a, b in [random_texts(rng, 2, n)]]
    rows = list(enumerate([*texts, *edited_copies(rng, 20, 60, 6), *(t for _ in range(6) for t in edited_copies(rng, 2, 60, 2))]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collected(jaccard_join.joined(spark, df), "doc_id", "n_shingles", "component_id") == joined_plainly(rows)
    lists = {}
    for r in made[0].collect():
        lists.setdefault(r["token"], []).append(r)
    marks = Counter()
    for of in lists.values():
        for x in of:
            most = 0 if len(of) <= 5 else 2
            for y in of:
                a, b = (x, y) if (x["n"], x["fp"]) > (y["n"], y["fp"]) else (y, x)
                need = -(-4 * (a["n"] + b["n"]) // 9)
                if x is not y and 5 * b["n"] >= 4 * a["n"] and a["pos"] + need <= a["n"] and b["pos"] + need <= b["n"] and min(a["n"] - a["pos"], b["n"] - b["pos"]) + min(a["pos"], b["pos"]) >= need:
                    most = max(most, 1 if {a["prev"], a["prev2"]} & {b["prev"], b["prev2"]} - {-1} else 2)
            assert x["use"] == most
            marks[most] += 1
    assert min(marks[k] for k in (0, 1, 2)) > 0, marks


def test_jaccard_large_sets_apart(spark, monkeypatch):
    """Large sets that share a passage only are told apart by their sketches; no text of theirs is sent after round 1."""
    sent = []
    whole = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda docs, nodes, pairs, *a: sent.append(pairs.count()) or whole(docs, nodes, pairs, *a))
    rng = random.Random(17)
    rows = [(5 * g + d, f"{text} {common}") for g, common in enumerate(random_texts(rng, 4, 200)) for d, text in enumerate(random_texts(rng, 5, 4000))]
    rows.append((20, rows[0][1].replace("w", "x", 40)))
    rows.append((21, rows[0][1] + " more"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(jaccard_join.joined(spark, df), "doc_id", "n_shingles", "component_id") == joined_plainly(rows)
    assert sum(sent[1:]) <= 2, sent


def test_jaccard_sketches_of_two_sizes():
    """Sketches of any sizes differ in no more bits than their sets have tokens apart."""
    rng = np.random.default_rng(18)
    for n, m in ((10, 12), (2000, 2100), (2048, 2049), (4000, 4200), (30000, 33000)):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([a[n // 50 :], rng.integers(0, 2**64, m - n + 1, np.uint64)]))
        wide = jaccard_join._sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        most = len(np.setxor1d(a, b))
        sizes, one, two = np.array([len(a), len(b)]), np.array([0]), np.array([1])
        bits = jaccard_join._apart_bits(sizes, jaccard_join._folded(wide, jaccard_join.SKETCH), np.array(wide, object), one, two, sizes[:1] + sizes[1:])
        assert 0 < bits[0] <= most
        assert [8 * len(x) for x in wide] == jaccard_join._bits(sizes).tolist()


def test_jaccard_left_out_beside_tried(spark):
    """That pairs of a set were left out is told, even if the last one that was not has been tried before."""
    lists = spark.createDataFrame([(1, fp, 100, 0, -1, -1, 2) for fp in range(1, 8)], "token long, fp long, n int, pos int, prev long, prev2 long, use int")
    nodes = spark.createDataFrame([(fp, fp, 100, bytes(128)) for fp in range(1, 8)], "doc_id long, fp long, n long, sketch binary")
    comp = spark.createDataFrame([], "node long, root long")
    tried = spark.createDataFrame([(4, 6), (4, 7)], "a long, b long")
    found = jaccard_join._across(lists, nodes, comp, tried, 4, 5, 1, 4).collect()
    assert {r["b"] for r in found if r["more"]} == {6, 7}
    assert {(r["a"], r["b"]) for r in found if not r["old"]} == {(a, b) for b in range(2, 8) for a in range(1, min(b, 5))} - {(4, 6), (4, 7)}
    late = spark.createDataFrame([(7,)], "fp long")
    assert (5, 7) in {(r["a"], r["b"]) for r in jaccard_join._across(lists, nodes, comp, tried, 4, 5, 1, None, late).collect()}
    assert not jaccard_join._across(lists, nodes, comp, tried, 4, 5, 1, None, late.where("fp = 0")).collect()


def test_jaccard_small_groups(spark, monkeypatch):
    """Many groups of few rows, packed in twos, and a filter with many texts of equal hash."""
    for name, value in (("GROUP", 64), ("GATHERED", 300), ("PACKED", 2), ("PAIRED", 3), ("PAIRS", 4), ("FILTER", 64)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(16)
    rows = list(enumerate([t for n in (3, 6, 30, 90) for t in edited_copies(rng, 15, n, 4) * 2] + ["", " ", "a", None]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collected(jaccard_join.joined(spark, df), "doc_id", "n_shingles", "component_id") == joined_plainly(rows)


def test_runs_of_long_rows(monkeypatch):
    """Rows of more bytes than positions give every suffix the anchor that it has in a row of any length."""

    def anchors():
        return {(r, s + i): d for row, start, count, digit, *_ in repeats._cut_runs(raw, offs, 200) for r, s, n, d in zip(row.tolist(), start.tolist(), count.tolist(), digit.tolist()) for i in range(n)}

    raw, offs = np.random.default_rng(7).integers(97, 123, 5300, dtype=np.uint8), np.array([0, 100, 300, 5300], np.int64)
    want = anchors()
    monkeypatch.setattr(repeats, "POSITION", 10)
    assert len(want) == 1 + 4801 and anchors() == want
    assert {(r, s + i): d for row, start, count, digit, *_ in [repeats._runs(raw, offs, 200)] for r, s, n, d in zip(row.tolist(), start.tolist(), count.tolist(), digit.tolist()) for i in range(n)} != want

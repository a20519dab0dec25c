"""URL filter: rules for hosts and paths, and a logistic regression on hashed character n-grams of host and path.

The model is trained by gradient descent on a small labelled table of URLs (a bounded catalogue, LABELLED by default).
Because the gradient is a combination of the rows' feature vectors, descent runs on one coefficient per row over the
Gram matrix of the rows, which is a single SQL aggregate; the weights of the hash buckets follow from one join. The table
is bounded (TABLE rows; more are an error), as one row holds that matrix. Scoring looks up each n-gram's bucket in the
array of weights: no shuffle of pages, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets of n-grams: the size of the array of weights.
BUCKETS = 4096
GRAMS = (3, 4)
#: Rows of the labelled table at most.
TABLE = 2000
#: (verdict, rule): host, then the beginning of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

# A small labelled table: 1 is unwanted. Each word makes hosts alone and with another one; prefixes, domains and paths are
# shared by both labels, so that only words tell them apart.
UNWANTED = "casino poker jackpot roulette gambling betting wager bingo slots pharmacy viagra steroids pills payday loans debt spam phishing malware popups adserver banners tracker ads clickbait adult webcam escort hookup torrent warez keygen crack replica rolex counterfeit miracle slimming lottery sweepstake giveaway freebies cheap discount bonus winner prize doubler getrich".split()
WANTED = "library university museum weather gardening history chemistry recipes journal archive council hospital theatre cycling astronomy geology grammar school orchestra railway mountain river painting kitchen language travel science health parents teacher forest harbour climate village bridge engine letters northern southern weekly evening garten zeitung schule verein stadt wetter jardin musique voyage cuisine histoire ciudad noticias escuela libros farm ranch tips guide".split()
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("", "index.html", "a/12", "2019/03", "topics/list", "about")


def labelled(spark: SparkSession) -> DataFrame:
    """(url, label): every word as a host alone, and beside another word of its label."""
    rows = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for i, w in enumerate(words):
            hosts = (w, f"{w}-{words[(i * 7 + 3) % len(words)]}", f"{words[(i * 5 + 1) % len(words)]}{w}")
            rows += [(f"https://{PREFIXES[(i + k) % 4]}{h}.example.{('com', 'net', 'org')[(i + k) % 3]}/{PATHS[(i * 2 + k) % 6]}", label) for k, h in enumerate(hosts)]
    return spark.createDataFrame(rows, "url string, label int")


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null or no '://' gives two empty strings."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(host, upper, upper.lower()), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a domain above it) and the beginning of path, and its verdict; else null."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, v).otherwise(verdict)
    return found, verdict


def _grams(text: str) -> str:
    """SQL for the buckets of the n-grams of a string expression."""
    return "concat(" + ", ".join(f"CASE WHEN length({text}) < {n} THEN array() ELSE transform(sequence(1, length({text}) - {n - 1}), i -> CAST(pmod(xxhash64(substring({text}, i, {n})), {BUCKETS}) AS INT)) END" for n in GRAMS) + ")"


def features(pages: DataFrame) -> DataFrame:
    """pages with host and path -> with buckets: n-grams of host (between ^ and $) and of path (between / and $)."""
    marked = pages.withColumns({"tm_host": F.concat(F.lit("^"), "host", F.lit("$")), "tm_path": F.concat(F.lit("|"), "path", F.lit("$"))})
    return marked.withColumn("buckets", F.expr(f"concat({_grams('tm_host')}, {_grams('tm_path')})")).drop("tm_host", "tm_path")


def trained(spark: SparkSession, table: DataFrame, rounds: int = 200, rate: float = 0.5, decay: float = 0.001) -> list[float]:
    """Weights of the buckets, then the bias. Features of a row are its n-gram counts over the square root of their
    sum, here as in scoring. table (url, label) has TABLE rows at most. Null urls count as empty, rows without a label do
    not count, repeated urls as one with their mean label. An empty table gives zeros."""
    if table.limit(TABLE + 1).count() > TABLE:
        raise ValueError(f"a labelled table has {TABLE} rows at most")
    host, path = split(F.col("url"))
    rows = features(table.select("url", F.col("label").cast("double").alias("y"), host.alias("host"), path.alias("path"))).where("y is not null")
    rows = rows.groupBy("url", "host", "path", "buckets").agg(F.avg("y").alias("y"))
    cells = rows.select("url", "y", F.explode("buckets").alias("bucket")).groupBy("url", "y", "bucket").agg(F.count("*").alias("n"))
    norm = cells.groupBy("url").agg(F.sqrt(F.sum("n")).alias("norm"))
    cells = cells.join(norm, "url").select("url", "y", "bucket", (F.col("n") / F.col("norm")).alias("x"))
    # a bucket that all rows share with no weight puts every pair of rows into the Gram matrix, products of 0 included
    shared = cells.union(cells.groupBy("url").agg(F.first("y").alias("y")).select("url", "y", F.lit(-1).alias("bucket"), F.lit(0.0).alias("x")))
    other = shared.select(F.col("url").alias("o"), "bucket", F.col("x").alias("z"))
    pairs = shared.join(other, "bucket").groupBy("url", "o").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    urls = cells.groupBy("url").agg(F.first("y").alias("y"))
    lines = pairs.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "k"))), lambda s: s["k"]).alias("row")).join(urls, "url")
    one = lines.groupBy().agg(F.array_sort(F.collect_list(F.struct("url", "y", "row"))).alias("all"))
    # state: coefficient of each row, and the bias
    step = f"""aggregate(sequence(1, {rounds}), named_struct('a', transform(all, r -> 0D), 'b', 0D), (s, t) ->
      aggregate(array(transform(all, r -> r.y - 1 / (1 + exp(-(s.b + aggregate(zip_with(s.a, r.row, (u, v) -> u * v), 0D, (p, q) -> p + q)))))),
        s, (old, e) -> named_struct('a', zip_with(s.a, e, (u, v) -> u * {1 - rate * decay}D + {rate}D * v), 'b', s.b + {rate}D * aggregate(e, 0D, (p, q) -> p + q) / size(e))))"""
    fit = one.selectExpr("all", f"{step} AS s").selectExpr("s.b AS bias", "explode(arrays_zip(transform(all, r -> r.url), s.a)) AS e").select("bias", F.col("e")["0"].alias("url"), F.col("e.a").alias("a"))
    # the bounded array of weights
    found = fit.join(cells.select("url", "bucket", "x"), "url").groupBy("bucket").agg(F.sum(F.col("a") * F.col("x")).alias("w"), F.first("bias").alias("bias")).collect()
    weights = [0.0] * BUCKETS + [found[0]["bias"] if found else 0.0]
    for r in found:
        weights[r["bucket"]] = r["w"]
    return weights


def judged(spark: SparkSession, pages: DataFrame, table: DataFrame | None = None, rules=RULES, cutoff: float = 0.5) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, score.

    score is the model's probability that the url is unwanted; verdict is the rule's where one fits, else block from
    cutoff on. Null urls and urls without '://' have an empty host and path, no rule, and the score of the bias. One row
    per row of pages; other columns are left out; an empty table gives an empty one.
    """
    weights = trained(spark, labelled(spark) if table is None else table)
    host, path = split(F.col("url"))
    rows = features(pages.select("page_id", host.alias("host"), path.alias("path")))
    w = F.split(F.lit(",".join(repr(x) for x in weights[:-1])), ",").cast("array<double>")  # a constant, folded once
    rows = rows.withColumn("w", w)
    total = F.expr("aggregate(buckets, 0D, (s, b) -> s + w[b])")
    size = F.sqrt(F.greatest(F.size("buckets"), F.lit(1)))
    score = 1 / (1 + F.exp(-(F.lit(weights[-1]) + total / size)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), score.alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("score") >= cutoff, "block").otherwise("allow")).alias("verdict"), "score")

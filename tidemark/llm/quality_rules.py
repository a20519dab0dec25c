"""Quality rules: per-document counts, fixed rules, and robust multivariate outliers.

The outlier rule fits a minimum-covariance-determinant estimate of a vector of transformed statistics for each
language and source and rejects documents by Mahalanobis distance. All of it is DataFrame and SQL expressions.

The estimate runs concentration steps from two deterministic starts per group (median and MAD; tanh scores) and keeps
the one with the smaller determinant. A step is one pass over the table of statistics: every row's distance falls into
a logarithmic bin, moments are summed per group and bin (integers, so that the order of rows changes nothing), and the
bins below the one that holds the h-th smallest distance, with as much of that one as is wanting, make the next estimate.
Steps end when no group's determinant changes any more.

Every language and source has its own centre from FULL rows on. Its covariance is its own and the mean one within the
sources of its language, weighted by rows. Below FULL rows, centre and covariance go over to the language's estimate (all
its rows, whatever their source), and below FULL rows of the language to that of all rows, in proportion to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, drop_stage, stage

#: Names of the transformed statistics, and the standard deviation that each has at least: differences of that order
#: never count as outlying, however uniform a group is.
STATS = {"x_length": 0.06, "x_symbols": 0.04, "x_lines": 0.08, "x_repeats": 0.08}
FIXED = 4096  # statistics are kept as multiples of 1/FIXED
BINS = 64  # distance bins per power of two
STEPS, SETTLED = 50, 1e-6  # concentration steps at most; changes of a log determinant that count as none
FULL = 4 * (len(STATS) + 1)  # rows of a group with a centre of its own; a table with fewer rejects none

COUNTS = [
    "size(words) AS n_words",
    "length(array_join(words, '')) AS word_chars",
    "length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) AS n_symbols",
    "size(lines) AS n_lines",
    "size(lines) - size(array_distinct(lines)) AS n_dup_lines",
]


def measured(docs: DataFrame) -> DataFrame:
    """Each document's counts beside its own columns (text must be a string column; null counts as empty).

    n_repeat_words: positions of words in 3-word windows that occur twice or more in the text. Windows are
    compared by 64-bit hash; only texts where one repeats sort them, by hash and position, so that a long text costs
    n log n.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.selectExpr("own", "text", r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '') AS words", r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]') AS lines")
    rows = rows.selectExpr("own", *COUNTS, "CASE WHEN size(words) < 3 THEN array() ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END AS hashes")
    rows = rows.selectExpr("*", "CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN array() ELSE sort_array(transform(hashes, (h, i) -> struct(h, i))) END AS grams")
    n = "size(grams)"
    rows = rows.selectExpr(
        "*",
        f"CASE WHEN {n} < 2 THEN array() ELSE sort_array(transform(filter(sequence(0, {n} - 1), j -> (j > 0 AND grams[j].h = grams[greatest(j - 1, 0)].h) OR (j < {n} - 1 AND grams[j].h = grams[least(j + 1, {n} - 1)].h)), j -> grams[j].i)) END AS again",
    )
    rows = rows.selectExpr(
        "own", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        "CASE WHEN size(again) = 0 THEN 0 WHEN size(again) = 1 THEN 3 ELSE aggregate(sequence(1, size(again) - 1), 3, (s, j) -> s + least(3, again[j] - again[j - 1])) END AS n_repeat_words",
    )
    found = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return rows.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns if c not in found], *[F.col(c).cast("long").alias(c) for c in found])


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def vector() -> list[Column]:
    """Log mean word length, square root of symbols a word, duplicate share of lines, repeated share of words."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    values = {"x_length": F.when(F.col("n_words") > 0, F.log(F.col("word_chars") / F.col("n_words"))).otherwise(F.lit(0.0)), "x_symbols": F.sqrt(share("n_symbols", "n_words")), "x_lines": share("n_dup_lines", "n_lines"), "x_repeats": share("n_repeat_words", "n_words")}
    return [F.round(v * FIXED).cast("long").alias(k) for k, v in values.items()]


def _solved(moments: DataFrame) -> DataFrame:
    """From n, sums s_i and products p_ij per (grp, start): mean m_i, covariance c_ij with the least variances added to
    its diagonal, and what _factored() adds."""
    names, d = list(STATS), len(STATS)
    n = F.col("n").cast("double")
    return _factored(moments.select("grp", "start", *[(F.col(f"s_{i}") / n / FIXED).alias(f"m_{i}") for i in range(d)], *[(F.col(f"p_{i}_{j}") / n / FIXED / FIXED - F.col(f"s_{i}") / n / FIXED * F.col(f"s_{j}") / n / FIXED + (STATS[names[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in _cells()]))


def _cells() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _factored(out: DataFrame) -> DataFrame:
    """Unit lower factor l_ij and pivots d_i of the covariance c_ij, and the logarithm of the determinant."""
    d = len(STATS)
    for j in range(d):  # one column of the factor after the other
        out = out.withColumn(f"d_{j}", F.greatest(F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 * F.col(f"d_{k}") for k in range(j)), F.lit(0.0)), F.lit(1e-9)))
        out = out.withColumns({f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") * F.col(f"d_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"d_{j}") for i in range(j + 1, d)}) if j + 1 < d else out
    return out.withColumn("log_det", sum((F.log(f"d_{i}") for i in range(d)), F.lit(0.0)))


def _mixed(out: DataFrame, up: str, prior) -> DataFrame:
    """m_i, c_ij moved towards {up}m_i and prior(i, j) as far as share (own centre) and weight (own covariance) leave
    room. The step between the two centres counts as spread by share^2 * (1 - share): a few rows far off the language
    say little about their source, more rows say that it lies elsewhere."""
    d, u = len(STATS), F.col("share")
    step = [F.col(f"m_{i}") - F.col(f"{up}m_{i}") for i in range(d)]
    m = {f"m_{i}": F.when(u >= 1, F.col(f"m_{i}")).when(F.col("m_0").isNull(), F.col(f"{up}m_{i}")).otherwise(u * F.col(f"m_{i}") + (1 - u) * F.col(f"{up}m_{i}")) for i in range(d)}
    c = {f"c_{i}_{j}": F.when(F.col("m_0").isNull(), prior(i, j)).otherwise(F.col("weight") * F.col(f"c_{i}_{j}") + F.when(F.col("weight") >= 1, 0.0).otherwise((1 - F.col("weight")) * prior(i, j)) + F.when(u >= 1, 0.0).otherwise(u * u * (1 - u) * step[i] * step[j])) for i, j in _cells()}
    return out.withColumns(m | c)


def _distance(rows: DataFrame) -> DataFrame:
    d = len(STATS)
    for i, x in enumerate(STATS):
        rows = rows.withColumn(f"y_{i}", F.col(x) / FIXED - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0)))
    return rows.withColumn("dist", sum((F.col(f"y_{i}") ** 2 / F.col(f"d_{i}") for i in range(d)), F.lit(0.0)))


def _bin(x: Column) -> Column:
    return F.floor(F.log2(F.greatest(x, F.lit(2.0**-20))) * BINS).cast("int")


def _concentrated(rows: DataFrame, share: float) -> DataFrame:
    """rows: grp, start, bin and the statistics -> moments of the h rows with the smallest distances, h being share of
    them. The bin of the h-th distance counts as far as its rows are needed, all of them alike."""
    d, names = len(STATS), list(STATS)
    sums = {f"s_{i}": F.col(x) for i, x in enumerate(names)} | {f"p_{i}_{j}": F.col(names[i]) * F.col(names[j]) for i in range(d) for j in range(i + 1)}
    binned = rows.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])
    up = Window.partitionBy("grp", "start").orderBy("bin")
    binned = binned.withColumns({"before": F.sum("n").over(up) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("grp", "start"))})
    h = F.ceil(F.col("total") * share)
    part = F.least(F.lit(1.0), (h - F.col("before")) / F.col("n"))
    binned = binned.where(F.col("before") < h).withColumn("part", part)
    whole = lambda c: F.sum(F.when(F.col("part") >= 1, F.col(c)).otherwise(F.lit(0)))  # noqa: E731  # of integers
    cut = lambda c: F.coalesce(F.max(F.when(F.col("part") < 1, F.col(c) * F.col("part"))), F.lit(0.0))  # noqa: E731  # one bin a group
    return binned.groupBy("grp", "start").agg(*[(whole(c) + cut(c)).alias(c) for c in ("n", *sums)])


def estimated(spark: SparkSession, fit: DataFrame, share: float = 0.7, send=lambda x: x) -> DataFrame:
    """fit (grp, the statistics) -> grp, m_i, c_ij: of each group the minimum-covariance-determinant estimate, the better
    one of those that concentration steps reach from two starts. fit is read once per step."""
    d, names = len(STATS), list(STATS)
    # starts: medians and MADs (to a ten-thousandth in rank), then distances without correlation
    mid = fit.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"q_{i}") for i, x in enumerate(names)])
    off = fit.join(send(mid), "grp").groupBy("grp").agg(*[F.first(f"q_{i}").alias(f"q_{i}") for i in range(d)], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"q_{i}")), 0.5, 10_000).alias(f"a_{i}") for i, x in enumerate(names)])
    off = off.select("grp", *[f"q_{i}" for i in range(d)], *[F.sqrt((F.col(f"a_{i}") * 1.4826) ** 2 + (STATS[x] * FIXED) ** 2).alias(f"a_{i}") for i, x in enumerate(names)])
    z = [(F.col(x) - F.col(f"q_{i}")) / F.col(f"a_{i}") for i, x in enumerate(names)]
    starts = F.array(F.struct(F.lit(0).alias("start"), sum((v**2 for v in z), F.lit(0.0)).alias("dist")), F.struct(F.lit(1).alias("start"), sum((F.tanh(v) ** 2 for v in z), F.lit(0.0)).alias("dist")))
    first = fit.join(send(off), "grp").select("grp", *names, F.explode(starts).alias("e")).select("grp", *names, "e.start", _bin(F.col("e.dist")).alias("bin"))
    model = stage(spark, _solved(_concentrated(first, 0.5)), "mcd")
    for _ in range(STEPS):
        near = _distance(fit.join(send(model), "grp")).select("grp", "start", *names, _bin(F.col("dist")).alias("bin"))
        after = stage(spark, _solved(_concentrated(near, share)), "mcd")
        old = model.select("grp", "start", F.col("log_det").alias("old"))
        change = after.join(send(old), ["grp", "start"]).agg(F.max(F.abs(F.col("log_det") - F.col("old")))).first()[0]
        drop_stage(spark, model)
        model = after
        if (change or 0.0) <= SETTLED:
            break
    best = Window.partitionBy("grp").orderBy("log_det", "start")
    return stage(spark, model.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("grp", *[f"m_{i}" for i in range(d)], *[f"c_{i}_{j}" for i, j in _cells()]), "mcd")


def outlying(spark: SparkSession, rows: DataFrame, share: float = 0.7, cutoff: float = 30.0) -> DataFrame:
    """rows (lang, source, the statistics, fits, key...) with a column outlier: distance over cutoff.

    Estimates use the rows where fits is true, share of them in each group's subset. cutoff is a squared distance, scaled
    so that the median distance of a group is at least that of four normal variates; 23.5 is their 0.9999 quantile.
    rows must be staged, as each step reads them once. Null lang or source is a value of its own.
    """
    d, names = len(STATS), list(STATS)
    part = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("null"))
    sizes = rows.groupBy("lang", "source").agg(F.count_if("fits").alias("n"))
    sizes = sizes.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.concat(F.lit("a"), part("lang"), F.lit("/"), part("source")).alias("grp"), F.concat(F.lit("b"), part("lang")).alias("lang_grp"), "n", F.min("n").over(Window.partitionBy("lang")).alias("least"))
    sizes = stage(spark, sizes, "groups")
    small = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    send = F.broadcast if small else lambda x: x
    least, everything = sizes.groupBy("lang_grp").agg(F.sum("n").alias("n")).agg(F.min("n"), F.sum("n")).first()
    rows = rows.join(send(sizes.drop("n")), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))).drop("g_lang", "g_source")
    # a language's rows make an estimate where it has a source that needs it, all rows where a language does
    levels = [F.col("grp"), F.when(F.col("least") < FULL, F.col("lang_grp")), *([F.lit("c")] if (least or 0) < FULL else [])]
    fit = rows.where("fits").select(F.explode(F.array_compact(F.array(*levels))).alias("grp"), *names)

    model = estimated(spark, fit, share, send)
    model = stage(spark, _factored(_shrunk(sizes, model, send)), "mcd")

    # scales: medians of the distances of a source's, a language's and all rows
    own = model.select("grp", "lang_grp", *[c for c in model.columns if c[:2] in ("m_", "l_", "d_")])
    binned = _distance(rows.where("fits").select("grp", *names).join(send(own), "grp")).groupBy("grp", "lang_grp", _bin(F.col("dist")).alias("bin")).agg(F.count("*").alias("n"))
    binned = binned.select(F.explode(F.array("grp", "lang_grp", F.lit("c"))).alias("key"), "bin", "n").groupBy("key", "bin").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("key").orderBy("bin")
    half = binned.withColumns({"to": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("key"))}).where("2 * to >= all").groupBy("key").agg(F.min("bin").alias("mid"))
    half = stage(spark, half.select("key", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("mid") + 1) / BINS) / _chi2_median(d)).alias("scale")), "mcd")
    for key, name in (("grp", "scale_own"), ("lang_grp", "scale_lang"), (F.lit("c"), "scale_all")):
        model = model.withColumn("key", F.col(key) if isinstance(key, str) else key).join(send(half.withColumnRenamed("scale", name)), "key", "left").drop("key")
    either = lambda u, x, y: F.coalesce(u * F.col(x) + (1 - u) * y, y)
    model = model.withColumn("scale", either(F.col("share"), "scale_own", either(F.col("lang_share"), "scale_lang", F.coalesce("scale_all", F.lit(1.0)))))
    model = stage(spark, model.select("grp", "scale", *[c for c in model.columns if c[:2] in ("m_", "l_", "d_")]), "mcd")
    out = _distance(rows.drop("lang_grp", "least").join(send(model), "grp", "left"))
    outlier = F.lit((everything or 0) >= FULL) & (F.col("dist") / F.col("scale") > cutoff)
    return out.withColumn("outlier", F.coalesce(outlier, F.lit(False)))


def _shrunk(sizes: DataFrame, model: DataFrame, send) -> DataFrame:
    """sizes (grp, lang_grp, n, ...), own estimates of sources, languages and all rows -> grp, lang_grp, share and
    lang_share (of the source's and the language's own centre), m_i, c_ij for every source."""
    d = len(STATS)
    m, c = [f"m_{i}" for i in range(d)], [f"c_{i}_{j}" for i, j in _cells()]
    renamed = lambda df, prefix, key: df.select(F.col("grp").alias(key), *[F.col(x).alias(prefix + x) for x in m + c])
    ramp = lambda n: F.least(F.lit(1.0), n / FULL)
    own = sizes.select("grp", "lang_grp", "n").join(send(model), "grp", "left")
    free = F.greatest(F.col("n") - 1, F.lit(0))
    langs = own.groupBy("lang_grp").agg(F.sum("n").alias("n"), F.sum(free).alias("free"), *[(F.sum(free * F.col(x)) / F.sum(F.when(free > 0, free))).alias(f"w_{x}") for x in c])
    langs = langs.join(send(renamed(model, "", "lang_grp")), "lang_grp", "left").withColumn("all_grp", F.lit("c")).join(send(renamed(model, "all_", "all_grp")), "all_grp", "left")
    langs = langs.withColumn("share", ramp(F.col("n"))).withColumn("weight", F.col("share"))
    langs = _mixed(langs, "all_", lambda i, j: F.col(f"all_c_{i}_{j}"))
    within = F.least(F.lit(1.0), F.col("free") / (FULL - 1))
    langs = langs.withColumns({f"w_{x}": F.when(within >= 1, F.col(f"w_{x}")).otherwise(within * F.coalesce(f"w_{x}", F.lit(0.0)) + (1 - within) * F.col(x)) for x in c})
    langs = langs.select("lang_grp", F.col("share").alias("lang_share"), *[F.col(x).alias(f"lang_{x}") for x in m + c], *[f"w_{x}" for x in c])
    out = own.join(send(langs), "lang_grp").withColumn("share", ramp(F.col("n"))).withColumn("weight", F.col("n") / (F.col("n") + FULL))
    u = F.col("share")
    out = _mixed(out, "lang_", lambda i, j: F.when(u >= 1, F.col(f"w_c_{i}_{j}")).otherwise(u * F.col(f"w_c_{i}_{j}") + (1 - u) * F.col(f"lang_c_{i}_{j}")))
    return out.select("grp", "lang_grp", "share", "lang_share", *m, *c)


def _chi2_median(d: int) -> float:
    return d * (1 - 2 / (9 * d)) ** 3


def _verdicts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs (..., text, lang, source) without text, with the counts, base_failed and kept."""
    stats = measured(docs).drop("text").withColumn("base_failed", base_failed()).withColumn("fits", ~F.col("base_failed"))
    stats = stage(spark, stats.select("*", *vector()), "stats")
    return outlying(spark, stats, **options).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))


def judged(spark: SparkSession, docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs (key, text, lang, source) -> key, the counts, base_failed, kept; one row for each row of docs.

    Null and empty texts have no words and fail the base rule. Ties and repeated rows are judged alike, as a row's
    verdict depends on its own counts and its group's estimate only; a null key is a key like others. An empty table gives
    an empty table.
    """
    rows = _verdicts(spark, docs.select(F.col(key).alias("doc_key"), "text", "lang", "source"), **options)
    return rows.select(F.col("doc_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filtered(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names: rows carry their verdict, no
    second reading or join of the texts is needed."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tm_doc"), "text", "lang", "source")
    return _verdicts(spark, whole, **options).where("kept").select("tm_doc.*")

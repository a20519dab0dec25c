"""Each stage of the pipeline on its own input, and the whole of it."""

from collections import Counter

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked_plainly(text, spans):
    """A text with its spans (kind, start, end), in order, replaced by kinds; overlapping ones by the first of them."""
    out, at, end = "", 0, 0
    for kind, a, e in spans:
        if a >= end:
            out, at = out + text[at:a] + f"[{kind.upper()}]", e
        end = at = max(end, e)
    return out + text[at:]


def test_pipeline(spark, sf):
    """Each stage on the rows of the one before, held against a plain version: counts and base rule of the quality rules,
    all pairs for near duplicates, regular expressions for base spans, the contract's shares, the sentencepiece library."""
    import sentencepiece
    from test_llm import base_spans, joined_plainly, plain_counts, shared_plainly

    from tidemark.llm import pii, quality_rules, sentencepieces

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "pii", "mixing", "sentencepiece"]
    text = dict(docs.select("doc_id", "text").collect())
    kept = corpus_pipeline.quality(spark, docs, sf).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    base = {i for i, t in text.items() if (c := plain_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    rejected = {r["doc_id"] for r in quality_rules.judged(spark, docs).where("not kept and not base_failed").collect()}
    assert kept.columns == COLUMNS and ids == base - rejected and len(rejected) < 0.1 * len(base)

    single = corpus_pipeline.near_duplicates(spark, kept, sf).cache()
    first = {c for _, _, c in joined_plainly([(i, text[i]) for i in ids])}
    assert {r["doc_id"] for r in single.collect()} == first and single.count() == len(first)

    hidden = corpus_pipeline.personal_data(spark, single, sf).cache()
    spans = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["found"]] for r in pii.found(spark, single).collect()}
    after = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert after == {i: masked_plainly(text[i] or "", spans[i]) for i in first} and hidden.columns == COLUMNS
    assert all({(pii.KINDS[k], a, e) for a, k, e in base_spans(text[i])} <= set(spans[i]) for i in first)

    mix = corpus_pipeline.mixture(spark, hidden, sf).cache()
    source = dict(hidden.select("doc_id", "source").collect())
    size = {i: len(t.split()) for i, t in after.items()}
    whole, taken = Counter(), Counter()
    for i, n in size.items():
        whole[source[i]] += n
    copies = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
        assert n <= 3
    assert mix.columns == COLUMNS
    for s, goal in shared_plainly(whole).items():
        largest = max(n for i, n in size.items() if source[i] == s)
        assert abs(taken[s] - goal) <= min(largest, 0.5 * goal + 60), s

    rows = corpus_pipeline.run(spark, sf).collect()
    right = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    assert Counter(r["doc_id"] for r in rows) == copies
    for r in rows:
        assert r["text"] == after[r["doc_id"]] and r["token_ids"] == right.encode(r["text"]) and r["n_tokens"] == len(r["token_ids"]) and r["parity"] and r["round_trip"]


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_rows_without_a_key_and_repeated_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = docs.limit(3).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.quality(spark, docs.union(odd), sf)
    assert {r["text"] for r in kept.where("doc_id is null").collect()} == {r["text"] for r in odd.collect()} & {r["text"] for r in kept.collect()}
    # rows without a key are copies of keyed ones, or of each other: one of each stays
    fresh = odd.limit(1).selectExpr("doc_id", "reverse(text) AS text", "lang", "source", "n_chars")
    once = corpus_pipeline.near_duplicates(spark, docs.union(docs.limit(4)).union(odd).union(fresh).union(fresh), sf)
    assert once.where("doc_id is null").count() == 1 and once.columns == COLUMNS
    assert once.where("doc_id is not null").count() == corpus_pipeline.near_duplicates(spark, docs, sf).count()


def test_stages_keep_columns_whose_names_clash(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumns({c: F.lit("own") for c in ("kept", "n_words", "tm_doc", "component_id", "fp", "found", "rate", "copies")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.where("kept <> 'own' or n_words <> 'own' or tm_doc <> 'own' or rate <> 'own'").count() == 0
        docs = after


def test_mixture_keeps_clashing_columns(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"size": F.lit("big"), "rate": F.lit(None).cast("string"), "copies": F.array(F.lit(1))})
    mix = corpus_pipeline.mixture(spark, docs, sf)
    assert mix.columns == docs.columns and mix.where("size <> 'big' OR rate IS NOT NULL").count() == 0 < mix.count()

"""The keyword leg without an index gives what it gives with one."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from lakedocs.operators import filters, keyword as K, keyword_scan as N
from lakedocs.plans import search as S

from test_hybrid import ASKED, FIELDS, NOW, corpus, made
from test_moved import moved

WORDS = "red green the blue stone river of lamp paper glass".split()


def test_scan_is_the_index(spark):
    """Words, phrases, alternatives, excluded words, stop words, texts that are null or without terms, cut at k, ties."""
    r = random.Random(4)
    texts = [(f"c{k:02}", " ".join(r.choices(WORDS, k=r.randrange(12)))) for k in range(60)] + [("n", None), ("s", "the of")]
    texts += [(f"t{k}", "red stone") for k in range(5)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    live = chunks.filter("chunk_id <> 'c07'").select("chunk_id", *[F.lit("x").alias(c) for c in ("doc_id", "mime", "uri", "filename", "vendor")], F.array(F.lit("p")).alias("types"))
    asked = ["red stone", '"red stone" lamp', 'blue-river -paper', '"red the lamp" or "green stone" glass', "-red", "the of", "none here", 'paper -"red stone"', '"red green" "stone river"', "", None]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    postings = K.build_postings(K.analyze(chunks)).cache()
    for k in (3, 100):
        got = {tuple(x) for x in N.keyword_scan(q, chunks, live, k).select("query_id", "chunk_id", "rank", F.round("score", 7)).collect()}
        want = K.keyword_topk(q, postings, k, mode="any", passing=lambda found: filters.passing(found, q, live))
        assert got == {tuple(x) for x in want.select("query_id", "chunk_id", "rank", F.round("score", 7)).collect()} and len({x[0] for x in got}) >= 5


def test_search_without_postings(spark, tmp_path):
    """All restrictions; and rows moved for the leg: those of chunks and first hits alone."""
    docs, chunks, invoices = made()
    r = random.Random(9)
    vec = {c[0]: [r.uniform(-1, 1) for _ in range(6)] for c in chunks}
    c = corpus(spark, str(tmp_path / "i"), vec, docs, chunks, invoices)
    get = ("doc_ids", "types", "mime_any", "uri_like", "filename_like", "vendor_like", "boost_types")
    q = spark.createDataFrame([(i, s, [r.uniform(-1, 1) for _ in range(6)], *[w.get(f) for f in get], None) for i, s, w in ASKED], FIELDS)
    rows = [sorted(tuple(x) for x in S.search(q, x, F.lit("2024-06-01"), F.lit(NOW).cast("timestamp"), k=6).select("query_id", "rank", "chunk_id", "window_expanded").collect()) for x in (c, replace(c, postings=None))]
    assert rows[0] == rows[1] and len(rows[0]) > 30
    many = q.crossJoin(spark.range(40)).withColumn("query_id", (F.col("query_id") * 100 + F.col("id")).cast("int")).drop("id").cache()
    assert many.count() == 400
    n = [moved(spark, lambda x=x: S.keyword_leg(many, x, 2).collect()) for x in (c, replace(c, postings=None))]
    assert n[1] < 3000 < n[0]

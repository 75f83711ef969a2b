"""How many rows steps move, and results where they move fewer."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lakedocs.functions import text as T
from lakedocs.operators import blocks as B, filters, fusion as H, graph as G, inverted_index as I, keyword as K, vectors as V
from lakedocs.plans import search as S


def moved(spark, run) -> int:
    """Rows written to shuffles while ``run`` is at work."""
    sc = spark.sparkContext

    def written():
        store, jvm = sc._jsc.sc().statusStore(), sc._jvm
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = set(written())
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in written().items() if k not in before)


BLOCK = "block_id string, doc_id string, pos int, page int, type string, text string, meta struct<level:int>"


def test_siblings_stay_with_their_parent(spark):
    b = spark.createDataFrame([(f"b{k}", "d", k, 1, "paragraph", "x", (None,)) for k in range(400)], BLOCK)
    nodes, edges = G.graph_nodes(b).cache(), G.contains_edges(b).unionByName(G.follows_edges(b)).cache()
    assert nodes.count() == 401 and edges.count() == 799
    got = []
    n = moved(spark, lambda: got.append(G.graph_neighbors(b.select(F.col("block_id").alias("seed_id"), "block_id"), nodes, edges).groupBy("rel").count().collect()))
    by = {r["rel"]: r["count"] for r in got[0]}
    assert by == {"follows": 399, "incoming_contains": 400, "incoming_follows": 399, "shared_parent": 400 * 29 + 2}
    # It was 30,765: siblings alone are 11,602 rows, moved more than once.
    assert n < 15000


def test_neighbors_are_those_of_a_plain_version(spark):
    """Seeds of several blocks, nodes of several parents, relations that sort behind siblings, ids that are no hashes."""
    r = random.Random(3)
    rows = [(f"n{k}" if k % 3 else f"{k:064x}", "d", f"b{k}" if k else None, r.randrange(6)) for k in range(40)]
    ids = [x[0] for x in rows]
    links = sorted({(r.choice(ids + ["gone"]), r.choice(ids), r.choice(["contains", "follows", "zoned"])) for _ in range(120)})
    seeds = [(f"s{k % 7}", f"b{k}") for k in range(1, 40, 2)]
    nodes = spark.createDataFrame(rows, "node_id string, doc_id string, source_block_id string, pos int")
    edges = spark.createDataFrame(links, "src_node_id string, dst_node_id string, rel_type string")
    pos, own = {x[0]: x[3] for x in rows}, {x[2]: x[0] for x in rows}
    kids = {s: sorted({b for a, b, _ in links if a == s}, key=lambda x: (pos[x], x)) for s, _, _ in links}
    for limit in (3, 32):
        want = set()
        for seed in {s for s, _ in seeds}:
            found = set()
            for x in (own[b] for s, b in seeds if s == seed):
                found |= {(rel, pos[b], b) for a, b, rel in links if a == x} | {("incoming_" + rel, pos[a], a) for a, b, rel in links if b == x and a in pos}
                found |= {("shared_parent", pos[y], y) for p in {a for a, b, _ in links if b == x} for y in kids[p][: limit + 1] if y != x}
            want |= {(seed, n + 1, *f) for n, f in enumerate(sorted(found)[:limit])}
        out = G.graph_neighbors(spark.createDataFrame(seeds, "seed_id string, block_id string"), nodes, edges, limit).collect()
        assert {(x["seed_id"], x["rank"], x["rel"], x["pos"], x["node_id"]) for x in out} == want and len(out) == len(want)
        assert all((own.get(x["source_block_id"]) or ids[0]) == x["node_id"] for x in out)


def test_vector_search_writes_no_pairs(spark):
    """Tasks return k rows a query, by buckets too; scores are rounded and weighted before the cut; equal vectors tie."""
    r = random.Random(1)
    vecs = [(k, [r.gauss(0, 1) for _ in range(8)] if k % 50 else [1.0] * 8, k % 3) for k in range(1200)]
    index = spark.createDataFrame(vecs, "chunk_id long, embedding array<float>, w int").repartition(2).cache()
    asked = index.filter("chunk_id < 60").select(F.col("chunk_id").alias("query_id"), "embedding").cache()
    assert asked.count() == 60 and index.count() == 1200
    for run in (lambda: V.vector_topk_lsh(asked, index, 3, 6, 3), lambda: V.vector_topk(asked, index, 3)):
        got = []
        assert moved(spark, lambda run=run, got=got: got.extend(run().collect())) <= 2 * 60 * 3 + 10  # and two of a count
        assert [x["chunk_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 0] == [0, 50, 100]
    unit = {k: [x / math.hypot(*v) for x in v] for k, v, _ in [(k, [float(np.float32(x)) for x in v], w) for k, v, w in vecs]}
    out = V.vector_topk(asked, index, 5, digits=2, weight="w").collect()
    for q in range(0, 60, 7):
        s = {k: round(sum(a * b for a, b in zip(unit[q], unit[k])), 2) * w for k, _, w in vecs}
        assert [x["chunk_id"] for x in sorted(out, key=lambda x: x["rank"]) if x["query_id"] == q] == sorted(s, key=lambda k: (-s[k], k))[:5]


def test_index_takes_so_many_words_at_once(spark, monkeypatch):
    r = random.Random(2)
    texts = [(f"c{k}", " ".join(r.choice(["red", "green", "blue", "the"]) for _ in range(r.choice([0, 5, 30, 90])))) for k in range(80)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").coalesce(1)
    whole = {(x["term"], x["chunk_id"]): x["positions"] for x in I._opened(I.blocks_of(chunks)).collect()}
    monkeypatch.setattr(I, "WORDS", 60)
    rows = I.blocks_of(chunks).collect()
    assert max(len(x["positions"]) for x in rows) <= 90 and sum(x["leads"] for x in rows) == sum(bool(set(t.split()) - {"the"}) for _, t in texts)
    assert {(x["term"], x["chunk_id"]): x["positions"] for x in I._opened(I.blocks_of(chunks)).collect()} == whole


def test_hits_fetch_their_texts(spark):
    """However many they are; a few go to the texts, which stay where they are."""
    chunks = spark.range(2000).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text")).cache()
    hits = spark.createDataFrame([(q, str(q * 7), 0.5) for q in range(20)], "query_id int, chunk_id string, score double")
    assert chunks.count() == 2000
    for most, rows in ((100, 100), (3, 10**9)):
        got = []
        assert moved(spark, lambda most=most, got=got: got.extend(H.fetched(hits, chunks, most).collect())) < rows
        assert sorted((x["query_id"], x["text"]) for x in got) == [(q, f"text {q * 7}") for q in range(20)]


def test_numbers_find_all_their_invoices(spark):
    """By whole numbers and parts, of any length; limits are the caller's; numbers that are long are asked by a wider pattern."""
    inv = spark.createDataFrame([(k, f"INV-{1996 + k % 2}-{k}") for k in range(0, 4000)] + [(9001, "xx-inv-1996-12-INV-1996-1"), (9002, None), (9003, "AB12"), (9004, "INV-1996-1234567")], "invoice_id int, invoice_number string")
    asked = ["of inv-1996-1 now", "INV-1996-3998", "nothing", None, "NV-1997-39", "AB12-5", "AB120", "inv-1996-1234567", "of inv-1996-1 again"]
    q = spark.createDataFrame([(k, s, ["7"] if k == 2 else None) for k, s in enumerate(asked)], "query_id int, q string, doc_ids array<string>")
    wide = filters.INVOICE_NUMBER.replace("{1,6}", "{1,18}")
    rows = [(str(x["invoice_id"]), (x["invoice_number"] or "").upper()) for x in inv.collect()]
    for limit in (None, 50):
        for pattern in (filters.INVOICE_NUMBER, wide):
            got = {x["query_id"]: x["doc_ids"] for x in filters.restrict_by_number(q, inv, limit, pattern).collect()}
            for k, s in enumerate(asked):
                m = re.search(pattern, (s or "").upper())
                want = sorted(i for i, n in rows if m and m[1] in n)[:limit]
                assert got[k] == (want or (["7"] if k == 2 else [])), (k, limit)
    assert len(got) == len(asked)


def test_common_beginnings_move_no_other_invoices(spark):
    inv = spark.range(5000).select("id", F.concat(F.lit("INV-"), (F.col("id") % 10 + 1990).cast("string"), F.lit("-"), "id").alias("invoice_number")).withColumnRenamed("id", "invoice_id").cache()
    q = inv.filter("invoice_id < 500").select(F.col("invoice_id").alias("query_id"), F.concat(F.lit("INV-1996-"), "invoice_id").alias("q"), F.array().cast("array<string>").alias("doc_ids")).cache()
    assert inv.count() == 5000 and q.count() == 500
    # It was eleven pieces of each invoice, and eight rows of each question.
    assert moved(spark, lambda: filters.restrict_by_number(q, inv, None).collect()) < 10000


def test_pages_are_parsed_a_few_at_once(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"<h1>t{k}</h1><p>{'x' * (k * 13 % 70)}</p>" if k % 5 else None) for k in range(60)], "doc_id int, html string").coalesce(1)
    whole = B.html_to_artifacts(pages, "doc_id", "html").orderBy("doc_id", "pos").collect()
    monkeypatch.setattr(B, "PARSED", 100)
    assert B.html_to_artifacts(pages, "doc_id", "html").orderBy("doc_id", "pos").collect() == whole and len(whole) > 60


def test_vectors_are_made_where_texts_are(spark):
    rows = spark.createDataFrame([(k, "red moon red " * (k % 5)) for k in range(50)], "k long, t string")
    assert moved(spark, lambda: V.hash_embed(rows, "k", "t", 16).collect()) == 0


def test_only_the_graph_of_hits_is_moved(spark):
    """Vector search: the blocks of 59 documents without a first hit stay where they are."""
    b = spark.createDataFrame([(f"b{d}-{k}", f"d{d}", k, 1, "paragraph", "x", (None,)) for d in range(60) for k in range(30)], BLOCK)
    meta = "struct<source_block_ids:array<string>,context_headers:array<string>,types:array<string>>"
    chunks = spark.createDataFrame([(f"c{d}-{k}", f"d{d}", ([f"b{d}-{k}"], [], ["paragraph"])) for d in range(60) for k in range(30)], f"chunk_id string, doc_id string, meta {meta}")
    docs = spark.createDataFrame([(f"d{d}", "t", "text/plain", f"u{d}", "STORED") for d in range(60)], "doc_id string, tenant_id string, mime string, uri string, state string").withColumn("collected_at", F.lit("2020-01-01").cast("timestamp"))
    index = spark.createDataFrame([(f"c{d}-{k}", [1.0, 0.0] if (d, k) == (7, 3) else [0.1, float(d + 1)]) for d in range(60) for k in range(30)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, "x", [1.0, 0.0], None, None)], "query_id int, q string, embedding array<double>, doc_ids array<string>, types array<string>")
    c = S.Corpus(chunks, docs, index, None, G.graph_nodes(b), G.contains_edges(b).unionByName(G.follows_edges(b)))
    got = []
    n = moved(spark, lambda: got.append({x["chunk_id"]: x["score"] for x in S.search_vector(asked, c, 1, F.lit("2024-06-01").cast("timestamp")).collect()}))
    assert {f"c7-{k}" for k in range(30)} <= set(got[0]) and abs(got[0]["c7-4"] - 0.6) < 1e-9
    assert n < 15000


def test_a_scan_moves_no_runs_of_texts(spark):
    """For each question no more than the chunks that hold its terms, and ``limit`` from each task."""
    r = random.Random(2)
    texts = [(f"c{k:03}", f"d{k}", " ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(60)) + (" needle lamp" if k % 20 == 0 else "")) for k in range(200)]
    chunks = spark.createDataFrame(texts, "chunk_id string, doc_id string, text string").repartition(2).cache()
    assert chunks.count() == 200
    asked = spark.createDataFrame([(1, ["EEDLE"]), (2, ["dle la", "nothing"])], "query_id int, terms array<string>")
    got = []
    n = moved(spark, lambda: got.extend(K.scan_any_terms(chunks, asked, limit=4).collect()))
    assert {(x["query_id"], x["chunk_id"], x["rank"]) for x in got} == {(q, f"c{k:03}", k // 20 + 1) for q in (1, 2) for k in (0, 20, 40, 60)}
    assert n < 60


def test_edges_are_made_once(spark):
    """Neighbours of hits read nodes and edges several times; what those are made of is read once for each."""
    b = spark.createDataFrame([(f"b{k}", "d", k, 1, "paragraph", "x", (None,)) for k in range(40)], BLOCK)
    made = spark.sparkContext.accumulator(0)

    def same(x):
        made.add(1)
        return x

    edges = G.contains_edges(b).unionByName(G.follows_edges(b)).withColumn("src_node_id", F.udf(same)("src_node_id"))
    chunks = b.select(F.col("block_id").alias("chunk_id"), "doc_id", F.struct(F.array("block_id", "block_id").alias("source_block_ids")).alias("meta"))
    hits = spark.createDataFrame([(1, 1, "b3", 0.5)], "query_id int, rank int, chunk_id string, score_vec double")
    got = G.expand_hits(hits, G.graph_nodes(b), edges, chunks).collect()
    # Of 32 neighbours, the next block, the root, the block before and 29 siblings; both blocks are siblings, too.
    assert {(x["query_id"], x["score_graph"], x["from_rank"]) for x in got} == {(1, 0.3, 1)} and len({x["chunk_id"] for x in got}) == len(got) == 29
    assert made.value == 79


def test_blank_is_told_by_the_first_character(spark):
    """As ``strip`` tells it, but a text isn't gone through for that."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["", "".join(spaces), *spaces, *(f"{a}x{a}" for a in spaces), "​", "﻿ ", " \n⁠", "a\u0085", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [(x[0], x[1]) for x in df.select(T.filled(F.col("text")), T.strip(F.col("text")) != "").collect()] == [(None if t is None else t.strip() != "",) * 2 for t in texts]
    docs = df.withColumn("doc_id", F.monotonically_increasing_id())
    blocks = B.artifacts_to_blocks(B.text_to_artifacts(docs, "line"))
    assert "regexp_replace" not in blocks._jdf.queryExecution().optimizedPlan().toString()

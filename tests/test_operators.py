"""Operators that SQL doesn't express, on rows worked out by hand."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from lakedocs.functions import dates, keys, text as T
from lakedocs.operators import blocks as B, chunks as C, context as A, facts, fusion as H, graph as G, keyword as K
from lakedocs.sources import ingest, tables
from lakedocs.streaming import streams

HTML = """<html><head><style>x</style></head><body><section data-page="1"><h1>One</h1><p>a <b>b</b></p><h3>Deep</h3><ul><li>x</li><li>y<ul><li>z</li></ul></li></ul>
<h2>Two</h2><table><tr><td>k</td><td>v</td></tr><tr><td></td></tr><tr><td>1</td></tr></table></section><section data-page="2"><p>next</p><figure><img alt="cat"><figcaption>A cat</figcaption></figure><pre>code
 x</pre><script>no</script></section></body></html>"""


def test_html_and_header_chain(spark):
    pages = spark.createDataFrame([("d", HTML), ("n", None)], "page_id string, html string")
    got = B.with_header_chain(B.html_to_artifacts(pages)).orderBy("pos").collect()
    kinds = [r["type"] for r in got]
    assert kinds.count("header") == 3 and "table" in kinds and "image" in kinds and "code" in kinds
    by = {(r["type"], r["text"].split("\n")[0]): r for r in got}
    assert by[("header", "Deep")]["headers"] == ["One", ""] and by[("header", "Two")]["headers"] == ["One"]
    table = next(r for r in got if r["type"] == "table")
    assert table["headers"] == ["One", "Two"] and table["rows"] == 2 and table["text"] == "k | v\n1"
    assert next(r for r in got if r["text"] == "next")["headers"] == []
    image = B.artifacts_to_blocks(B.with_header_chain(B.html_to_artifacts(pages))).filter("type = 'image'").first()
    assert image["text"] == "[Image: A cat]"


def test_split_text_loses_nothing():
    for text in ("word " * 5000, "x" * 9000, "a. b? c! " * 900, "", "one\n\ntwo " * 700):
        parts = C.split_text(text, 100, 0)
        assert "".join(parts) == text
        assert all(len(p) <= 400 for p in parts)


def test_chunks_cover_blocks(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i} " + "word " * (i % 40) for i in range(200))), (2, "short"), (3, "y" * 9000), (4, None)], "doc_id long, text string")
    b = B.with_spans(B.artifacts_to_blocks(B.text_to_artifacts(docs, "line")))
    c = C.chunk_documents(b).orderBy("doc_id", "ordinal").collect()
    assert {r["doc_id"] for r in c} == {"1", "2", "3"}
    one = " ".join(r["text"] for r in c if r["doc_id"] == "1")
    assert all(f"line {i}" in one for i in range(200))
    assert sum(len(r["text"]) for r in c if r["doc_id"] == "3") >= 9000
    assert C.chunk_documents(b).select("chunk_id").collect() == C.chunk_documents(b).select("chunk_id").collect()


def test_graph(spark):
    rows = [("d", "b0", 0, "paragraph", None), ("d", "b1", 1, "header", 1), ("d", "b2", 2, "paragraph", None), ("d", "b3", 3, "header", 3), ("d", "b4", 4, "header", 2), ("d", "b5", 5, "paragraph", None)]
    b = spark.createDataFrame(rows, "doc_id string, block_id string, pos int, type string, level int").select("*", F.lit(1).alias("page"), F.col("block_id").alias("text"), F.struct("level").alias("meta"))
    nodes, edges = G.graph_nodes(b), G.contains_edges(b)
    label = {r["node_id"]: r["label"] for r in nodes.collect()}
    assert {label[r["dst_node_id"]]: label[r["src_node_id"]] for r in edges.collect()} == {"b0": "d", "b1": "d", "b2": "b1", "b3": "b1", "b4": "b1", "b5": "b4"}
    near = G.graph_neighbors(spark.createDataFrame([("s", "b4")], "seed_id string, block_id string"), nodes, edges).collect()
    assert {(r["rel"], r["source_block_id"]) for r in near} == {("contains", "b5"), ("incoming_contains", "b1"), ("shared_parent", "b2"), ("shared_parent", "b3")}


def test_websearch(spark):
    post = K.build_postings(K.analyze(spark.createDataFrame([("a", "red fox runs"), ("b", "fox red"), ("c", "red hen"), ("d", "blue hen")], "chunk_id string, text string")))
    ask = lambda q, **k: {r["chunk_id"] for r in K.keyword_topk(spark.createDataFrame([(1, q)], "query_id int, q string"), post, 10, **k).collect()}
    assert ask("red fox") == {"a", "b"}
    assert ask('"red fox"') == {"a"}
    assert ask("red -hen") == {"a", "b"}
    assert ask("fox or blue") == {"a", "b", "d"}
    assert ask("red fox", scorer="cover") == {"a", "b"}
    assert K.stem("parties") == "party" and K.stem("running") == "run" and K.stem("glass") == "glass"


def test_mmr_picks_unlike(spark):
    rows = [(1, "a", 1.0, 1, "x y z"), (1, "b", 0.99, 2, "x y z"), (1, "c", 0.9, 3, "p q r")]
    got = H.mmr(spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int, text string"), 1).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["a", "c"]


def test_pack_context(spark):
    rows = [(1, k, f"c{k}", "d1" if k < 4 else "d2", f"text {k}", ["paragraph"], ["b"], k, k, "u", 1.0 / k) for k in range(1, 6)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, doc_id string, text string, types array<string>, source_block_ids array<string>, page_start int, page_end int, uri string, score double")
    q = spark.createDataFrame([(1, "what")], "query_id int, q string")
    turns = [r["chunk_id"] for r in A.round_robin(hits, q).orderBy("turn").collect()]
    assert turns == ["c1", "c4", "c2", "c5", "c3"]
    out = A.pack_context(hits, q).first()
    assert [f["n"] for f in out["footnotes"]] == [1, 2, 3, 4] and out["context"].startswith("Source ID: [^1]\nDocument: u\nPage: 1\nContent:\ntext 1\n---")


def test_dates(spark):
    day = F.lit("2024-01-10")
    ask = lambda q: spark.range(1).select(dates.parse_date_range(F.lit(q), day).alias("r")).first()["r"]
    assert tuple(ask("last month")) == (dt.date(2023, 12, 1), dt.date(2023, 12, 31))
    assert tuple(ask("last quarter")) == (dt.date(2023, 10, 1), dt.date(2023, 12, 31))
    assert tuple(ask("February 2024")) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert ask("nothing") is None
    one = spark.range(1).select(*[dates.parse_date(F.lit(s)).alias(f"c{i}") for i, s in enumerate(["2024-02-30", "5/6/2024", "1-Jan-2024", "Jan 3, 2024"])]).first()
    assert list(one) == [None, dt.date(2024, 6, 5), dt.date(2024, 1, 1), dt.date(2024, 1, 3)]


def test_facts(spark):
    q = spark.createDataFrame([(1, "what is the total of INV-2024-001?"), (2, "student name and fees"), (3, "invoice total for march")], "query_id int, q string")
    r = {x["query_id"]: x for x in facts.route(q).collect()}
    assert r[1]["invoice_no"] == "INV-2024-001" and r[2]["fact_kind"] == "student_fees" and r[3]["intent"] == "HYBRID"
    chunks = spark.createDataFrame([("c1", "d1", "Invoice INV-2024-001\nTotal: 1,234.50"), ("c2", "d2", "Student Name: Ann Lee\nTotal: 50")], "chunk_id string, doc_id string, text string")
    none = spark.createDataFrame([], "invoice_id string, invoice_number string, total double")
    f = facts.invoice_total_facts(facts.route(q), none, chunks).first()
    assert f["value"] == 1234.5 and f["chunk_id"] == "c1" and f["confidence"] == 0.7
    s = facts.student_fee_facts(facts.route(q), chunks).first()
    assert s["student"].startswith("Ann Lee") and s["value"] == 1234.5


def test_text(spark):
    row = spark.createDataFrame([(" a \n\n b\t", "x [^1][^3][^1]", "Total: 1234.50", None)], "a string, b string, c string, d string")
    got = row.select(T.norm_text(F.col("a")), T.citation_numbers(F.col("b")), T.labelled_totals(F.col("c")), T.est_tokens(F.col("d")), T.groundedness(F.col("d"), F.col("a")), keys.page_of(F.create_map(F.lit("page"), F.lit(" 7 ")))).first()
    assert list(got) == ["a\nb", [1, 3], [1234.5], 0, 0.0, 7]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "doc_id string, v int")
    tables.replace_partitions(a, path, ["doc_id"])
    for _ in range(2):
        out = tables.replace_partitions(spark.createDataFrame([("d1", 9)], "doc_id string, v int"), path, ["doc_id"])
    assert sorted(map(tuple, out.collect())) == [("d1", 9), ("d2", 3)]
    tree = {"body": {"children": [{"$ref": "#/texts/1"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/nope/3"}]}, "texts": [{"text": "no"}, {"text": "yes", "label": "formula", "children": [{"$ref": "#/texts/0"}]}], "tables": [{"text": "t"}]}
    got = tables.from_ref_tree(spark.createDataFrame([("d", json.dumps(tree)), ("e", "oops")], "doc_id string, tree_json string")).collect()
    assert [(r["type"], r["text"]) for r in got] == [("equation", "yes"), ("text", "no"), ("table", "t")]
    arts = spark.createDataFrame([("d", 0, "header", "T"), ("d", 1, "table", "x")], "doc_id string, pos int, type string, text string")
    tables.write_manifests(arts, str(tmp_path / "m"))
    assert [r["type"] for r in tables.read_manifests(spark, str(tmp_path / "m")).orderBy("pos").collect()] == ["header", "table"]


def test_ingest_policy(spark):
    rows = [("t", "a.exe", None, b"x"), ("t", "e.txt", None, b""), ("t", "b.txt", None, b"hi"), ("t", "c.txt", None, b"hi"), ("u", "c.txt", None, b"hi")]
    got = {(r["tenant_id"], r["filename"]): r for r in ingest.ingest(spark.createDataFrame(rows, "tenant_id string, filename string, declared_mime string, content binary")).collect()}
    assert got["t", "e.txt"]["state"] == "REJECTED" and got["t", "a.exe"]["warnings"] == ["extension_denied"]
    assert [got[k]["duplicate"] for k in (("t", "b.txt"), ("t", "c.txt"), ("u", "c.txt"))] == [False, True, False]


def test_streams(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("first line\nsecond line")
    (tmp_path / "in/b.txt").write_text("first line\nsecond line")
    for _ in range(2):
        streams.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert tables.current(spark, str(tmp_path / "out/documents")).count() == 1
    assert tables.current(spark, str(tmp_path / "out/blocks")).count() == 2
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = streams.rate_guard_stream(live, 1, "1000 days").writeStream.outputMode("complete").format("memory").queryName("guard").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("guard").agg(F.sum("n")).first()[0] == ev.count()


def test_lsh_recall(spark, sf):
    from lakedocs import catalog

    found = {(r["query_id"], r["chunk_id"]) for r in catalog.queries()["V6_vector_topk_lsh"](spark, sf).collect()}
    true = {(r["query_id"], r["chunk_id"]) for r in catalog.queries()["V5_vector_topk"](spark, sf).collect()}
    assert len(found & true) >= 0.9 * len(true)


def search_tables(spark, d):
    """Documents, questions and invoices of a small corpus."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    docs = [(i, "\n".join(" ".join(r.choice(vocab) for _ in range(150)) for _ in range(24)), "en", f"src{i % 3}", 0) for i in range(1, 25)]
    orders = [(k, 1, dt.date(1996, 3, k) if k < 9 else dt.date(2001, 1, k - 8), 5.0) for k in range(1, 23)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, docs[i][1][:400]) for i in range(3)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, "c")], "c_custkey long, c_name string").write.parquet(f"{d}/customer.parquet")


def test_search_vector_expands(spark, tmp_path):
    """Vector search with its graph, against every pair of question and chunk."""
    from lakedocs.operators import vectors as V
    from lakedocs.plans import data as D, queries_search as Q, search as S

    d = str(tmp_path)
    search_tables(spark, d)
    c = Q.corpus(spark, d)
    q = D.search_questions(spark, d)
    q = q.join(V.hash_embed(q, "query_id", "q", 64), "query_id")
    found = {(x["query_id"], x["chunk_id"]): x["score"] for x in S.search_vector(q, c, 10, F.lit(D.NOW).cast("timestamp")).collect()}
    of = {x["chunk_id"]: x["doc_id"] for x in c.chunks.filter("cast(doc_id as int) <> 17").select("chunk_id", "doc_id").collect()}
    vec = {x["chunk_id"]: x["embedding"] for x in c.index.collect()}
    want = {}
    for x in q.collect():
        cos = {k: sum(a * b for a, b in zip(x["embedding"], vec[k])) for k in of}
        top = sorted(of, key=lambda k: (-round(cos[k], 9), k))[:60]
        want |= {(x["query_id"], k): cos[k] for k in top}
        for hit in top[:10]:
            for k in of:
                if of[k] == of[hit] and k not in top:
                    want.setdefault((x["query_id"], k), 0.6 * cos[hit])
    assert len(of) > 60 and len(want) > 60 * q.count()
    assert set(found) == set(want) and all(abs(found[k] - v) < 1e-5 for k, v in want.items())

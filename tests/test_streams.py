"""Streams against their batch twins: batches twice, lost runs, late rows, state that goes."""

from __future__ import annotations

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakedocs.operators import inverted_index as I, keyword as K
from lakedocs.plans import reports as R
from lakedocs.sources.store import Store
from lakedocs.streaming import streams as S

WORDS = [f"word{k}" for k in range(50)]
DOC = "doc_id string, tenant_id string, text string"


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Small tables in few files."""
    monkeypatch.setattr(S, "CORPUS", {n: dataclasses.replace(t, buckets=3) for n, t in S.CORPUS.items()})
    monkeypatch.setattr(I, "BUCKETS", 3)


def docs(spark, ids, seed, lines=30):
    r = random.Random(seed)
    return spark.createDataFrame([(i, "t", "\n".join(" ".join(r.choices(WORDS, k=40)) for _ in range(lines))) for i in ids], DOC)


def contents(store):
    """All tables as a reader sees them, and the index."""
    out = {n: sorted(map(str, store.read(n).drop("positions").collect())) for n in S.CORPUS}
    index = S.corpus_index(store.spark, store.root)
    out["terms"] = sorted(map(str, index.terms().collect()))
    out["postings"] = sorted(map(str, index.postings().collect()))
    return out


def test_documents_by_one_commit(spark, tmp_path):
    """A run lost between two tables, and batches delivered twice, leave what one undisturbed run leaves."""
    one, two = docs(spark, "abcd", 1), docs(spark, "cde", 2)
    plain = S.corpus_store(spark, str(tmp_path / "plain"))
    for n, d in enumerate((one, two)):
        S.put_documents(plain, d, "s", n)
    want = contents(plain)

    store = S.corpus_store(spark, str(tmp_path / "lost"))
    S.put_documents(store, one, "s", 0)
    before, inner = contents(store), Store._written

    def lost(self, name, *rest):
        if name == "edges":
            raise KeyboardInterrupt
        return inner(self, name, *rest)

    Store._written = lost
    try:
        with pytest.raises(KeyboardInterrupt):
            S.put_documents(store, two, "s", 1)
    finally:
        Store._written = inner
    assert contents(store) == before
    for _ in range(2):
        S.put_documents(S.corpus_store(spark, store.root), two, "s", 1)
    assert contents(store) == want and store.commit().number == 1
    S.put_documents(store, two)
    assert contents(store) == want, "the same documents under no batch's name"
    # All tables are of the same documents, and the index answers for them.
    ids = {r["doc_id"] for r in store.read("documents").collect()}
    assert ids == set("abcde") and all({r["doc_id"] for r in store.read(n).select("doc_id").distinct().collect()} == ids for n in ("blocks", "chunks", "nodes", "edges", "vectors"))
    chunks = {r["chunk_id"]: r["text"] for r in store.read("chunks").collect()}
    found = {r["chunk_id"] for r in K.keyword_topk(spark.createDataFrame([(1, "word7")], "query_id int, q string"), S.corpus_index(spark, store.root), 10**6).collect()}
    assert found == {c for c, t in chunks.items() if "word7" in t.split()}
    assert {r["chunk_id"] for r in store.read("vectors").collect()} == set(chunks)


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a", "first line\nsecond line"), ("b", "first line\nsecond line"), ("c", "third")):
        (tmp_path / f"in/{name}.txt").write_text(text)
    for _ in range(2):
        S.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    store = S.corpus_store(spark, str(tmp_path / "out"))
    first = contents(store)
    assert store.read("documents").count() == 2 and store.read("blocks").count() == 3 and store.commit().number == 0
    # A new checkpoint delivers all again: their hashes are known.
    S.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    (tmp_path / "in/d.txt").write_text("third\nfourth")
    S.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert store.read("documents").count() == 3 and set(first["postings"]) < set(contents(store)["postings"])


def test_dedupe_against_the_stored(spark, tmp_path):
    """A hash stored by a batch long ago, and one within a batch."""
    row = "doc_id string, tenant_id string, sha256 string"
    batches = [[("a", "t", "1"), ("b", "t", "2"), ("c", "t", "1")], [("d", "u", "1"), ("e", "t", "3")], [("f", "t", "1"), ("g", "u", "1"), ("h", None, None), ("i", "t", "3")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, row).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.dedupe_into(spark.readStream.schema(row).parquet(str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    store = Store(spark, str(tmp_path / "s"), dict(S.SEEN))
    S.put_hashes(store, spark.createDataFrame(batches[1], row), str(tmp_path / "cp"), 1)
    assert store.commit().number == 2
    assert {tuple(r) for r in store.read("duplicates").collect()} == {("c", "a"), ("f", "a"), ("g", "d"), ("i", "e")}


@pytest.mark.parametrize(("size", "slide"), [("1 hour", "1 hour"), ("24 hours", "1 hour")])
def test_counts_and_late_rows(spark, tmp_path, size, slide):
    """Rows out of order over several batches: counts and late rows add up to the batch twin."""
    r = random.Random(1)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    batches = [[(f"{n}-{k}", start + dt.timedelta(minutes=r.randrange(600 * n, 600 * n + 700))) for k in range(60)] for n in range(3)]
    batches[2] += [("old", start + dt.timedelta(minutes=5)), ("old", start + dt.timedelta(minutes=6)), ("old", start + dt.timedelta(minutes=65)), ("none", None)]
    row, path = "event_id string, ts timestamp", str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, row).coalesce(1).write.mode("append").parquet(path)
        for _ in range(2):
            S.counts_into(spark.readStream.schema(row).parquet(path), str(tmp_path / "s"), str(tmp_path / "cp"), size, slide, "30 minutes").awaitTermination()
    store = Store(spark, str(tmp_path / "s"), dict(S.COUNTED))
    counts, late = ({x["start"]: x["n"] for x in store.read(n).groupBy("start").agg(F.sum("n").alias("n")).collect()} for n in ("counts", "late"))
    want = {x["w"]["start"]: x["n"] for x in spark.read.parquet(path).filter("ts is not null").groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: counts.get(k, 0) + late.get(k, 0) for k in {*counts, *late}} == want
    assert sum(late.values()) >= 3 and min(late) < dt.datetime(2024, 1, 1, 1)


def test_progress_state_goes(spark, tmp_path):
    """The batch twin's rows; state of documents without events for longer than it is kept is dropped."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    r = random.Random(2)
    row, path = "event_id string, doc_id string, stage string, status string, ts timestamp", str(tmp_path / "in")
    stages = ["STORED", "NORMALIZED", "EXTRACTED", "CHUNKED", "EMBEDDED", "GENERATE", None]
    batches = [[(f"{n}-{k}", f"d{n}{r.randrange(20)}", r.choice(stages), r.choice(["OK", "OK", "ERROR"]), start + dt.timedelta(hours=48 * n, minutes=r.randrange(600))) for k in range(80)] for n in range(3)]
    batches[0].append(("x", None, "STORED", "OK", start))
    rows_in_state = []
    for rows in batches:
        spark.createDataFrame(rows, row).coalesce(1).write.mode("append").parquet(path)
        q = S.progress_into(spark.readStream.schema(row).parquet(path), str(tmp_path / "s"), str(tmp_path / "cp"), keep_hours=12)
        q.awaitTermination()
        rows_in_state.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]])
    got = {tuple(x) for x in Store(spark, str(tmp_path / "s"), {}).read("progress").collect()}
    assert got == {tuple(x) for x in R.document_progress(spark.read.schema(row).parquet(path).filter("ts is not null")).collect()}
    assert max(x for b in rows_in_state for x in b) < 3 * 2 * 20 and rows_in_state[-1][-1] <= 2 * 20 + 20, rows_in_state


def test_native_windows_run(spark, tmp_path):
    """The forms on Spark's own watermark, over rows in order."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(f"e{k}", "GENERATE" if k % 3 else "STORED", "t", f"h{k % 40}", start + dt.timedelta(minutes=17 * k)) for k in range(200)]
    row = "event_id string, stage string, tenant_id string, sha256 string, ts timestamp"
    spark.createDataFrame(rows, row).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(row).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    hours = batch.groupBy(F.date_trunc("hour", "ts")).agg(F.count(F.lit(1)))
    assert run(S.ingestion_history_stream(live()), "history", "complete") == sorted(map(tuple, hours.collect()))
    days = batch.filter("stage = 'GENERATE'").groupBy(F.window("ts", "24 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.end", "n")
    assert run(S.questions_24h_stream(live()), "questions", "complete") == sorted(map(tuple, days.collect()))
    assert len(run(S.dedupe_stream(live()), "firsts", "append")) == 40


def test_question_stream(spark, tmp_path):
    texts = spark.createDataFrame([("c1", "red moon"), ("c2", "blue moon"), ("c3", "salt")], "chunk_id string, text string")
    postings = K.build_postings(K.analyze(texts))
    spark.createDataFrame([(1, "moon"), (2, "salt")], "query_id int, q string").coalesce(1).write.parquet(str(tmp_path / "in"))
    asked = spark.readStream.schema("query_id int, q string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        S.search_stream(asked, lambda q: K.keyword_topk(q, postings, 5), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r["query_id"], r["chunk_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "c1"), (1, "c2"), (2, "c3")}


def test_ingest_leaves_nothing_staged(spark, tmp_path):
    """The store is all that stays of a batch, the first and later ones."""
    import os

    from lakedocs.sources.stage import stage_path

    folder = stage_path(spark).removeprefix("file://").rsplit("/", 1)[0]
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    store, before = S.corpus_store(spark, str(tmp_path / "s")), there()
    for text in ("river lamp\nstone", "river\nglass"):
        S.put_documents(store, spark.createDataFrame([("d", "t", "STORED", text)], "doc_id string, tenant_id string, state string, text string"))
        assert there() == before
    assert [r["text"] for r in store.read("blocks").orderBy("pos").collect()] == ["river", "glass"]
    assert {r["term"] for r in S.corpus_index(spark, store.root).terms().collect()} == {"river", "glass"}

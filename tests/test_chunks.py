"""Chunking in one pass against the operators that it is made of, and its rules on rows worked out by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lakedocs.operators import blocks as B, chunks as C
from lakedocs.sources import ingest


def parts(blocks, target, overlap, most):
    plans = C.plan_chunks(blocks)
    packed = C.pack_segments(C.narrative_segments(blocks, plans), C.chunk_targets(blocks, target), overlap)
    every = C.chunk_tiny(blocks, plans).unionByName(C.chunk_tables(blocks, plans)).unionByName(packed)
    return C.with_chunk_ids(C.cap_per_doc(every.withColumn("meta", F.col("meta").cast(C.META)), most))


def made(spark):
    """Artifacts of all kinds: tiny documents, tables, headers of odd levels, code, lists, long and blank parts."""
    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9))) for _ in range(n))
    rows = []
    for doc in range(24):
        for pos in range(r.choice([1, 3, 40])):
            kind = r.choice(["text", "text", "text", "header", "list", "code" if doc % 3 == 0 else "text", "table" if doc % 2 else "text", "image"])
            text = {"header": words(3), "list": "\n".join(f"  {words(4)} " for _ in range(4)), "table": f"{words(2)} | {words(2)}\n\n k | v"}.get(kind, words(r.choice([1, 20, 60, 400])) + r.choice(["", "  \n\n tail "]))
            rows.append((str(doc), pos, kind, text, pos // 15, r.choice([1, 2, 3, 5]) if kind == "header" else None, 2 if kind == "table" else None))
    rows += [("blank", 0, "text", " "), ("one", 0, "text", "x" * 9000), ("null", 0, "text", None)]
    rows = [(*x, *[None] * (7 - len(x))) for x in rows]
    artifacts = spark.createDataFrame(rows, "doc_id string, pos int, type string, text string, page_idx int, level int, rows int")
    return B.with_spans(B.artifacts_to_blocks(B.with_header_chain(artifacts)))


def test_one_pass_gives_what_its_parts_give(spark):
    blocks = made(spark)
    plain = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for b, args in ((blocks, (C.TARGET, C.OVERLAP, C.MOST)), (blocks, (90, 30, 6)), (blocks.withColumn("filename", F.concat("doc_id", F.lit(".txt"))), (200, 0, C.MOST))):
        got, want = plain(C.chunk_documents(b, *args)), plain(parts(b, *args))
        assert got == want and len(got) > 40
    assert C.chunk_documents(blocks.limit(0)).count() == 0
    plan = C.chunk_documents(blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2, plan  # by pages for the headers of ``made``, by documents


def test_orphans_join_the_chunk_before():
    rows = lambda *tokens: [("", n, {"type": "paragraph"}) for n in tokens]
    assert C._packed(rows(90, 49), 100, 0) == [(0, 2)]  # fewer than 50 tokens join a chunk
    assert C._packed(rows(90, 50), 100, 0) == [(0, 1), (1, 2)]
    assert C._packed(rows(119, 20), 100, 0) == [(0, 2)]  # one of less than 1.2 targets
    assert C._packed(rows(120, 20), 100, 0) == [(0, 1), (1, 2)]
    assert C._packed(rows(20), 100, 0) == [(0, 1)]


def test_chunks_overlap_by_whole_rows():
    rows = [("", 40, {"type": "paragraph"})] * 5
    assert C._packed(rows, 120, 40) == [(0, 3), (2, 5)]
    assert C._packed(rows, 120, 39) == [(0, 3), (3, 5)]
    lists = [("", 40, {"type": "list"})] * 5  # lists overlap by half
    assert C._packed(lists, 120, 79) == [(0, 3), (3, 5)] and C._packed(lists, 120, 80) == [(0, 3), (2, 5)]


def test_long_texts_are_split_at_the_first_separator_that_splits():
    assert C.split_text("aaaa\n\nbbbb\ncccc", 2, 0) == ["aaaa\n\n", "bbbb\n", "cccc"]
    assert C.split_text("aaaa bbbb cccc dddd", 3, 0) == ["aaaa ", "bbbb ", "cccc dddd"]
    assert C.split_text("x" * 10, 1, 0) == ["xxxx", "xxxx", "xx"]
    assert C.split_text("aa. bb. cc. dd. ", 2, 1) == ["aa. bb. ", "bb. cc. ", "cc. dd. "]


def test_read_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, body in (("a.txt", b"one"), ("deep/b.txt", b"\x00\xff"), ("c.pdf", b""), ("d.pdf", b"%")):
        (tmp_path / "in" / name).write_bytes(body)
    read = lambda glob: {(r["filename"], r["length"], bytes(r["content"])) for r in ingest.read_files(spark, f"{tmp_path}/in", glob).collect()}
    assert read("*.txt") == {("a.txt", 3, b"one"), ("b.txt", 2, b"\x00\xff")}
    assert read(None) == read("*.txt") | {("d.pdf", 1, b"%")}

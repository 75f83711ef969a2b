"""a search is restricted to all invoices of a time or number, not to the first ones."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from lakedocs.operators import filters, fusion
from lakedocs.operators import vectors as V
from lakedocs.plans import search as S

CHUNK = "chunk_id string, doc_id string, text string, page_start int, page_end int, span_start int, span_end int, meta struct<types:array<string>,source_block_ids:array<string>,context_headers:array<string>>"
TODAY = "2024-06-15"


def test_documents_behind_the_first_ones_are_found(spark):
    """1,100 invoices of May and 60 of one number: the documents are those of the last."""
    inv = [(f"i{k:04}", f"INV-2024-{k}", "x", datetime.date(2024, 5, 1 + k % 30)) for k in range(1100)] + [(f"n{k:02}", f"ABC-99-1{k:02}", "x", datetime.date(2020, 1, 1)) for k in range(60)]
    ids = ["i0003", "i1099", "n02", "n59", "other"]
    docs = spark.createDataFrame([(d, "t", "text/plain", f"s/{d}.txt", "STORED", datetime.datetime(2020, 1, 1)) for d in ids], "doc_id string, tenant_id string, mime string, uri string, state string, collected_at timestamp")
    chunks = spark.createDataFrame([(f"c-{d}-{n}", d, f"stone river {d}", 1, 1, n, n + 1, (["paragraph", "table"][: 1 + n], [f"b{d}{n}"], [])) for d in ids for n in range(2)], CHUNK)
    vec = chunks.select("chunk_id", F.array(F.lit(1.0), F.length("chunk_id").cast("double")).alias("embedding"))
    c = S.Corpus(chunks, docs, vec, invoices=spark.createDataFrame(inv, "invoice_id string, invoice_number string, vendor string, invoice_date date"))
    asked = [(1, "river of May 2024", None, None, None), (2, "river ABC-99-1", None, None, None), (3, "river", 50, None, None), (4, "river", None, None, None), (5, "river ABC-99-1", None, ["n59", "other"], None), (6, "river ABC-99-1", None, ["other"], None), (7, "total for May 2024", None, None, None), (8, "qqq May 2024", None, None, ["none"])]
    q = spark.createDataFrame([(i, s, [1.0, 0.5], n, d, t) for i, s, n, d, t in asked], "query_id int, q string, embedding array<double>, date_last_days int, doc_ids array<string>, types array<string>")
    for hybrid in (True, False):
        found = {}
        for r in S.search(q, c, F.lit(TODAY), F.lit(TODAY).cast("timestamp"), k=20, hybrid=hybrid).collect():
            found.setdefault(r["query_id"], set()).add(r["doc_id"])
        assert found == {1: {"i0003", "i1099"}, 2: {"n02", "n59"}, 3: {"i0003", "i1099"}, 4: set(ids), 5: {"n59"}, 6: {"other"}, 7: {"i0003", "i1099"}}, hybrid


def test_sets_are_those_of_the_filters(spark):
    """One after the other and without limits, against sets in Python; a set that would be empty is ignored."""
    r = random.Random(3)
    inv = [(f"d{r.randrange(30)}", f"XY-1{r.randrange(4)}-{r.randrange(30)}", datetime.date(2024, r.randrange(1, 7), r.randrange(1, 28))) for _ in range(60)]
    asked = []
    for k in range(80):
        q = " ".join([r.choice(["", "total", "what"]), r.choice(["", "May 2024", "march 2024", "october 2023"]), r.choice(["", f"XY-1{r.randrange(4)}-{r.randrange(3)}", "ZZ-11-1"])])
        asked.append((k, q, r.choice([None, [], sorted({f"d{r.randrange(40)}" for _ in range(6)})]), r.choice([None, 0, 3, 60]), r.choice([None, ["image"]])))
    df = spark.createDataFrame(asked, "query_id int, q string, doc_ids array<string>, date_last_days int, types array<string>")
    out, members = filters.restrict_to_invoices(df, spark.createDataFrame(inv, "invoice_id string, invoice_number string, invoice_date date"), F.lit(TODAY))
    rows = {}
    for m in members.collect():
        rows.setdefault(m["set"], []).append(m["doc_id"])
    assert all(len(v) == len(set(v)) for v in rows.values())
    months = {"May 2024": (5, 2024), "march 2024": (3, 2024), "october 2023": (10, 2023)}
    today = datetime.date.fromisoformat(TODAY)
    for x in out.collect():
        _, q, ids, days, types = asked[x["query_id"]]
        now = set(ids or [])
        named = [m for w, m in months.items() if w in q]
        met = [{i for i, _, d in inv if (d.month, d.year) == m} for m in named]
        number = [w for w in q.split() if w[:2] in ("XY", "ZZ")]
        met += [{i for i, n, _ in inv if w in n} for w in number]
        met += [{i for i, _, d in inv if 0 <= (today - d).days <= days}] if days else []
        used = False
        for m in met:
            both = m & now if now else m
            now, used = (both, True) if both else (now, used)
        assert (set(rows[x["sets"][0]]) if x["sets"] else set(x["doc_ids"])) == now and bool(x["sets"]) == used and not (x["sets"] and x["doc_ids"]), q
        assert (x["types"] or []) == (types or []) + (["table"] if named and "total" in q else [])


def test_net_within_sets(spark):
    rows = [(f"c{k}", f"d{k % 5}", 100 - k, ["table"] if k % 3 == 0 else ["paragraph"] if k % 3 == 1 else None, [["a"], ["a", "b"], None, ["b"], []][k % 5]) for k in range(40)]
    corpus = spark.createDataFrame(rows, "chunk_id string, doc_id string, n_text int, types array<string>, sets array<string>")
    asked = [(1, "what", None, ["a"]), (2, "total", None, ["b"]), (3, "what", ["paragraph", "table"], ["b"]), (4, "total", ["paragraph"], ["b"]), (5, "what", None, ["none"]), (6, "what", None, None)]
    q = spark.createDataFrame([(i, s, t, None, x) for i, s, t, x in asked], "query_id int, q string, types array<string>, doc_ids array<string>, sets array<string>")
    got = {}
    for r in fusion.safety_net(q, q.limit(0).select("query_id"), corpus, 3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for i, s, want, sets in asked:
        see = [c for c, _, n, types, own in rows if (not sets or set(own or []) & set(sets)) and (not want or set(types or []) & set(want)) and (s != "total" or "table" in (types or []))]
        assert got.get(i, []) == see[:3], i


def test_rows_seen_by_several_tags(spark):
    r = random.Random(8)
    index = [(f"c{k}", [r.uniform(-1, 1) for _ in range(3)], r.choice(["x", "y", None]), r.choice([None, [], ["a"], ["a", "b"], ["c"]])) for k in range(80)]
    asked = [(k, [r.uniform(-1, 1) for _ in range(3)], r.choice([None, [], ["x"], ["x", "y"]]), r.choice([None, ["a"], ["b", "c"], ["q"]])) for k in range(30)]
    out = V.vector_topk(spark.createDataFrame(asked, "query_id int, embedding array<double>, m array<string>, s array<string>"), spark.createDataFrame(index, "chunk_id string, embedding array<double>, mime string, sets array<string>"), 100, only=[("m", "mime"), ("s", "sets")])
    got = {}
    for x in out.collect():
        got.setdefault(x["query_id"], set()).add(x["chunk_id"])
    for i, _, m, s in asked:
        assert got.get(i, set()) == {c for c, _, t, own in index if (not m or t in m) and (not s or set(own or []) & set(s))}

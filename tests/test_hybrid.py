"""Search end to end against a plain version in Python: restrictions in both legs, ranks, boosts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lakedocs.functions import text as T
from lakedocs.operators import filters, graph as G, inverted_index as I, keyword as K, vectors as V
from lakedocs.plans import search as S

WORDS = "red green blue stone river lamp paper glass moon garden iron salt total amount invoice".split()
NOW = "2024-06-01 00:00:00"


def made(seed=5):
    """Chunks of documents of two mimes, some tables, some invoices."""
    r = random.Random(seed)
    docs = [(f"d{k}", "t" if k % 5 else "other", ["text/plain", "application/pdf"][k % 2], f"store/{['a', 'B'][k // 2 % 2]}/{['Bill', 'note'][k % 3 % 2]}{k}.txt", "DELETED" if k == 7 else "STORED", "2024-05-31 12:00:00" if k % 4 == 0 else "2020-01-01 00:00:00") for k in range(14)]
    chunks = [(f"c{k}-{n}", f"d{k}", " ".join(r.choices(WORDS, k=r.randrange(3, 14))), 1, 1, n * 100, n * 100 + 50, (["table"] if (k + n) % 3 == 0 else ["paragraph"], [f"b{k}-{n}"], r.choice([["Grand total"], ["Stone river"], [], None]))) for k in range(14) for n in range(5)]
    return docs, chunks, [(f"d{k}", f"INV-2024-{k}", ["Acme Ltd", "Zeta"][k % 2], "2024-05-20") for k in range(0, 14, 3)]


def corpus(spark, root, vec, docs, chunks, invoices):
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id string, text string, page_start int, page_end int, span_start int, span_end int, meta struct<types:array<string>,source_block_ids:array<string>,context_headers:array<string>>")
    d = spark.createDataFrame(docs, "doc_id string, tenant_id string, mime string, uri string, state string, collected_at string").withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    v = spark.createDataFrame(sorted(vec.items()), "chunk_id string, embedding array<double>")
    i = spark.createDataFrame(invoices, "invoice_id string, invoice_number string, vendor string, invoice_date string").withColumn("invoice_date", F.col("invoice_date").cast("date"))
    return S.Corpus(c, d, v, I.build_index(c.select("chunk_id", "text"), root), invoices=i)


ASKED = [
    (1, "red moon stone", {}), (2, "red moon stone", {"types": ["table"]}), (3, "total amount of glass", {"mime_any": ["application/pdf"]}), (4, "river garden", {"uri_like": "STORE/b"}),
    (5, "lamp paper salt", {"filename_like": "bill"}), (6, "iron salt", {"vendor_like": "acme"}), (7, "garden stone", {"doc_ids": ["d1", "d2", "d3", "d7"], "mime_any": ["text/plain"]}), (8, "blue lamp", {"boost_types": ["table"], "uri_like": "note"}),
    (9, "invoice total for INV-2024-3", {}), (10, "nothing at all here", {"types": ["none"]}),
]
FIELDS = "query_id int, q string, embedding array<double>, doc_ids array<string>, types array<string>, mime_any array<string>, uri_like string, filename_like string, vendor_like string, boost_types array<string>, date_last_days int"


def plain(docs, chunks, invoices, vec, asked, tokens, enriched, k, tenant, mode):
    """query -> ranked chunk ids."""
    doc = {x[0]: x for x in docs if x[4] != "DELETED" and (tenant is None or x[1] == tenant)}
    vendor = {x[0]: x[2] for x in invoices}
    live = {c[0]: c for c in chunks if c[1] in doc}
    words = {c[0]: [w for w in c[2].split() if w not in K.STOP] for c in chunks}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = {w: sum(w in ws for ws in words.values()) for w in WORDS}
    out = {}
    for (qid, q, want), e in asked:
        numbers = [x[0] for x in invoices if "INV-2024-3" in q and "INV-2024-3" in x[1]]
        ids = sorted(set(want.get("doc_ids", numbers)) & set(numbers)) if numbers and want.get("doc_ids") else want.get("doc_ids") or numbers
        types, numeric = want.get("types", []), any(w in q.split() for w in ("total", "amount"))

        def sees(c, hard):
            d = doc[c[1]]
            okay = (not ids or c[1] in ids) and (not want.get("mime_any") or d[2] in want["mime_any"])
            if hard:
                okay = okay and (not types or set(types) & set(c[7][0])) and want.get("uri_like", "").lower() in d[3].lower() and want.get("filename_like", "").lower() in d[3].split("/")[-1].lower()
                okay = okay and ("vendor_like" not in want or want["vendor_like"].lower() in vendor.get(c[1], "").lower())
            return okay

        cos = {x: sum(a * b for a, b in zip(e, vec[x])) / (math.hypot(*e) * math.hypot(*vec[x])) for x, c in live.items() if sees(c, False)}
        near = sorted(cos, key=lambda x: (-cos[x], x))[:60]

        def boost(c):
            heads = set().union(*[tokens[h] for h in c[7][2] or []], set())
            return 0.05 * len(heads & tokens[q]) + (0.03 if numeric and "table" in c[7][0] else 0) + (0.05 if doc[c[1]][5] > "2024-05-31" else 0)

        v = {x: cos[x] + boost(live[x]) for x in near if not types or set(types) & set(live[x][7][0])}
        score = {}
        for x, c in live.items():
            # A number with dashes is a phrase, which none of these chunks holds.
            if sees(c, True) and "-" not in enriched[q]:
                ws = words[x]
                s = sum(math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in {t for t in enriched[q].lower().split() if t not in K.STOP})
                if s:
                    score[x] = round(s, 9)
        kw = {x: score[x] for x in sorted(score, key=lambda x: (-score[x], x))[:100]}
        rv, rk = ({x: i + 1 for i, x in enumerate(sorted(leg, key=lambda x: (-leg[x], x)))} for leg in (v, kw))

        def scaled(leg, x):
            low, high = min(leg.values(), default=0), max(leg.values(), default=0)
            return (leg[x] - low) / (high - low) if x in leg and high > low else 0.0

        fused = {x: 0.7 * scaled(v, x) + 0.3 * scaled(kw, x) if mode == "norm" else 0.7 / (60 + rv.get(x, 10**9)) + 0.3 / (60 + rk.get(x, 10**9)) for x in {*v, *kw}}
        top = sorted(fused, key=lambda x: (-fused[x], x))[: max(50, 4 * k)]
        full = {x: fused[x] + (0.05 if set(want.get("boost_types", [])) & set(live[x][7][0]) else 0) for x in top}
        left, picked = sorted(full, key=lambda x: (-full[x], x)), []
        like = lambda a, b: len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b]) if tokens[a] and tokens[b] else 0.0
        while left and len(picked) < 2 * k:
            best = max(left, key=lambda x: 0.65 * full[x] - 0.35 * max((like(live[x][2], live[y][2]) for y in picked), default=0)) if picked else left[0]
            picked.append(best)
            left.remove(best)
        kept = []
        for x in picked:
            if sum(live[y][1] == live[x][1] for y in kept) < 3 and len(kept) < k:
                kept.append(x)
        out[qid] = (kept, kw)
    return out


@pytest.mark.parametrize(("mode", "tenant"), [("rrf", None), ("norm", "t")])
def test_ranks(spark, tmp_path, mode, tenant):
    docs, chunks, invoices = made()
    r = random.Random(9)
    vec = {c[0]: [r.uniform(-1, 1) for _ in range(6)] for c in chunks}
    asked = [(a, [r.uniform(-1, 1) for _ in range(6)]) for a in ASKED]
    c = corpus(spark, str(tmp_path / "i"), vec, docs, chunks, invoices)
    get = lambda w, f: w.get(f)
    q = spark.createDataFrame([(i, s, e, get(w, "doc_ids"), get(w, "types"), get(w, "mime_any"), get(w, "uri_like"), get(w, "filename_like"), get(w, "vendor_like"), get(w, "boost_types"), None) for (i, s, w), e in asked], FIELDS)
    said = {x for c_ in chunks for x in (c_[2], *(c_[7][2] or []))} | {a[1] for a in ASKED}
    tokens = {x["s"]: set(x["t"] or []) for x in spark.createDataFrame([(s,) for s in said], "s string").select("s", T.token_set(F.col("s")).alias("t")).collect()}
    enriched = {x["q"]: x["e"] for x in q.select("q", T.enrich_query(F.col("q")).alias("e")).collect()}
    want = plain(docs, chunks, invoices, vec, asked, tokens, enriched, 6, tenant, mode)
    out = S.search(q, c, F.lit("2024-06-01"), F.lit(NOW).cast("timestamp"), k=6, tenant_id=tenant, mode=mode).collect()
    got = {}
    for x in sorted(out, key=lambda x: x["rank"]):
        got.setdefault(x["query_id"], []).append(x["chunk_id"])
    for qid, (ranks, _) in want.items():
        if ranks:
            assert got[qid] == ranks, qid
    leg = S.keyword_leg(filters.restrict_by_number(filters.with_restrictions(q), c.invoices), c, 100, tenant)
    legs = {}
    for x in leg.collect():
        legs.setdefault(x["query_id"], {})[x["chunk_id"]] = x["score"]
    for qid, (_, kw) in want.items():
        assert set(legs.get(qid, {})) == set(kw) and all(math.isclose(legs[qid][x], s, abs_tol=1e-6) for x, s in kw.items()), qid
    # Without its restriction the keyword leg would return other types.
    types = {c_[0]: c_[7][0] for c_ in chunks}
    assert {t for x in legs[2] for t in types[x]} == {"table"} < {t for x in legs[1] for t in types[x]}


def test_a_second_score(spark, tmp_path):
    docs, chunks, invoices = made()
    vec = {c[0]: [1.0, float(k % 7)] for k, c in enumerate(chunks)}
    c = corpus(spark, str(tmp_path / "i"), vec, docs, chunks, invoices)
    q = spark.createDataFrame([(1, "red moon", [1.0, 0.0], None, None, None)], "query_id int, q string, embedding array<double>, doc_ids array<string>, types array<string>, date_last_days int")
    out = S.search(q, c, F.lit("2024-06-01"), F.lit(NOW).cast("timestamp"), k=3, scorer=F.length("text") + F.length("q")).orderBy("rank").collect()
    longest = max(len(x[2]) for x in chunks if x[1] != "d7")
    assert out[0]["score"] <= longest + 8 and out[0]["score"] > 20


def test_graph_hits_are_boosted(spark):
    """A found chunk's own headers and types count."""
    block = "block_id string, doc_id string, pos int, page int, type string, text string, meta struct<level:int>"
    b = spark.createDataFrame([(f"b{k}", "d", k, 1, "paragraph", "x", (None,)) for k in range(4)], block)
    meta = "struct<source_block_ids:array<string>,context_headers:array<string>,types:array<string>>"
    rows = [("c0", "d", (["b0"], [], ["paragraph"])), ("c1", "d", (["b1"], ["Grand total"], ["paragraph"])), ("c2", "d", (["b2"], ["Total"], ["table"])), ("c3", "d", (["b3"], None, ["table"]))]
    chunks = spark.createDataFrame(rows, f"chunk_id string, doc_id string, meta {meta}")
    hits = spark.createDataFrame([(1, 1, "c0", 0.5), (2, 1, "c0", 0.5)], "query_id int, rank int, chunk_id string, score_vec double")
    asked = spark.createDataFrame([(1, "the grand total"), (2, "who")], "query_id int, q string")
    out = G.expand_hits(hits, G.graph_nodes(b), G.contains_edges(b).unionByName(G.follows_edges(b)), chunks, questions=asked)
    got = {(r["query_id"], r["chunk_id"]): r["score_graph"] for r in out.collect()}
    assert got == {(1, "c1"): 0.4, (1, "c2"): 0.38, (1, "c3"): 0.33, (2, "c1"): 0.3, (2, "c2"): 0.3, (2, "c3"): 0.3}


def test_number_and_days_stop_where_they_should(spark):
    inv = spark.range(3000).select(F.col("id").cast("string").alias("invoice_id"), F.concat(F.lit("INV-1999-"), "id").alias("invoice_number"), F.lit("2024-01-10").cast("date").alias("invoice_date"))
    q = spark.createDataFrame([(1, "what of INV-1999-1", None, 30), (2, "INV-1999-2999", None, None)], "query_id int, q string, doc_ids array<string>, date_last_days int")
    by = {r["query_id"]: r["doc_ids"] for r in filters.restrict_by_number(q, inv).collect()}
    assert by[1] == sorted(str(k) for k in range(3000) if str(k).startswith("1"))[:50] and by[2] == ["2999"]
    days = {r["query_id"]: r["doc_ids"] for r in filters.restrict_last_days(q, inv, F.lit("2024-01-15")).collect()}
    assert days[1] == sorted(map(str, range(3000)))[:1000] and days[2] == []


def test_vector_topk_by_tag(spark):
    r = random.Random(4)
    index = [(f"c{k}", [r.uniform(-1, 1) for _ in range(3)], ["x", "y", None][k % 3]) for k in range(60)]
    asked = [(1, [1.0, 0.0, 0.0], ["x"]), (2, [0.0, 1.0, 0.0], []), (3, [0.0, 0.0, 1.0], None), (4, [1.0, 1.0, 0.0], ["x", "y"]), (5, [1.0, 0.0, 0.0], ["z"])]
    out = V.vector_topk(spark.createDataFrame(asked, "query_id int, embedding array<double>, want array<string>"), spark.createDataFrame(index, "chunk_id string, embedding array<double>, tag string"), 25, only=("want", "tag")).collect()
    for q, e, want in asked:
        cos = {c: sum(a * b for a, b in zip(e, v)) / math.hypot(*e) / math.hypot(*v) for c, v, t in index if not want or t in want}
        assert [x["chunk_id"] for x in sorted(out, key=lambda x: x["rank"]) if x["query_id"] == q] == sorted(cos, key=lambda c: (-cos[c], c))[:25]

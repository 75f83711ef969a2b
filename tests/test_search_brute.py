"""Operators that SQL doesn't express, against brute force on random rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakedocs.functions import text as T
from lakedocs.operators import context as A, fusion as H, keyword as K, vectors as V


def windows(places: dict[str, list[int]]) -> float:
    """Every window that holds all terms and no smaller such window, one over its length."""
    at = sorted(p for ps in places.values() for p in ps)
    full = [(i, j) for i in at for j in at if i <= j and all(any(i <= p <= j for p in ps) for ps in places.values())]
    return sum(1 / (j - i + 1) for i, j in full if not any((a, b) != (i, j) and a >= i and b <= j for a, b in full))


def test_cover_density(spark):
    r = random.Random(1)
    asked = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c", "d"], 4: ["c", "none"]}
    texts = {f"k{n}": [r.choice("abcdx") for _ in range(r.randrange(1, 40))] for n in range(40)}
    places = {k: {t: [p for p, w in enumerate(ws) if w == t] for t in set(ws)} for k, ws in texts.items()}
    postings = spark.createDataFrame([(t, k, ps) for k, by in places.items() for t, ps in by.items()], "term string, chunk_id string, positions array<int>")
    need = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts for _ in range(2)], "query_id int, term string")  # repeated rows do no harm
    found = spark.createDataFrame([(q, k) for q in asked for k in texts], "query_id int, chunk_id string")
    got = {(x["query_id"], x["chunk_id"]): x["score"] for x in K.cover_density(found, need, postings).collect()}
    want = {(q, k): windows({t: by[t] for t in ts}) for q, ts in asked.items() for k, by in places.items() if all(t in by for t in ts)}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(math.isclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("lam, k", [(0.65, 3), (0.2, 8), (1.0, 30)])
def test_mmr(spark, lam, k):
    r = random.Random(2)
    words = "red green blue stone river lamp paper glass moon garden".split()
    rows = []
    for q in range(4):
        scores = sorted((r.randrange(8) / 8 for _ in range(70)), reverse=True)  # with ties
        rows += [(q, f"c{n}", s, n + 1, " ".join(r.choices(words, k=r.randrange(6))) if n % 9 else None) for n, s in enumerate(scores)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int, text string")
    sets = {(x["query_id"], x["chunk_id"]): set(x["t"] or []) for x in hits.select("query_id", "chunk_id", T.token_set(F.col("text")).alias("t")).collect()}

    def like(q, a, b):
        x, y = sets[q, a], sets[q, b]
        return len(x & y) / len(x | y) if x and y else 0.0

    got = H.mmr(hits, k, lam).orderBy("query_id", "rank").collect()
    for q in range(4):
        left = sorted(((c, s) for qq, c, s, _, _ in rows if qq == q), key=lambda x: (-x[1], x[0]))[: max(50, 4 * k)]
        chosen = [left.pop(0)]
        while left and len(chosen) < 2 * k:
            worth = [lam * s - (1 - lam) * max(like(q, c, x) for x, _ in chosen) for c, s in left]
            chosen.append(left.pop(worth.index(max(worth))))
        assert [(x["chunk_id"], x["score"]) for x in got if x["query_id"] == q] == chosen


def test_hash_embed(spark):
    texts = {1: "One two, two THREE", 2: "", 3: None, 4: "é漢字 é x1 x1 x1", 5: "word " * 5000}
    rows = spark.createDataFrame(list(texts.items()), "k int, text string")
    got = {x["k"]: x["embedding"] for x in V.hash_embed(rows, "k", "text", 16).collect()}
    words = {1: ["one", "two", "two", "three"], 2: [], 3: [], 4: ["é漢字", "é", "x1", "x1", "x1"], 5: ["word"] * 5000}
    distinct = spark.createDataFrame([(w,) for w in {w for ws in words.values() for w in ws}], "w string")
    place = {x["w"]: x["b"] for x in distinct.select("w", F.pmod(F.xxhash64("w"), F.lit(16)).alias("b")).collect()}
    assert got.keys() == texts.keys()
    for k, ws in words.items():
        n = Counter(place[w] for w in ws)
        norm = math.sqrt(sum(c * c for c in n.values()))
        assert got[k] == pytest.approx([n[b] / norm if norm else 0.0 for b in range(16)], abs=1e-6)


def test_stitch():
    r = random.Random(3)
    rows = [{"doc_id": r.choice("ab"), "chunk_id": str(n), "text": r.choice(["", " ", "x" * r.randrange(1, 60)]), "page_start": r.choice([None, 1, 2, 3]), "page_end": None} for n in range(300)]
    for x in rows:
        x["page_end"] = None if x["page_start"] is None else x["page_start"] + r.randrange(2)
    kept = [x for x in rows if x["text"].strip()]
    out = A.stitch([dict(x) for x in rows], 100)
    assert [i for x in out for i in x["chunk_ids"]] == [x["chunk_id"] for x in kept]
    assert "\n".join(x["text"] for x in out) == "\n".join(x["text"] for x in kept)
    assert all(len(x["text"]) <= 100 for x in out) and any(len(x["chunk_ids"]) > 1 for x in out)
    for last, x in zip(out, out[1:]):  # what could have been joined has been
        first = next(y for y in kept if y["chunk_id"] == x["chunk_ids"][0])
        near = (first["page_start"] or 1) - last["page_end"] in (0, 1)
        assert last["doc_id"] != first["doc_id"] or not near or len(last["text"]) + 1 + len(first["text"]) > 100

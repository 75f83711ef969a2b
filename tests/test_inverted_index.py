"""The index on disk: what it finds, what changes do to it, how it is read."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakedocs.operators import inverted_index as I, keyword as K
from lakedocs.sources.store import Store

WORDS = "red green blue stone river lamp paper glass moon garden iron salt the and".split()


def some(n, seed):
    r = random.Random(seed)
    return {f"c{k}": " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 40))) for k in range(n)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id string, text string")


def want_terms(texts):
    df, cf = Counter(), Counter()
    for t in texts.values():
        words = [w for w in t.split() if w not in K.STOP]
        df.update(set(words))
        cf.update(words)
    return {t: (df[t], cf[t]) for t in df}


def want_postings(texts):
    out = {}
    for c, t in texts.items():
        at = defaultdict(list)
        for p, w in enumerate(t.split()):
            if w not in K.STOP:
                at[w].append(p)
        out |= {(w, c): (ps, sum(map(len, at.values()))) for w, ps in at.items()}
    return out


def bm25(texts, terms):
    kept = {c: [w for w in t.split() if w not in K.STOP] for c, t in texts.items()}
    kept = {c: w for c, w in kept.items() if w}
    n, mean = len(kept), sum(map(len, kept.values())) / len(kept)
    out = {}
    for c, words in kept.items():
        score = 0.0
        for t in terms:
            tf, df = words.count(t), sum(t in w for w in kept.values())
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * len(words) / mean)) if tf else 0
        if score:
            out[c] = round(score, 9)
    return out


def check(spark, index, texts):
    assert {r["term"]: (r["df"], r["cf"]) for r in index.terms().collect()} == want_terms(texts)
    rows = index.postings().collect()
    assert {(r["term"], r["chunk_id"]): (r["positions"], r["length"]) for r in rows} == want_postings(texts) and len(rows) == len(want_postings(texts))
    asked = spark.createDataFrame([(1, "red moon"), (2, "salt"), (3, '"river lamp" -iron'), (4, "none of it")], "query_id int, q string")
    found = {(r["query_id"], r["chunk_id"]): r["score"] for r in K.keyword_topk(asked, index, 10**6, mode="any").collect()}
    for q, terms in ((1, ["red", "moon"]), (2, ["salt"])):
        want = bm25(texts, terms)
        assert {c for k, c in found if k == q} == set(want) and all(math.isclose(found[q, c], s, abs_tol=1e-8) for c, s in want.items())
    assert {c for k, c in found if k == 3} == {c for c, t in texts.items() if "river lamp" in t and "iron" not in t.split()}
    assert not [c for k, c in found if k == 4]


def test_changes(spark, tmp_path, monkeypatch):
    """Chunks come, change and go; segments are merged on the way; the statistics are those of a new index."""
    monkeypatch.setattr(I, "SEGMENTS", 3)
    monkeypatch.setattr(I, "BUCKETS", 3)
    writer = I.IndexWriter(Store(spark, str(tmp_path / "i"), {}, keep=1))
    texts = some(60, 1)
    check(spark, writer.change(frame(spark, texts)), texts)
    for step in range(4):
        new = {c: t for c, t in some(70, 10 + step).items() if int(c[1:]) % 5 == step or int(c[1:]) >= 60}
        gone = [f"c{k}" for k in range(step, 70, 11) if f"c{k}" not in new] + ["never there"]
        index = writer.change(frame(spark, new), spark.createDataFrame([(c,) for c in gone], "chunk_id string"))
        texts = {c: t for c, t in (texts | new).items() if c not in gone}
        assert len(index.segments) <= 4
    check(spark, index, texts)
    check(spark, writer.change(None, spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")), {c: t for c, t in texts.items() if c not in ("c1", "c2")})
    left = {x for x in writer.store.files.names(f"{writer.root}/_index") if x.startswith("seg=")}
    assert left == {f"seg={s['number']}" for s in writer.index().segments}


def test_batch_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"), {})
    writer, texts = I.IndexWriter(store), some(20, 3)
    for _ in range(2):
        index = writer.change(frame(spark, texts), stream="s", batch=0)
    assert store.commit().number == 0
    check(spark, index, texts)
    # Taken again under another name, the same chunks replace themselves.
    check(spark, writer.change(frame(spark, texts), stream="t", batch=0), texts)


def test_postings_are_not_shuffled(spark, tmp_path):
    index = I.build_index(frame(spark, some(200, 4)), str(tmp_path / "i"))
    asked = spark.createDataFrame([(k, " ".join(random.Random(k).choices(WORDS, k=3))) for k in range(50)], "query_id int, q string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        need = K.websearch_terms(asked).select("query_id", F.explode("terms").alias("term"))
        plan = index.find(need)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = plan.index("FileScan parquet")
    above = plan[:scan].splitlines()
    depth = len(above[-1])
    # From the scan of the postings up to the join there is no exchange.
    way = [line for line in above if "Exchange" in line and plan.index(line) > plan.index("SortMergeJoin")]
    assert plan.count("FileScan parquet") == 1 and "Bucketed: true" in plan and len(way) == 1 and depth > 0 and f"{I.BUCKETS})" in way[0]


@pytest.mark.parametrize("texts", [{}, {"a": None, "b": ""}, {"a": "the and of"}])
def test_without_terms(spark, tmp_path, texts):
    index = I.build_index(frame(spark, texts), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "red moon")], "query_id int, q string")
    assert index.chunks == 0 and index.terms().count() == 0 and K.keyword_topk(asked, index, 5).count() == 0


def test_reopened(spark, tmp_path):
    """Another session knows the tables by the commit alone."""
    texts = some(30, 5)
    I.build_index(frame(spark, texts), str(tmp_path / "i"))
    for t in spark.catalog.listTables():
        if t.name.startswith("lakedocs_"):
            spark.sql(f"drop table {t.name}")
    check(spark, I.IndexWriter(Store(spark, str(tmp_path / "i"), {})).index(), texts)


def test_postings_name_chunks_by_numbers(spark, tmp_path, monkeypatch):
    """an id of 64 characters in each posting was five sixths of an index. Numbers that two chunks would share are made anew."""
    texts = {hashlib.sha256(c.encode()).hexdigest(): t for c, t in some(400, 6).items()}
    index = I.build_index(frame(spark, texts), str(tmp_path / "i"))
    size = sum(f.stat().st_size for f in (tmp_path / "i").rglob("postings/*.parquet"))
    assert size < 10 * len(want_postings(texts)) + I.BUCKETS * I.SPLIT * 3000  # heads of files
    assert {r["chunk_id"] for r in index.ids().collect()} == set(texts)
    good = I._chunk_number
    monkeypatch.setattr(I, "_chunk_number", lambda c, salt: F.length(c).cast("long") if salt == 0 else good(c, salt))
    check(spark, I.build_index(frame(spark, texts), str(tmp_path / "j")), texts)


def test_first_of_equals(spark, tmp_path):
    """Ids are looked up for the first ones alone; of chunks with one score the least ids stay. Allowed chunks are given by their ids."""
    texts = {f"c{k:02}": "red moon" if k % 2 else "red" for k in range(40)}
    index = I.build_index(frame(spark, texts), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "red"), (2, "moon"), (3, '"red moon" -iron')], "query_id int, q string")
    allowed = spark.createDataFrame([(c,) for c in texts if c > "c10"], "chunk_id string")
    for only, low in ((None, "c"), (allowed, "c11")):
        for scorer in ("bm25", "cover"):
            got = {}
            for r in K.keyword_topk(asked, index, 5, allowed=only, scorer=scorer).orderBy("rank").collect():
                got.setdefault(r["query_id"], []).append(r["chunk_id"])
            both, every = [c for c in sorted(texts) if texts[c] == "red moon" and c >= low][:5], [c for c in sorted(texts) if c >= low]
            assert got[2] == got[3] == both and got[1] == ([c for c in every if texts[c] == "red"] if scorer == "bm25" else every)[:5]

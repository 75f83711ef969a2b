"""Operators against plain Python on small rows: ring, classifier, fingerprints, chunks."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lakedocs.llm import quality, sharding, simhash, substrings, wordhash

WORDS = "of the and river stone blue lamp quiet seven garden under moon paper glass".split()


def some(n, seed=0, words=60):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(1, words)))) for i in range(n)]


def test_ring_walk(spark):
    """Every row's shard and slot by a walk of single rows, and no dependence on partitions."""
    rows = spark.createDataFrame([*some(400), (5, "x"), (5, "x"), (None, "y"), (7, None)], "doc_id long, text string")
    got = sharding.shard(rows, ["doc_id"], 5, 8)
    again = sharding.shard(rows.repartition(7), ["doc_id"], 5, 8)
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert plain(got) == plain(again)

    nodes = sharding.ring(spark, 5, 8)
    placed = rows.select("doc_id", "text", sharding._hash(F.col("doc_id")).alias("p"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(64)).alias("part"), F.xxhash64("doc_id", "text").alias("h")).collect()
    arc = lambda p: next((k for k, (at, _) in enumerate(nodes) if at >= p), 0)
    room = sharding.capacities(len(placed), 5, 0)
    held, waiting = [0] * 5, {k: [] for k in range(len(nodes))}
    for r in sorted(placed, key=lambda r: (r["part"], r["h"], r["text"] or "")):
        waiting[arc(r["p"])].append((r["doc_id"], r["text"]))
    want = []
    for turn in range(5):  # in each round a row that found no room goes on to the next new shard
        for k in range(len(nodes)):
            way = list(dict.fromkeys(nodes[(k + j) % len(nodes)][1] for j in range(len(nodes))))
            s, left = way[turn], []
            for row in waiting[k]:
                if held[s] < room[s]:
                    want.append((*row, s, held[s]))
                    held[s] += 1
                else:
                    left.append(row)
            waiting[k] = left
    assert plain(got.select("doc_id", "text", "shard", "slot")) == sorted(want, key=repr)


def test_ring_movement(spark):
    """One more shard: about its share of the rows moves, and few others."""
    rows = spark.createDataFrame(some(2000), "doc_id long, text string")
    a = {r["doc_id"]: r["shard"] for r in sharding.shard(rows, ["doc_id"], 16).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(rows, ["doc_id"], 17).collect()}
    new, old = sum(b[i] == 16 for i in a), sum(a[i] != b[i] != 16 for i in a)
    assert 2000 // 17 <= new <= 2000 // 17 + 1 and old < 2 * new


def test_ordinal_gradient():
    """The fit's loss is at a minimum: no small change of a weight or threshold lowers it."""
    r = random.Random(1)
    grades = np.array([i % 3 for i in range(120)])
    texts = pa.array([" ".join(r.choice(WORDS[4 * g : 4 * g + 6]) for _ in range(8)) for g in grades])
    share = np.ones(120)
    model = quality.train(texts, grades, share, rounds=3000, penalty=0.01)

    t, f = quality.features(texts)

    def loss(w, cuts):
        score = np.bincount(t, w[f], 120)
        p = np.concatenate([np.zeros((120, 1)), quality.Model(w, cuts).below(score), np.ones((120, 1))], 1)
        prob = p[np.arange(120), grades + 1] - p[np.arange(120), grades]
        return -np.log(prob).mean() + 0.01 * np.abs(w).sum()

    w, cuts = model.weights.astype(float), model.thresholds
    base = loss(w, cuts)
    assert base < loss(np.zeros_like(w), cuts) and (np.diff(cuts) > 0).all()
    used = np.flatnonzero(w)
    for k in [*used[:10]]:
        for d in (-0.05, 0.05):
            x = w.copy()
            x[k] += d
            assert loss(x, cuts) > base - 1e-3
    for k in range(2):
        for d in (-0.05, 0.05):
            x = cuts.copy()
            x[k] += d
            assert loss(w, x) > base - 1e-3


def test_sample_of_labels(spark):
    """Of each grade the rows of the least hashes are taken: the others' texts don't matter."""
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, 0).otherwise(1).alias("g"))
    order = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")).collect()}
    want = set(i for i in order if i % 50 == 0) | set(sorted((i for i in order if i % 50), key=lambda i: (order[i], i))[:300])
    text = lambda i, other: f"{'bad' if i % 50 == 0 else 'fine'} word{i % 7} common" if i in want else other
    models = [quality.fit(spark.createDataFrame([(i, text(i, other)) for i in order], "doc_id long, text string"), labels, F.col("g"), 300) for other in ("x y z", "bad bad words")]
    assert (models[0].weights == models[1].weights).all() and (models[0].thresholds == models[1].thresholds).all() and models[0].weights.any()


def test_simhash_votes(spark, tmp_path):
    """Fingerprints, edited texts and likenesses, bit by bit."""
    rows = [*some(12, 2), (20, None), (21, ""), (22, "a  b"), (23, "é漢🙂 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in simhash.op9_simhash(spark, str(tmp_path)).collect()}
    terms = {w for _, t in rows for w in (t or "").lower().split()}
    text = {i: t or "" for i, t in rows}
    ids = sorted(text)
    edited = {}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(text[i]) // 2
        edited[i] = text[i][: len(text[i]) - half] + text[j][:half]
    terms |= {w for t in edited.values() for w in t.lower().split()}
    hashes = {r["w"]: r["h"] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in terms], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def print_of(t):
        votes = [0] * 64
        for w in t.lower().split():
            weight = min(simhash.HEAVIEST, max(1, len(w) - 2))
            for b in range(64):
                votes[b] += weight if hashes[w] >> b & 1 else -weight
        return sum(1 << b for b in range(64) if votes[b] > 0)

    like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, e, b = print_of(text[i]), print_of(edited[i]), print_of(text[j])
        r = out[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{a:016x}", f"{e:016x}") and r["n_chars"] == len(text[i])
        assert r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r["near_edited"] == like(a, e) and r["near_next"] == like(a, b)
    first = [i for i in range(12) if len(text[i]) > 150]
    assert np.mean([out[i]["near_edited"] for i in first]) > np.mean([out[i]["near_next"] for i in first])


def test_followed_by_equal_ids(spark):
    """Null ids and one id of many rows are put in order over several ranges."""
    rows = [(None, f"none {i}") for i in range(300)] + [(5, f"five {i % 250}") for i in range(300)] + [(i, f"t {i}") for i in range(100, 160)] + [(-3, "minus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    got = sorted(simhash.followed(docs).collect(), key=lambda r: r["row_key"])
    assert [(r["doc_id"], r["text"]) for r in got] == order
    assert [r["next_text"] for r in got] == [t for _, t in order[1:] + order[:1]]
    assert [r["next_key"] for r in got] == [r["row_key"] for r in got[1:] + got[:1]]
    for i in (None, 5):
        assert len({r["row_key"] >> 40 for r in got if r["doc_id"] == i}) > 3


def test_substrings_by_plain_search(spark):
    """Removed spans and texts, chunk by chunk and byte by byte."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmé漢") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    parts = [text(r.randrange(8, 60)) for _ in range(12)]
    common = text(60)
    rows = [(i, " ".join(r.choice([r.choice(parts), text(r.randrange(1, 40)), common]) for _ in range(r.randrange(1, 7)))) for i in range(60)]
    rows += [(100 + i, f"{text(r.randrange(9))} {common} {text(r.randrange(9))}") for i in range(600)] + [(900, None), (901, ""), (902, f"{common} {common} {common}")]
    raws = {i: (t or "").encode() for i, t in rows}
    cut, first = {}, {}
    for i, t in rows:
        ends = substrings.cut_points(*wordhash.text_bytes(pa.array([t or ""]))).tolist()
        cut[i] = list(zip([0, *ends], ends))
        for a, b in cut[i]:
            first.setdefault(raws[i][a:b], (i, a))
    want = {}
    for i, raw in raws.items():
        own, copies = {}, []  # (nth, start, end, source, its start)
        for nth, (a, b) in enumerate(cut[i]):
            src = (i, own[raw[a:b]]) if raw[a:b] in own else first[raw[a:b]]
            own.setdefault(raw[a:b], a)
            if src != (i, a):
                copies.append((nth, a, b, *src))
        gone = set()
        for k, (nth, a, _, src, at) in enumerate(copies):
            if k and copies[k - 1][0] == nth - 1:
                continue
            last = k
            while last + 1 < len(copies) and copies[last + 1][0] == copies[last][0] + 1:
                last += 1
            _, x, e, end_src, y = copies[last]
            end_at, s, left, right = y + e - x, a, 0, 0
            while left < substrings.REACH and s > 0 and at - left > 0 and raw[s - 1] == raws[src][at - left - 1]:
                s, left = s - 1, left + 1
            while right < substrings.REACH and e < len(raw) and end_at + right < len(raws[end_src]) and raw[e] == raws[end_src][end_at + right]:
                e, right = e + 1, right + 1
            while s < len(raw) and raw[s] & 0xC0 == 0x80:
                s += 1
            while e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            if e - s >= substrings.MIN_BYTES:
                gone |= set(range(s, e))
        want[i] = (len(gone), bytes(c for k, c in enumerate(raw) if k not in gone).decode())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["removed_bytes"], x["text"] or "") for x in substrings.dedup_substrings(docs).collect()}
    assert got == want and sum(n > 0 for n, _ in want.values()) > 620


def test_cut_points_byte_by_byte():
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(200))
    raw, at = wordhash.text_bytes(pa.array([text, "short", "", text[:70]]))
    ends = substrings.cut_points(raw, at).tolist()
    want = []
    for low, high in zip(at[:-1].tolist(), (at[1:] - 1).tolist(), strict=True):
        h = [0] * (high - low)
        for k in range(high - low):  # the gear hash of the last 16 bytes
            for back in range(min(k, 15), -1, -1):
                h[k] = ((h[k] << 1) + int(substrings._GEAR[raw[low + k - back]])) & 0xFFFF
        cuts = set()
        for k in range(high - low - 2 * substrings.MEAN):
            window = range(k, k + 2 * substrings.MEAN)
            cuts.add(low + max(j for j in window if h[j] == min(h[j] for j in window)) + 1)
        if high > low:
            cuts.add(high)
        want += sorted(cuts)
    assert set(want) >= set(ends) and len(ends) >= 0.98 * len(want)


def test_chunks_resist_shifts():
    r = random.Random(8)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(400))
    for shift in ("x", "some words put in before ", "y" * 500 + " "):
        a, b = (wordhash.text_bytes(pa.array([t])) for t in (text, shift + text))
        plain = set(substrings.cut_points(*a).tolist())
        moved = {e - len(shift) for e in substrings.cut_points(*b).tolist()}
        assert {e for e in plain if e > 80} == {e for e in moved if e > 80}

"""Hard negatives against brute force, and the tree's boxes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakedocs.llm import negatives as N

ROW = "vec_id long, label int, embedding array<float>, rank int, score string"


def brute(rows, relabel=True):
    kept = []
    for order, (i, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if relabel and i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v], order))
    first = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for i, label, v, at in kept:
        if i is None or i % 100:
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j, o, g) for j, g, w, o in kept if len(w) == len(v)]
        same = sorted((s for s in scored if s[3] == label and s[2] != at), key=first)[:5]
        other = sorted((s for s in scored if s[3] != label), key=first)
        for p in same:
            fits = [s for s in other if 30 * p[0] <= 100 * s[0] <= 90 * p[0]][:10]
            out += [(i, p[1], n + 1, s[1], p[0], s[0]) for n, s in enumerate(fits)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def run(spark, rows, slab_rows=N.ROWS):
    table = spark.createDataFrame([(*r, 0, "s") for r in rows], ROW).coalesce(1)
    made = N.quantized(table).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    out = N.hard_negatives(made, F.col("id") % 100 == 0, slab_rows=slab_rows)
    return sorted(map(tuple, out.collect()), key=key)


def vectors(n, dim, seed, clusters=0):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(max(1, clusters), dim))
    return [(k, int(r.integers(4)), (r.normal(size=dim) * (0.2 if clusters else 1) + (middle[r.integers(clusters)] if clusters else 0)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize(("dim", "clusters", "slab_rows"), [(3, 0, 8192), (3, 5, 150), (16, 0, 90), (16, 6, 500)])
def test_against_brute_force(spark, monkeypatch, dim, clusters, slab_rows):
    monkeypatch.setattr(N, "LEAF", 8)
    monkeypatch.setattr(N, "FAN", 3)
    rows = vectors(900, dim, dim, clusters)
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows, slab_rows) == sorted(want, key=key)


def test_odd_rows(spark):
    r = random.Random(1)
    rows = vectors(400, 4, 2)
    rows += [(500, None, [1.0] * 4), (501, 1, None), (502, 1, [1.0, None, 0.0, 0.0]), (503, 1, [float("nan")] * 4), (504, 2, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, [1.0, 2.0, 0.5, 0.5]), (None, 2, [1.0, 2.0, 0.5, 0.5])]
    rows += [(100, r.randrange(4), [1.0, 2.0, 0.5, 0.25])] * 3 + [(600, 9, [1.0] * 4), (700, 3, [-1.0, 0.0, 0.0, 0.0]), (800, 0, [0.0] * 4)]
    # A repeated vector, of more rows than any leaf has.
    rows += [(1000 + k, k % 3, [0.5, 0.5, 1.5, 0.0]) for k in range(600)]
    got = run(spark, rows, 100)
    assert got == sorted(brute(rows), key=key)
    assert run(spark, rows[:0]) == []


def test_length_of_the_commonest(spark):
    rows = vectors(300, 4, 3)
    assert run(spark, [*rows, (5000, 1, [1.0, 2.0]), (5001, 1, [])]) == sorted(brute(rows), key=key)
    assert run(spark, [(1, 1, []), (2, 1, [])]) == []


@pytest.mark.parametrize("scale", [2.0**14, 2.0**20, 2.0**26])
def test_large_components(spark, scale):
    """Sums beyond what doubles hold are exact, those beyond long count as its ends."""
    rows = [(i, g, [float(np.float32(x * scale)) for x in v]) for i, g, v in vectors(300, 6, 4)]
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_boxes_hold_all_products():
    r = np.random.default_rng(5)
    m = r.integers(-300, 300, (1000, 8))
    leaves = N.packed(m, 16)
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= 17
    low, high = np.stack([m[x].min(axis=0) for x in leaves]), np.stack([m[x].max(axis=0) for x in leaves])
    boxes = N.Boxes(low, high, np.zeros(len(leaves)), np.zeros(len(leaves)), np.zeros(len(leaves)))
    q = r.integers(-300, 300, 8)
    a, b = boxes.interval(q)
    assert all(a[k] <= (m[x] @ q).min() and (m[x] @ q).max() <= b[k] for k, x in enumerate(leaves))

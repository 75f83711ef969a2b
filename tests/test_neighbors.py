"""neighbours are found where a document's rows are, and those are moved once."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F
from test_moved import moved

from lakedocs.operators import graph as G, neighbors as N

BLOCK = "block_id string, doc_id string, pos int, page int, type string, text string, meta struct<level:int>"


def test_rows_move_once(spark):
    """A row of each node, edge and seed is dealt out, and nothing after that; joins moved their ids a dozen times."""
    b = spark.createDataFrame([(f"b{k}", f"d{k % 8}", k, 1, "paragraph", "x", (None,)) for k in range(800)], BLOCK).repartition(3).cache()
    nodes, edges = G.graph_nodes(b).cache(), G.contains_edges(b).unionByName(G.follows_edges(b)).cache()
    seeds = b.select("doc_id", F.col("block_id").alias("seed_id"), "block_id")
    every, got = nodes.count() + edges.count() + 800, []
    n = moved(spark, lambda: got.append(G.graph_neighbors(seeds, nodes, edges).groupBy("rel").count().collect()))
    assert {r["rel"]: r["count"] for r in got[0]} == {"follows": 792, "incoming_contains": 800, "incoming_follows": 792, "shared_parent": 800 * 29 + 16}
    assert n <= every + 100


def table(seed=4):
    """Rows of 30 documents, some large, in which ids and seeds repeat from document to document."""
    r, rows = random.Random(seed), []
    for home in range(30):
        n = r.choice([1, 2, 9, 60])
        ids = [b"\x01" + bytes([k]) * 32 if k % 3 else b"\x00%d" % k for k in range(n)]
        rows += [(home, N.NODE, ids[k], b"\x00b%d" % (k // 2) if k else None, None, r.choice([None, 1, 2, 3]), None) for k in range(n)]
        rows += [(home, N.EDGE, r.choice([*ids, b"\x00gone"]), r.choice([*ids, b"\x00lost"]), r.choice(["contains", "zoned", None]), None, None) for _ in range(3 * n)]
        rows += [(home, N.SEED, r.choice([b"\x00b%d" % r.randrange(n), None]), None, None, None, f"s{r.randrange(5)}") for _ in range(n)]
    names = ["home", "kind", "a", "b", "rel", "pos", "seed_id"]
    types = [pa.int64(), pa.int8(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.string()]
    return rows, pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def plain(rows, limit):
    text = lambda x: x[1:].hex() if x[0] == 1 else x[1:].decode()
    out = []
    for home in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == home]
        nodes = {x[2]: x for x in mine if x[1] == N.NODE}
        edges = {(x[2], x[3], x[4]) for x in mine if x[1] == N.EDGE}
        put = lambda k: (-1 if nodes[k][5] is None else nodes[k][5], text(k))  # noqa: B023, E731
        kids = {p: sorted({d for s, d, _ in edges if s == p and d in nodes}, key=put)[: limit + 1] for p, _, _ in edges}
        for seed in {x[6] for x in mine if x[1] == N.SEED}:
            found = set()
            for own in {k for k, x in nodes.items() if x[3] and x[3] in {y[2] for y in mine if y[1] == N.SEED and y[6] == seed}}:
                found |= {(rel, d) for s, d, rel in edges if s == own and d in nodes} | {(rel and "incoming_" + rel, s) for s, d, rel in edges if d == own and s in nodes}
                found |= {("shared_parent", k) for p in {s for s, d, _ in edges if d == own} for k in kids[p] if k != own}
            first = sorted(found, key=lambda x: (x[0] is not None, x[0] or "", *put(x[1])))[:limit]
            out += [(k, seed, rel, nodes[k][5], nodes[k][3], n + 1) for n, (rel, k) in enumerate(first)]
    return sorted(out, key=repr)


def test_documents_in_small_parts(monkeypatch):
    """Whatever a task takes at once, and however many neighbours it makes at once."""
    rows, batch = table()
    for limit in (1, 4, 32):
        want = plain(rows, limit)
        for size, many, part in ((10**6, 10**6, 10**6), (50, 7, 13), (1, 1, 1)):
            monkeypatch.setattr(N, "ROWS", size)
            monkeypatch.setattr(N, "MADE", many)
            parts = [batch.slice(k, part) for k in range(0, batch.num_rows, part)]
            got = [x for some in N.documents(iter(parts)) for made in N.neighbors(some, limit) for x in zip(*[c.to_pylist() for c in made])]
            assert sorted(got, key=repr) == want

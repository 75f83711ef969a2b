"""The neighbours of blocks, found document by document: what a task holds is some documents' nodes, edges and seeds.

Ids are packed: 0x01 and the bytes of a hash in hex, or 0x00 and the text of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that a task takes at once, if a document hasn't more; neighbours that it makes at once, if a seed hasn't more.
ROWS, MADE = 150_000, 500_000
NODE, EDGE, SEED = range(3)
SIBLINGS = "shared_parent"


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by the first column, in tables of whole documents."""
    held, n, most = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        home = rows.column(0).to_numpy()
        last = int(np.searchsorted(home, home[-1]))
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last).to_batches()
        n -= last
        most = max(ROWS, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _of(table: pa.Table, name: str, null=None) -> pa.Array:
    c = table.column(name).combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
    return c if null is None else pc.fill_null(c, null)


def _codes(homes: list[np.ndarray], values: list[pa.Array]) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """A number for each different (home, value) of several columns; the value's own number, and the values."""
    d = pa.concat_arrays(values).dictionary_encode("encode")
    at = np.asarray(d.indices).astype(np.int64)
    code = np.concatenate(homes) * max(1, len(d.dictionary)) + at
    return np.split(code, np.cumsum([len(v) for v in values])[:-1]), at, d.dictionary


def _text_rank(ids: pa.Array) -> np.ndarray:
    """The places of packed ids in the order of their texts."""
    plain = ids.to_pylist()
    order = sorted(range(len(plain)), key=lambda i: plain[i][1:].hex().encode() if plain[i][:1] == b"\x01" else plain[i][1:])
    rank = np.empty(len(plain), np.int64)
    rank[order] = np.arange(len(plain))
    return rank


def _found(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The places of ``codes``; -1 where there is none."""
    at = np.searchsorted(sorted_codes, codes)
    at[at == len(sorted_codes)] = 0
    return np.where(sorted_codes[at] == codes, at, -1) if len(sorted_codes) else np.full(len(codes), -1)


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i ``n[i]`` times, and with it the places from ``first[i]`` on."""
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def neighbors(rows: pa.Table, limit: int) -> Iterator[list[pa.Array]]:
    """key, seed_id, rel, pos, block, rank of the neighbours of some documents' seeds."""
    home = rows.column("home").to_numpy()
    h, kind = np.cumsum(np.diff(home, prepend=home[:1]) != 0), rows.column("kind").to_numpy()
    parts = [np.flatnonzero(kind == k) for k in (NODE, EDGE, SEED)]
    nodes, edges, seeds = (rows.take(pa.array(p)) for p in parts)
    hn, he, hs = (h[p] for p in parts)
    if not len(hn) or not len(hs):
        return
    (kn, ks, kd), at, ids = _codes([hn, he, he], [_of(nodes, "a"), _of(edges, "a"), _of(edges, "b")])
    known, first = np.unique(kn, return_index=True)
    m, node_of = len(known), _found(known, kn)
    place, pos = _of(nodes, "pos"), np.asarray(pc.fill_null(_of(nodes, "pos").cast(pa.int64()), -(2**63)))
    # All nodes in one order, by place and id: a neighbour is a seed, a relation and a place in it.
    by_place = np.lexsort((_text_rank(ids)[at[: len(kn)]][first], pos[first]))
    nth = np.empty(m, np.int64)
    nth[by_place] = np.arange(m)
    src, dst = _found(known, ks), _found(known, kd)
    said = _of(edges, "rel").dictionary_encode("encode")
    names = said.dictionary.to_pylist()
    every = sorted({*names, *(None if x is None else "incoming_" + x for x in names), SIBLINGS}, key=lambda x: (x is not None, (x or "").encode()))
    number, r = {x: i for i, x in enumerate(every)}, len(every)
    to, fro = (np.array([number[x] for x in xs], np.int64)[np.asarray(said.indices)] if len(names) else np.empty(0, np.int64) for xs in (names, [None if x is None else "incoming_" + x for x in names]))
    inside = (src >= 0) & (dst >= 0)
    near = np.unique(np.concatenate([(src[inside] * r + to[inside]) * m + nth[dst[inside]], (dst[inside] * r + fro[inside]) * m + nth[src[inside]]]))
    own = near // m
    near = near[np.arange(len(near)) - np.searchsorted(own, own) < limit]
    near_first = np.searchsorted(near // (r * m), np.arange(m + 1))
    # Children by parent, which need not be a node; parents by child.
    parents, parent = np.unique(ks[dst >= 0], return_inverse=True)
    kids = np.unique(parent * m + nth[dst[dst >= 0]])
    kid_first = np.searchsorted(kids // m, np.arange(len(parents) + 1))
    up = np.unique(dst[dst >= 0] * max(1, len(parents)) + parent)
    up_first = np.searchsorted(up // max(1, len(parents)), np.arange(m + 1))
    # Seeds' nodes.
    (bn, bs), _, _ = _codes([hn, hs], [_of(nodes, "b", b""), _of(seeds, "a", b"")])
    pair = np.divmod(np.unique(bn * m + node_of), m)
    sid = _of(seeds, "seed_id").dictionary_encode("encode")
    seed = hs * max(1, len(sid.dictionary)) + np.asarray(sid.indices)
    start = np.searchsorted(pair[0], bs)
    row, where = _spread(start, np.searchsorted(pair[0], bs, "right") - start)
    row = row[(ok := np.asarray(pc.greater(pc.binary_length(_of(seeds, "a", b"")), 0))[row])]
    met = np.divmod(np.unique(seed[row] * m + pair[1][where[ok]]), m)
    seed_ids, own = np.unique(met[0], return_inverse=True)[0], met[1]
    which = _found(seed_ids, met[0])
    _, seed_row = np.unique(seed, return_index=True)
    seed_row = seed_row[_found(np.unique(seed), seed_ids)] if len(seed_ids) else seed_row[:0]
    n_up = up_first[own + 1] - up_first[own]
    i, at = _spread(up_first[own], n_up)
    mother = up[at] % max(1, len(parents))
    n_kids = np.minimum(kid_first[mother + 1] - kid_first[mother], limit + 1)
    cost = near_first[own + 1] - near_first[own] + np.bincount(i, n_kids, len(own)).astype(np.int64)
    ends = np.cumsum(np.bincount(which, cost, len(seed_ids))) if len(seed_ids) else np.empty(0)
    begin = 0
    while begin < len(seed_ids):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + MADE, "right")))
        a, b = np.searchsorted(which, [begin, end])
        x, where = _spread(near_first[own[a:b]], near_first[own[a:b] + 1] - near_first[own[a:b]])
        rest = near[where] % (r * m)
        made = which[a + x] * (r * m) + rest
        u, v = np.searchsorted(i, [a, b])
        x, where = _spread(kid_first[mother[u:v]], n_kids[u:v])
        kid, line = kids[where] % m, i[u:v][x]
        other = by_place[kid] != own[line]
        made = np.unique(np.concatenate([made, which[line[other]] * (r * m) + number[SIBLINGS] * m + kid[other]]))
        of = made // (r * m)
        rank = np.arange(len(made)) - np.searchsorted(of, of)
        made, of, rank = made[rank < limit], of[rank < limit], rank[rank < limit]
        node = pa.array(first[by_place[made % m]])
        yield [_of(nodes, "a").take(node), _of(seeds, "seed_id").take(pa.array(seed_row[of])), pa.array(every, pa.string()).take(pa.array(made // m % r)), place.take(node), _of(nodes, "b").take(node), pa.array(rank + 1, pa.int32())]
        begin = end

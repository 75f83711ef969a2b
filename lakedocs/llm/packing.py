"""Packing documents into sequences of fixed length by fitted length patterns.

The histogram of piece lengths is small whatever the corpus holds, so the plan is made from it
alone. Patterns are of two kinds: all ways in which one to three pieces fill a sequence, or come as
near to it as the lengths allow (at most ``size ** 2 / 6``), and for short pieces patterns of any
number of them, led by each length in turn (``sampled_patterns``). Repeat counts are fitted to the
histogram by non-negative least squares and rounded in order of size, up as long as the histogram
has the pieces; what is left is fitted again with patterns of its own, as long as that takes up
more. The residual is packed best fit, again by length and count. Spark then deals the pieces
out by their rank among those of equal length.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import written
from .tokens import TEXT_BYTES, encoder
from .wordhash import slices

PIECES = "row_key long, doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def enumerate_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Patterns (rows of three lengths, falling, 0 for none) whose sum is ``size``, or for at most
    three pieces as near to it as the lengths allow. Every one of them, however many lengths occur."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    near = np.maximum.accumulate(np.where(have, np.arange(size + 1), 0))  # the longest length at most so
    desc = np.sort(lengths)[::-1].astype(np.int64)
    out = [np.stack([desc[desc == size], *[np.zeros((desc == size).sum(), np.int64)] * 2], 1)]
    a = desc[desc < size]
    two = near[size - a]
    ok = (two > 0) & (two <= a)
    out.append(np.stack([a[ok], two[ok], np.zeros(ok.sum(), np.int64)], 1))
    for x in a[a * 3 >= size - 2]:
        b = desc[(desc <= x) & (desc < size - x)]
        c = near[size - x - b]
        good = (c > 0) & (c <= b)
        out.append(np.stack([np.full(good.sum(), x), b[good], c[good]], 1))
    return np.concatenate(out)


def sampled_patterns(histogram: np.ndarray, draws: int = 8) -> list[np.ndarray]:
    """Patterns (rows of falling lengths, a table for each number of pieces), led by each length that occurs.

    The room beside the leader is filled with an even sample of the pieces no longer than it: one
    of each m-th part of them by size, with m for their mean length, so that all patterns together
    use lengths about as often as they occur. One piece is then changed for one that makes the sum
    exact, or as near below as the lengths allow. ``draws`` starts of the sample for each leader
    and m; no chance is involved.
    """
    size = len(histogram) - 1
    lengths = np.flatnonzero(histogram)
    near = np.zeros(size + 1, np.int64)
    near[lengths] = lengths
    near = np.maximum.accumulate(near)
    upto, tokens = np.cumsum(histogram), np.cumsum(histogram * np.arange(size + 1))
    out: set[tuple[int, ...]] = set()
    for nth, lead in enumerate(lengths.tolist()):
        room = size - lead
        limit = int(near[min(lead, room)])
        if not limit:
            out.add((lead,))
            continue
        number, mean = int(upto[limit]), tokens[limit] / upto[limit]
        for m in {max(1, int(room / mean)), int(room / mean) + 1}:
            for draw in range(draws):
                u = (draw + (nth * 0.618) % 1) / draws
                held = np.searchsorted(upto, (u + np.arange(m)) / m * number, "right")
                want = held + (room - held.sum())
                ok = np.flatnonzero((want > 0) & (want <= limit))
                if not len(ok):
                    continue
                exact = ok[near[want[ok]] == want[ok]]
                k = exact[(nth + draw) % len(exact)] if len(exact) else ok[np.argmin(want[ok] - near[want[ok]])]
                held[k] = near[want[k]]
                out.add((lead, *sorted(held[held > 0].tolist(), reverse=True)))
    tables = []
    for width in sorted({len(x) for x in out}):
        tables.append(np.array(sorted(x for x in out if len(x) == width), np.int64))
    return tables


def nearest(lengths: np.ndarray, size: int) -> np.ndarray:
    """For each length the largest sum, at most ``size``, of a pattern of any number of pieces that holds it."""
    reach = np.zeros(size + 1, bool)
    reach[0] = True
    for c in range(1, size + 1):
        reach[c] = reach[c - lengths[lengths <= c]].any()
    most = np.maximum.accumulate(np.where(reach, np.arange(size + 1), 0))  # the largest sum at most so
    full = np.arange(size + 1) + most[::-1]
    full[0] = size
    return full


def fit(patterns: np.ndarray | list[np.ndarray], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: repeats of each pattern (row of
    one or several tables) so that they use up the histogram. Longer lengths weigh more, as they
    are harder to place."""
    size = len(histogram) - 1
    tables = [patterns] if isinstance(patterns, np.ndarray) else patterns
    n_pieces = np.concatenate([np.zeros(0, np.int64), *[np.count_nonzero(t, axis=1) for t in tables]]).astype(np.int64)
    n = len(n_pieces)
    if not n:
        return np.zeros(0)
    flat = np.concatenate([t[t > 0] for t in tables])
    first = np.cumsum(n_pieces) - n_pieces
    weight = 0.1 + np.arange(size + 1) / size
    weight[0] = 0
    w2 = weight**2
    x = np.zeros(n)
    # A diagonal bound of the curvature: a pattern's own rows, each shared by the patterns that use it.
    use = np.bincount(flat, np.repeat(n_pieces, n_pieces), size + 1)
    scale = 1 / np.maximum(np.add.reduceat((w2 * use)[flat], first), 1e-12)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        got = np.bincount(flat, np.repeat(y, n_pieces), size + 1)
        slope = np.add.reduceat((w2 * (got - histogram))[flat], first)
        new = np.maximum(0, y - scale * slope)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(tables: list[np.ndarray], repeats: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """(sequences of the patterns, what is left of the histogram): full patterns first, the largest
    repeat counts first; each count is rounded up as far as the histogram has the pieces."""
    left = histogram.tolist()
    out: list[tuple[int, tuple[int, ...]]] = []
    begin = np.cumsum([0, *map(len, tables)])
    total = np.concatenate([np.zeros(0, np.int64), *[t.sum(1) for t in tables]])
    some = np.flatnonzero(repeats > 1e-6)
    order = some[np.lexsort((some, -repeats[some], -total[some]))]
    table = np.searchsorted(begin, order, "right") - 1
    counts = np.ceil(repeats[order] - 1e-6).astype(np.int64)
    for k, row, x in zip(table.tolist(), (order - begin[table]).tolist(), counts.tolist(), strict=True):
        kinds = tuple(v for v in tables[k][row].tolist() if v)
        times = Counter(kinds)
        n = min(x, *(left[v] // c for v, c in times.items()))
        if n > 0:
            for v, c in times.items():
                left[v] -= n * c
            out.append((n, kinds))
    return out, np.array(left, np.int64)


def all_patterns(histogram: np.ndarray, slack: int) -> list[np.ndarray]:
    """Those patterns of both kinds that give away no more than ``slack``, or that hold a length of
    which no pattern of any number of pieces comes nearer to the size."""
    size, lengths = len(histogram) - 1, np.flatnonzero(histogram)
    full = nearest(lengths, size)
    out = []
    for table in (enumerate_patterns(lengths, size), *sampled_patterns(histogram)):
        total = table.sum(1)
        good = table[(total >= size - slack) | (total >= full[table].min(1))]
        if len(good):
            out.append(good)
    return out


def fitted(histogram: np.ndarray, slack: int, rounds: tuple[int, ...] = (300, 100, 100)) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """(sequences of fitted patterns, what is left of the histogram); a fit for each entry of ``rounds``,
    as long as it takes up a twentieth of what the last one left."""
    out, left = [], histogram
    for n in rounds:
        if not left.any():
            break
        tables = all_patterns(left, slack)
        more, rest = rounded(tables, fit(tables, left, n), left)
        out, before, left = out + more, left, rest
        if rest.sum() > 0.95 * before.sum():
            break
    return out, left


def plan(histogram: np.ndarray, slack: float = 0.001) -> list[tuple[int, tuple[int, ...], bool]]:
    """(repeats, lengths, fitted) of sequences that use up the histogram exactly.

    Full patterns waste nothing, and the others no more than ``slack`` of a sequence or what no
    pattern of one of their lengths could use. Of the patterns' sequences that even share is kept
    that makes the fewest sequences together with the pieces left, packed best fit. If best fit
    alone makes fewer than any share, all is packed so, and the log says it.
    """
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    if not left.any():
        return []
    alone = best_fit(left)
    least = sum(n for n, _ in alone)
    whole, _ = fitted(left, int(slack * size))
    upto = np.cumsum([n for n, _ in whole])
    made, fewest = None, least + 1
    for share in (1.0, 0.99, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5, 0.25):
        counts = np.diff(np.floor(upto * share + 1e-9).astype(np.int64), prepend=0).tolist()
        kept = [(n, ls) for n, (_, ls) in zip(counts, whole, strict=True) if n]
        rest = left.copy()
        for n, ls in kept:
            np.subtract.at(rest, list(ls), n)
        others = best_fit(rest)
        total = sum(n for n, _ in kept) + sum(n for n, _ in others)
        if kept and total < fewest:
            made, fewest = [(n, ls, True) for n, ls in kept] + [(n, ls, False) for n, ls in others], total
    if made is None:
        logging.getLogger(__name__).warning("no fitted patterns: best fit alone needs fewer sequences (%d)", least)
    return made or [(n, ls, False) for n, ls in alone]


def best_fit(left: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, each into the open sequences with the least room that still holds it;
    equal sequences move together."""
    size = len(left) - 1
    open_: dict[int, list[tuple[int, tuple]]] = {}  # room: groups (count, nested tuple of lengths)
    rooms: list[int] = []

    def put(room: int, n: int, held: tuple) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((n, held))

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = size // length
                if n >= fits:
                    put(size - fits * length, n // fits, ((), (length,) * fits))
                    n %= fits
                else:
                    put(size - n * length, 1, ((), (length,) * n))
                    n = 0
                continue
            room = rooms[at]
            count, held = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            fits = room // length
            if n >= fits and n // fits >= 1:
                whole = min(count, n // fits)
                put(room - fits * length, whole, (held, (length,) * fits))
                n -= whole * fits
                if count > whole:
                    put(room, count - whole, held)
            else:
                put(room - n * length, 1, (held, (length,) * n))
                if count > 1:
                    put(room, count - 1, held)
                n = 0

    def lengths(held: tuple) -> tuple[int, ...]:
        parts = []
        while held:
            held, tail = held
            parts.append(tail)
        return tuple(x for p in reversed(parts) for x in p)

    return [(n, lengths(held)) for groups in open_.values() for n, held in groups]


def pieces(docs: DataFrame, tokenizer: str, blanks: str, end: int | None, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: a document's ids are cut only if they are more than ``size``.

    ``task`` and ``nth`` number the pieces of equal length as each task meets them. They hold
    only for rows that have been written: compute this once, then read it.
    """

    def cut(batches):
        enc, task, seen, row = encoder(tokenizer, blanks), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in slices(texts, TEXT_BYTES):
                ids, sizes = enc.encode(texts[low:high], end)
                raw, at, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                for k, n in enumerate(sizes.tolist()):
                    for piece, start in enumerate(range(0, n, size)):
                        length = min(size, n - start)
                        rows.append((task << 40 | row, names[low + k], piece, start, length, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)]), task, int(seen[length])))
                        seen[length] += 1
                    at += n
                    row += 1
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [pa.int64() if x.endswith("long") else pa.int32() for x in PIECES.split(", ")]


def pack(docs: DataFrame, tokenizer: str, blanks: str = "whole", end: int | None = None, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, piece, start, length, ids_crc32, sequence_id, offset, fitted).

    ``fitted``: whether the sequence is of a fitted pattern, or of the pieces left over.

    Null text counts as empty. A document without ids (no end id) has no piece. Ids may be null
    or repeat: each row is a document of its own, told apart by ``row_key``. Pieces of equal
    length are interchangeable, so ties need no rule. An empty table has no sequences.
    The driver sees the histogram only: at most ``size`` numbers.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, blanks, end, size, id_col, text_col), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    made = plan(histogram)

    # Ranges of ranks, all lengths one after the other; a range is a slot of a pattern.
    floor = np.cumsum(histogram) - histogram
    used, base, ranges = floor.copy(), 0, []
    for repeats, lengths, fitted in made:
        offset = 0
        for length in lengths:
            ranges.append((int(used[length]), base, offset, int(fitted)))
            used[length] += repeats
            offset += length
        base += repeats
    assert (used == floor + histogram).all(), "the plan doesn't use every piece once"
    table = np.array(sorted(ranges), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((floor, table))  # its size follows ``size``, not the corpus

    over = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")

    def place(batches):
        floor, table = shared.value
        for batch in batches:
            got = dict(zip(batch.schema.names, batch.columns, strict=True))
            rank = floor[np.asarray(got["length"])] + np.asarray(got["before"]) + np.asarray(got["nth"])
            at = np.searchsorted(table[:, 0], rank, "right") - 1
            keep = [got[c] for c in ("row_key", "doc_id", "piece", "start", "length", "ids_crc32")]
            keep[4] = keep[4].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, pa.array(table[at, 1] + rank - table[at, 0]), pa.array(table[at, 2]), pa.array(table[at, 3] == 1)], ["row_key", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fitted"])

    return cut.join(before, ["length", "task"]).mapInArrow(place, "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fitted boolean")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), "drop", 0).drop("row_key")


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}

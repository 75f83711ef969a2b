"""Substring deduplication by content-defined chunks.

A gear hash rolls over the last 16 bytes of a text, and a chunk ends at the least hash of each
window of 64 bytes: what was inserted before a passage moves the chunks but for the first, never
cuts them anew, and no stretch is without a cut. Chunks with equal digests are copies. The first
copy stays. A run of copies, one chunk after another, is extended byte by byte on both sides as
far as the text agrees with the first copy; runs of at least ``min_bytes`` are then removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import keyed, set_aside, spread_join, written
from .wordhash import _BASE, _BASE_INV, _BYTE, _power, mix, slices, text_bytes

MEAN = 32
MIN_BYTES = 100
#: Bytes that a run may be extended by on a side: a window and a hash, and a window of a period.
REACH = 144
_GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256).astype(np.uint16)


def cut_points(raw: np.ndarray, at: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Ends of all chunks of the texts ``raw[at[i]:at[i + 1] - 1]`` (a blank follows each).

    A chunk ends after the byte with the least hash, the last of equals, of any ``2 * mean`` bytes
    of a text, but never within a character. Of ends that follow each other with one hash and one
    distance, as in periodic text, those a window apart are kept. The hash starts anew with each
    text, and each text ends a chunk.
    """
    h = _GEAR[raw]
    place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    for k in (1, 2, 4, 8):
        back = np.zeros_like(h)
        back[k:] = h[:-k] << np.uint16(k)
        back[place < k] = 0
        h = h + back
    last = at[1:] - 1
    full = last[np.diff(at) > 1]
    window, span = 2 * mean, 1
    if len(raw) < window:
        return full
    low = h.astype(np.int64)
    low[:-1][(raw[1:] & 0xC0) == 0x80] = 1 << 16
    low = (low << 32) - np.arange(len(raw))
    while 2 * span <= window:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < window:
        low = np.minimum(low[: span - window], low[window - span :])
    inside = np.arange(len(low)) + window <= np.repeat(last, np.diff(at))[: len(low)]
    least = -low[inside] & 0xFFFFFFFF
    ends = least[np.diff(least, prepend=-1) > 0] + 1
    if len(ends) > 2:
        v, gap, text = h[ends - 1], np.diff(ends), np.searchsorted(at, ends - 1, "right")
        same = np.zeros(len(ends), bool)
        same[2:] = (v[2:] == v[1:-1]) & (v[1:-1] == v[:-2]) & (gap[1:] == gap[:-1]) & (text[2:] == text[:-2])
        nth = np.arange(len(ends))
        nth -= np.maximum.accumulate(np.where(same, 0, nth))
        ends = ends[~same | (nth % np.maximum(1, window // np.concatenate([[window], gap])) == 0)]
    return np.union1d(ends, full)


def chunks(docs: DataFrame, text_col: str, mean: int) -> DataFrame:
    """(_key, n_bytes, starts, lengths, digests, earlier): a row a document; ``earlier`` is where the
    document itself has the chunk first, -1 for that first one. Written."""
    schema = "_key long, n_bytes long, starts array<int>, lengths array<int>, digests array<long>, earlier array<int>"

    def scan(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                raw, at = text_bytes(batch.column(1)[lo:hi])
                ends = cut_points(raw, at, mean)
                text = np.searchsorted(at, ends - 1, "right") - 1
                starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
                first = np.ones(len(ends), bool)
                first[1:] = text[1:] != text[:-1]
                starts[first] = at[text[first]]
                total = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw))[: len(raw)], out=total[1:])
                n = ends - starts
                digest = mix((total[ends] - total[starts]) * _power("down", _BASE_INV, len(raw))[starts] + n.astype(np.uint64)).view(np.int64)
                order = np.lexsort((starts, digest, text))
                again = np.zeros(len(ends), bool)
                again[1:] = (digest[order[1:]] == digest[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(ends))))]
                earlier = np.empty(len(ends), np.int64)
                earlier[order] = np.where(again, (starts - at[text])[lead], -1)
                bound = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bound, x) for x in (pa.array(starts - at[text], pa.int32()), pa.array(n, pa.int32()), pa.array(digest), pa.array(earlier, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(at) - 1), *lists], ["_key", "n_bytes", "starts", "lengths", "digests", "earlier"])

    return written(docs.select("_key", F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema), "chunks")


def repeated_runs(cut: DataFrame) -> DataFrame:
    """(_key, at, right, src_key, src_at): the two edges of each run of later copies, and where the
    first copy has that edge. Written.

    A chunk of a third of all documents is a key that is counted before it is shuffled, and joined
    back apart from the others.
    """
    rows = cut.select("_key", F.posexplode(F.arrays_zip("starts", "lengths", "digests", "earlier")).alias("nth", "c")).select("_key", "nth", F.col("c.starts").alias("start"), F.col("c.lengths").alias("length"), F.col("c.digests").alias("digest"), F.col("c.earlier").alias("earlier"))
    fresh = rows.filter("earlier < 0")
    first = fresh.groupBy("digest").agg(F.min(F.struct("_key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = spread_join(fresh, written(first, "digests"), ["digest"]).filter("_key <> first._key").select("_key", "nth", "start", "length", F.col("first._key").alias("src_key"), F.col("first.start").alias("src_at"))
    copies = later.unionByName(rows.filter("earlier >= 0").select("_key", "nth", "start", "length", F.col("_key").alias("src_key"), F.col("earlier").alias("src_at")))
    run = F.col("nth") - F.row_number().over(Window.partitionBy("_key").orderBy("nth"))
    runs = copies.withColumn("run", run).groupBy("_key", "run").agg(
        F.min(F.struct(F.col("start").alias("at"), F.lit(False).alias("right"), "src_key", "src_at")).alias("l"),
        F.max(F.struct((F.col("start") + F.col("length")).alias("at"), F.lit(True).alias("right"), "src_key", (F.col("src_at") + F.col("length")).alias("src_at"))).alias("r"),
    )
    return written(runs.select("_key", F.explode(F.array("l", "r")).alias("e")).select("_key", "e.*"), "runs")


def first_copies(docs: DataFrame, edges: DataFrame, text_col: str) -> DataFrame:
    """``edges`` with ``near``: up to ``REACH`` bytes of the first copy, before a left edge and
    after a right one. A place that many runs name is read once, and joined back apart from the others."""
    places = ["src_key", "src_at", "right"]
    asked = edges.groupBy(*places).agg(F.count(F.lit(1)).alias("n")).groupBy("src_key").agg(F.collect_list(F.struct("src_at", "right", "n")).alias("asked"))
    raw = F.encode(F.col(text_col).cast("string"), "UTF-8")
    low = lambda a: F.when(a["right"], a["src_at"]).otherwise(F.greatest(F.lit(0), a["src_at"] - REACH))
    size = lambda a: F.when(a["right"], F.lit(REACH)).otherwise(F.least(F.lit(REACH), a["src_at"]))
    near = F.transform("asked", lambda a: F.struct(a["src_at"].alias("src_at"), a["right"].alias("right"), a["n"].alias("n"), F.substring(raw, low(a) + 1, size(a)).alias("near")))
    texts = docs.select(F.col("_key").alias("src_key"), text_col).join(asked.hint("merge"), "src_key")
    found = texts.select("src_key", F.explode(near).alias("n")).select("src_key", "n.*")
    return spread_join(edges, written(found, "first-copies"), places)


def agree(a: bytes, b: bytes, right: bool) -> int:
    """Bytes that ``a`` and ``b`` share from their starts, or up to their ends."""
    n = min(len(a), len(b))
    if right:
        x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    else:
        x = int.from_bytes(a[len(a) - n :], "big") ^ int.from_bytes(b[len(b) - n :], "big")
    return ((x & -x).bit_length() - 1) // 8 if x else n


def extended(raw: bytes, edges: list[dict], min_bytes: int) -> list[dict]:
    """Spans of ``raw``, whole characters, that the runs cover once extended; overlaps merge."""
    edges = sorted(edges, key=lambda e: e["at"])
    spans: list[dict] = []
    for left, right in zip(edges[::2], edges[1::2]):
        s, e = left["at"], right["at"]
        s -= agree(raw[max(0, s - REACH) : s], left["near"], False)
        e += agree(raw[e : e + REACH], right["near"], True)
        while s < len(raw) and raw[s] & 0xC0 == 0x80:
            s += 1
        while e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if e - s < min_bytes:
            continue
        while spans and spans[-1]["end"] >= s:
            s, e = min(s, spans[-1]["start"]), max(e, spans[-1]["end"])
            spans.pop()
        spans.append({"start": s, "end": e})
    return spans


def repeated_spans(min_bytes: int):
    """A function of (text, edges) that gives the spans to remove."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for texts, edges in batches:
            found = [e and (extended(t.encode(), e, min_bytes) or None) for t, e in zip(texts.to_pylist(), edges.to_pylist())]
            yield pa.array(found, kind)

    return spans


def dedup_substrings(docs: DataFrame, mean: int = MEAN, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated passages cut out of the text, and ``n_bytes`` (before),
    ``removed_bytes`` and ``n_spans``.

    The copy that stays is that of the least id, within a document the first. A passage of
    ``4 * mean + 15`` bytes holds a chunk wherever it stands, so none that long is missed. Null text stays
    null; empty text has no chunks. Ids that are null or repeated: rows count in input order; of
    repeated rows the first keeps its text. Columns of ``docs`` with those three names are replaced, all
    others are kept. Very long texts are cut in one piece, by one task each. An empty table stays empty.
    """
    docs, away = set_aside(docs.drop("n_bytes", "removed_bytes", "n_spans"), ["_key", "_k", "_edges", "_spans"])
    now = {old: new for new, old in away.items()}
    id_col, text_col = now.get(id_col, id_col), now.get(text_col, text_col)
    docs = keyed(docs, id_col)
    edges = first_copies(docs, repeated_runs(chunks(docs, text_col, mean)), text_col)
    by_doc = edges.groupBy(F.col("_key").alias("_k")).agg(F.collect_list(F.struct("at", "right", "near")).alias("_edges"))
    text = F.col(text_col).cast("string")
    # Bytes between the spans, in order; spans lie at character bounds.
    raw = F.encode(text, "UTF-8")
    keep = F.transform(F.sequence(F.lit(0), F.size("_spans")), lambda i: F.decode(F.substring(raw, F.when(i == 0, 1).otherwise(F.get("_spans", i - 1)["end"] + 1), F.greatest(F.lit(0), F.when(i == F.size("_spans"), F.length(raw)).otherwise(F.get("_spans", i)["start"]) - F.when(i == 0, 0).otherwise(F.get("_spans", i - 1)["end"]))), "UTF-8"))
    joined = docs.join(by_doc.hint("merge"), docs["_key"] == by_doc["_k"], "left").withColumn("_spans", repeated_spans(min_bytes)(text, F.col("_edges"))).drop("_edges")
    return joined.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "removed_bytes": F.coalesce(F.aggregate("_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]), F.lit(0)).cast("long"),
        "n_spans": F.coalesce(F.when(F.col("_spans").isNotNull(), F.size("_spans")), F.lit(0)).cast("long"),
        text_col: F.when(F.col("_spans").isNotNull(), F.array_join(keep, "")).otherwise(text),
    }).drop("_key", "_k", "_spans").withColumnsRenamed(away)


def op10_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "removed_bytes", "n_spans", "text")


QUERIES = {"op10_content_chunks": op10_content_chunks}

"""Hard negatives of integer vectors by a packed R-tree.

Rows are dealt to slabs by label and first coordinate, and each slab is packed by sort-tile-recursive
order into leaves. A node's minimum bounding box gives, for each anchor, an interval of inner
products coordinate by coordinate. A best-first queue takes boxes by their upper end and leaves out
those that miss all score windows or lie below the kth score found. The slabs' own boxes say which
slabs an anchor is sent to: first to the most promising one, then, with the scores found there, to
those that may still do better.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import keyed, written

#: Rows of a slab, while that makes no more than ``SLABS`` of them (their boxes are held by every task); of a leaf; nodes of a node; coordinates that tiles are cut by.
ROWS, SLABS, LEAF, FAN, TILED = 8192, 8192, 256, 16, 3
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_ROW = "slab int, kind int, leaf int, key long, id long, label long, v array<long>"


def packed(m: np.ndarray, size: int, tiled: int = TILED) -> list[np.ndarray]:
    """Row numbers of each leaf of at most ``size`` rows: sorted and cut into slices by the coordinate of
    largest variance, each slice by the next."""
    by = np.argsort(-m.astype(np.float64).var(axis=0), kind="stable")[:tiled] if len(m) and m.shape[1] else np.empty(0, int)

    def tiles(rows: np.ndarray, level: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // size)
        if leaves <= 1:
            return [rows]
        if level >= len(by):
            return np.array_split(rows, leaves)
        rows = rows[np.argsort(m[rows, by[level]], kind="stable")]
        slices = round(leaves ** (1 / (len(by) - level))) if level < len(by) - 1 else leaves
        return [x for part in np.array_split(rows, max(1, slices)) for x in tiles(part, level + 1)]

    return tiles(np.arange(len(m)), 0)


def matrix(column: pa.Array, n: int, kind: str) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(n, -1).astype(kind)


def build(rows: DataFrame, slabs: int) -> DataFrame:
    """The tree's rows (``kind`` 0) by slab and leaf, and each slab's box: least (1) and greatest (2) label and coordinates.

    Ranges end with the row's key, so a repeated vector is spread like any other row; a task holds
    one slab. A leaf has rows of one label.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        m = matrix(table["v"].combine_chunks(), len(table), "int64")
        label, key = table["label"].to_numpy(), table["key"].to_numpy()
        base = np.lexsort((key, label))
        cuts = np.flatnonzero(np.diff(label[base])) + 1
        leaves = [part[x] for part in np.split(base, cuts) for x in packed(m[part], LEAF)]
        leaf, order = np.repeat(np.arange(len(leaves), dtype=np.int32), [len(x) for x in leaves]), np.concatenate(leaves)
        slab, n = TaskContext.get().partitionId(), len(order)

        def batch(kind: int, leaf, key, ids, label, v: np.ndarray) -> pa.RecordBatch:
            size = len(v)
            offsets = pa.array(np.arange(size + 1) * v.shape[1], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, slab, np.int32)), pa.array(np.full(size, kind, np.int32)), pa.array(leaf, pa.int32()), pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(label, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), pa.int64()))], names=["slab", "kind", "leaf", "key", "id", "label", "v"])

        ids = table["id"].combine_chunks().take(pa.array(order))
        for low in range(0, n, 4096):
            part = order[low : low + 4096]
            yield batch(0, leaf[low : low + 4096], key[part], ids.slice(low, 4096), label[part], m[part])
        yield batch(1, [-1], [0], [None], [label.min()], m.min(axis=0, keepdims=True))
        yield batch(2, [-1], [0], [None], [label.max()], m.max(axis=0, keepdims=True))

    ranged = rows.select("key", "id", "label", "v").repartitionByRange(slabs, "label", F.get("v", F.lit(0)), "key")
    return written(ranged.mapInArrow(pack, _ROW), "rtree")


class Boxes:
    """Nodes' boxes: coordinates, labels, and the least id within."""

    def __init__(self, low, high, label_low, label_high, least_id, first=None, last=None):
        self.low, self.high, self.label_low, self.label_high, self.least_id, self.first, self.last = low, high, label_low, label_high, least_id, first, last

    def above(self) -> Boxes:
        """A level of nodes of ``FAN`` of these."""
        at = np.arange(0, len(self.low), FAN)
        return Boxes(np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.minimum.reduceat(self.label_low, at), np.maximum.reduceat(self.label_high, at), np.minimum.reduceat(self.least_id, at), at, np.append(at[1:], len(self.low)))

    def interval(self, q: np.ndarray, at=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product with ``q`` (one vector or a row each) that boxes allow."""
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
        return self.low[at] @ up + self.high[at] @ down, self.high[at] @ up + self.low[at] @ down

    def fits(self, label: int, same: bool, at=slice(None)) -> np.ndarray:
        """Whether boxes may hold a row of this label (``same``), or of another."""
        low, high = self.label_low[at], self.label_high[at]
        return (low <= label) & (label <= high) if same else (low != label) | (high != label)


class Tree:
    """A slab's rows in the order of their leaves, and the levels of boxes over them, the leaves' first."""

    def __init__(self, table: pa.Table, kind: str):
        self.m = matrix(table["v"].combine_chunks(), len(table), kind)
        self.label, self.key = table["label"].to_numpy(), table["key"].to_numpy()
        self.no_id, self.id = np.asarray(table["id"].is_null()), table["id"].fill_null(MOST).to_numpy()
        at = np.flatnonzero(np.diff(table["leaf"].to_numpy(), prepend=-1))
        least = [np.minimum.reduceat(x, at) for x in (self.m, self.label, self.id)]
        most = [np.maximum.reduceat(x, at) for x in (self.m, self.label)]
        self.levels = [Boxes(least[0], most[0], least[1], most[1], least[2], at, np.append(at[1:], len(self.m)))]
        while len(self.levels[-1].low) > FAN:
            self.levels.append(self.levels[-1].above())

    def best(self, q: np.ndarray, key: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[list[tuple]]:
        """For each window (lowest, highest score) the first k rows as (-score, no id, id, key)."""
        held: list[list[tuple]] = [[] for _ in windows]
        # What a row must reach: the window's low end, then the kth found, by score and id.
        must = [(low, MOST) for low, _ in windows]
        queue: list[tuple] = []

        def put(level: int, at: slice) -> None:
            boxes = self.levels[level]
            low, high = boxes.interval(q, at)
            okay, least = boxes.fits(label, same, at), boxes.least_id[at]
            any_window = np.zeros(len(low), bool)
            for (score, first), (_, top) in zip(must, windows, strict=True):
                any_window |= (low <= top) & ((high > score) | ((high == score) & (least <= first))) & (score <= top)
            for j in np.flatnonzero(okay & any_window):
                heapq.heappush(queue, (-high[j], least[j], level, at.start + int(j), low[j]))

        put(len(self.levels) - 1, slice(0, len(self.levels[-1].low)))
        while queue:
            high, least, level, node, low = heapq.heappop(queue)
            high = -high
            if all((high, -least) < (score, -first) for score, first in must):
                break
            if not any((high, -least) >= (score, -first) and low <= top for (score, first), (_, top) in zip(must, windows, strict=True)):
                continue
            rows = slice(int(self.levels[level].first[node]), int(self.levels[level].last[node]))
            if level:
                put(level - 1, rows)
                continue
            scores = self.m[rows] @ q
            if scores.dtype == object:
                scores = np.clip(scores, LEAST, MOST)
            right = (self.label[rows] == label) & (self.key[rows] != key) if same else self.label[rows] != label
            for w, (_, top) in enumerate(windows):
                at = np.flatnonzero(right & (scores >= must[w][0]) & (scores <= top))
                if len(at):
                    held[w] += [(-int(scores[j]), bool(self.no_id[rows.start + j]), int(self.id[rows.start + j]), int(self.key[rows.start + j])) for j in at]
                    held[w].sort()
                    del held[w][k:]
                    if len(held[w]) == k:
                        must[w] = (-held[w][-1][0], held[w][-1][2])
        return held


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Runs of rows of one slab and kind, in order."""
    for batch in batches:
        slab, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(slab) != 0) | (np.diff(kind) != 0)) + 1), len(slab)]
        for low, high in zip(edges, edges[1:], strict=False):
            if high > low:
                yield batch.slice(low, high - low), int(slab[low]), int(kind[low])


def searched(index: DataFrame, sent: DataFrame, k: int, same: bool, number: str) -> DataFrame:
    """(key, w, score, id, other): the first k rows of each slab for each window of the anchors sent to it. A task
    holds one slab and a batch of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, now = [], None, None
        for part, slab, kind in _batches(batches):
            if slab != now:
                held, tree, now = [], None, slab
            if kind == 0:
                held.append(part)
                continue
            if tree is None and held:
                tree, held = Tree(pa.Table.from_batches(held).combine_chunks(), number), []
            q = matrix(part.column("v"), part.num_rows, number)
            out: list[tuple] = []
            for j, (key, label, lows, highs) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "label", "lows", "highs")), strict=True)):
                for w, found in enumerate(tree.best(q[j], key, label, same, list(zip(lows, highs, strict=True)), k)):
                    out += [(key, w, -score, None if no_id else ids, other) for score, no_id, ids, other in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "w", "score", "id", "other"])

    none = F.lit(None).cast("array<long>")
    tree = index.filter("kind = 0").withColumns({"lows": none, "highs": none})
    both = tree.unionByName(sent.select(*tree.columns)).repartition("slab").sortWithinPartitions("slab", "kind", "leaf")
    return both.mapInArrow(run, "key long, w int, score long, id long, other long")


def routed(asked: DataFrame, boxes: Boxes, same: bool, number: str, first: bool) -> DataFrame:
    """``asked`` (key, id, label, v, lows, highs) for each slab that may hold an answer: the most promising one, or all others."""
    shared = asked.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                q = matrix(batch.column("v"), batch.num_rows, number)
                low, high = boxes.interval(q)
                slab_of, row_of = [], []
                for j, (label, lows, highs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "lows", "highs")), strict=True)):
                    fits, useful = boxes.fits(label, same), np.zeros(len(low), bool)
                    for a, b in zip(lows, highs, strict=True):
                        useful |= fits & (low[:, j] <= b) & (high[:, j] >= a) & (a <= b)
                    slabs = np.flatnonzero(useful)
                    if len(slabs):
                        best = slabs[np.argmax(np.minimum(high[slabs, j], max(highs)))]
                        slabs = np.array([best]) if first else slabs[slabs != best]
                    slab_of.append(slabs.astype(np.int32))
                    row_of.append(np.full(len(slabs), j))
                rows = pa.array(np.concatenate(row_of)) if row_of else pa.array([], pa.int64())
                taken = batch.take(rows)
                n = taken.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slab_of)) if slab_of else pa.array([], pa.int32()), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32)), *(taken.column(c) for c in ("key", "id", "label", "v", "lows", "highs"))], names=["slab", "kind", "leaf", "key", "id", "label", "v", "lows", "highs"])

    return asked.select("key", "id", "label", "v", "lows", "highs").mapInArrow(run, f"{_ROW}, lows array<long>, highs array<long>")


def best_rows(index: DataFrame, boxes: Boxes, asked: DataFrame, k: int, same: bool, number: str) -> DataFrame:
    """(key, w, score, id, other, rank): for each anchor and window of ``asked`` the first k rows of its label, itself left
    out (``same``), or of other labels, by score, then id (null last), then key."""
    first = written(searched(index, routed(asked, boxes, same, number, True), k, same, number), "first-slab")
    # With k rows found, what follows must reach the kth score.
    kth = first.groupBy("key", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    kth = kth.groupBy(F.col("key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.try_element_at("kth", w)))
    # The most promising slab must come out the same again: it goes by the windows' high ends and the boxes alone.
    rest = asked.join(kth, asked["key"] == kth["_key"], "left").withColumn("lows", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(raised))
    more = written(searched(index, routed(rest, boxes, same, number, False), k, same, number), "other-slabs")
    order = Window.partitionBy("key", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return first.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "id", label_col: str = "label", vector_col: str = "v", slab_rows: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all but ``rank`` long.

    ``rows``: integer vectors. Rows with a null label, a null vector or a null component take no
    part, nor do vectors of another length than the commonest (of equals the longest). Scores are
    exact inner products; those beyond long count as its ends. An anchor's positives are its first other
    rows of its label; for each, the first rows of other labels whose score is from ``low`` to
    ``high`` hundredths of the positive's. Higher scores first, ties by smaller id, null ids last,
    then by input order. Repeated rows and ids are rows of their own, anchors too; anchors without
    positives or negatives have no rows; an empty table gives an empty result. Other columns are
    not read.
    """
    spark = rows.sparkSession
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    taken = written(keyed(taken.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())), "id").withColumnRenamed("_key", "key"), "vectors")
    sizes = taken.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"))
    commonest = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if commonest is None or not commonest["dim"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, n = commonest["dim"], commonest["n"]
    taken = taken.filter(F.size("v") == dim)
    # Numbers that hold all sums of products exactly.
    reach = dim * (commonest["most"] + 1) ** 2
    number = "float64" if reach < 2**53 else "int64" if reach < 2**62 else "object"
    index = build(taken, max(1, min(SLABS, -(-n // slab_rows))))
    ends = {(r["slab"], r["kind"]): r for r in index.filter("kind > 0").collect()}  # two rows a slab
    slabs = 1 + max(s for s, _ in ends)
    # A slab without rows has a box that fits nothing.
    side = lambda kind, of, empty: [of(ends[s, kind]) if (s, kind) in ends else empty for s in range(slabs)]
    boxes = Boxes(np.array(side(1, lambda r: r["v"], [0] * dim)).astype(number), np.array(side(2, lambda r: r["v"], [0] * dim)).astype(number), np.array(side(1, lambda r: r["label"], MOST)), np.array(side(2, lambda r: r["label"], LEAST)), np.zeros(slabs, np.int64))
    asked = taken.filter("anchor").drop("anchor").withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    near = written(best_rows(index, boxes, asked, positives, True, number).select("key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Windows of an anchor: one for each different score of its positives.
    scores = near.groupBy("key").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    share = lambda of, end: F.transform("scores", lambda s: end(s.cast("decimal(25,0)") * F.lit(of) / 100).cast("long"))
    windows = scores.select(F.col("key").alias("_key"), "scores", share(low, F.ceil).alias("lows"), share(high, F.floor).alias("highs"))
    asked = written(taken.filter("anchor").join(windows, F.col("key") == F.col("_key")).select("key", "id", "label", "v", "scores", "lows", "highs"), "windows")
    far = best_rows(index, boxes, asked, negatives, False, number)
    named = far.join(asked.select("key", F.col("id").alias("anchor_id"), "scores"), "key").withColumn("positive_score", F.get("scores", F.col("w")))
    return near.drop("rank").join(named, ["key", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def quantized(embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", steps: int = 256) -> DataFrame:
    """(id, label, v): components as whole ``1 / steps``, rounded down. Rows with a null label or vector, or a null or
    non-finite component, take no part."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * steps))
    return embeddings.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def op11_packed_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES = {"op11_packed_rtree": op11_packed_rtree}

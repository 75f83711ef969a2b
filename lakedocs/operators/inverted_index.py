"""The inverted index as tables on disk: segments of postings, bucketed and sorted by term.

A segment holds the postings of the chunks of one change in blocks, which name chunks by numbers of eight bytes, the ids
of those numbers, the change that it makes to each term's
statistics (so old counts go down where chunks go), and the ids of the chunks that it replaces: their
postings in earlier segments are dead. Questions are joined with each segment on its own buckets, so
no posting is shuffled; a term's list is dealt to ``SPLIT`` parts, for the sake of terms that are in
every third chunk. Segments are merged when there are more than ``SEGMENTS``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.stage import shuffles_go
from ..sources.store import Commit, Store, Table
from .keyword import STOP, words_of

BUCKETS, SPLIT, SEGMENTS = 32, 4, 8
#: Words that a task turns into blocks at once; a chunk of more is taken by itself.
WORDS = 500_000
#: The table of a store that knows each chunk's terms, to take them out again.
FORWARD = Table(("chunk_id",), 32)
_BLOCK = "term string, part int, chunk_ids array<string>, lengths array<int>, ends array<int>, positions array<int>, leads int"
#: What a posting on disk calls its chunk: the segment's place and the chunk's number there.
_CALLED = "struct<segment:int,n:bigint>"
_IDS = "chunk_id string, n long"
_POSTING = "term string, part int, chunk_id string, tf int, positions array<int>, length int"


def _batch(term: pa.Array, part: np.ndarray, chunk: pa.Array, length: np.ndarray, starts: np.ndarray, places: np.ndarray, at: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
    """Blocks that begin at the postings ``at``; a posting's places begin at ``starts``."""
    n, ends = np.diff(np.append(at, len(starts))), np.append(starts[1:], len(places))
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    own = lists(np.append(at, len(starts)), chunk), lists(np.append(at, len(starts)), pa.array(length, pa.int32())), lists(np.append(at, len(starts)), pa.array(ends - np.repeat(starts[at], n), pa.int32()))
    return pa.RecordBatch.from_arrays([term, pa.array(part, pa.int32()), *own, lists(np.append(starts[at], len(places)), pa.array(places, pa.int32())), pa.array(np.add.reduceat(lead, at), pa.int32())], names=[c.split()[0] for c in _BLOCK.split(", ")])


def blocks_of(chunks: DataFrame, text_col: str = "text", only: int | None = None) -> DataFrame:
    """Postings in blocks: a row for each term and part of each batch of chunks, with its chunks, their lengths, and all places,
    those of the i-th chunk up to ``ends[i]``. Made without a shuffle. ``leads``: how many postings are
    their chunk's first, so that chunks can be counted. Chunk ids must be unique and not null; null
    texts have no terms. ``only``: the blocks of one part."""

    most = WORDS

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches in slices of so many words, however long their texts are."""
        for batch in batches:
            offsets, start = np.asarray(batch.column(2).offsets), 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
                yield batch.slice(start, end - start)
                start = end

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(STOP)
        for batch in sliced(batches):
            words = batch.column(2)
            n, flat = np.diff(np.asarray(words.offsets)), words.flatten()
            if not len(flat):
                continue
            row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            place = np.arange(len(flat)) - np.repeat(first, n)
            keep = ~np.asarray(pc.is_in(flat, stop))
            code = flat.dictionary_encode()
            row, place, term = row[keep], place[keep], np.asarray(code.indices)[keep].astype(np.int64)
            if not len(row):
                continue
            length, part = np.bincount(row, minlength=len(n)), batch.column(1).to_numpy().astype(np.int64)
            block = part[row] * len(code.dictionary) + term
            order = np.argsort(block * len(n) + row, kind="stable")
            row, place, term, block = row[order], place[order], term[order], block[order]
            starts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            of = row[starts]
            lead = np.zeros(len(of), np.int64)
            lead[np.unique(of, return_index=True)[1]] = 1
            at = np.flatnonzero(np.diff(block[starts], prepend=-1))
            yield _batch(code.dictionary.take(pa.array(term[starts[at]])), part[of[at]], batch.column(0).take(pa.array(of)), length[of], starts, place, at, lead)

    part = F.pmod(F.xxhash64("chunk_id"), F.lit(SPLIT)).cast("int")
    chunks = chunks if only is None else chunks.filter(part == only)
    return chunks.select(F.col("chunk_id").cast("string"), part.alias("part"), words_of(text_col).alias("words")).mapInArrow(invert, _BLOCK)


def _blocks_again(rows: DataFrame) -> DataFrame:
    """Blocks of postings that are sorted by term and part, as far as an Arrow batch goes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                term, part, places = b.column(0), b.column(1).to_numpy(), b.column(4)
                code = np.asarray(term.dictionary_encode().indices)
                at = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                starts = np.asarray(places.offsets)[:-1] - np.asarray(places.offsets)[0]
                yield _batch(term.take(pa.array(at)), part[at], b.column(2), b.column(5).to_numpy(), starts, np.asarray(places.flatten()), at, np.zeros(b.num_rows, np.int64))

    sorted_rows = rows.select(*[c.split()[0] for c in _POSTING.split(", ")]).repartition(BUCKETS, "term", "part").sortWithinPartitions("term", "part")
    return sorted_rows.mapInArrow(pack, _BLOCK)


def _opened(blocks: DataFrame) -> DataFrame:
    """A row for each posting of ``blocks``: chunk_id, tf, positions and length in place of the block's lists."""
    rest = [c for c in blocks.columns if c not in ("chunk_ids", "lengths", "ends", "positions", "leads")]
    rows = blocks.select(*rest, "lengths", "ends", "positions", F.posexplode("chunk_ids").alias("_i", "chunk_id"))
    start = F.when(F.col("_i") > 0, F.get("ends", F.col("_i") - 1)).otherwise(0)
    tf = F.get("ends", F.col("_i")) - start
    return rows.select(*rest, "chunk_id", tf.alias("tf"), F.slice("positions", start + 1, tf).alias("positions"), F.get("lengths", F.col("_i")).alias("length"))


def _chunk_number(chunk_id: Column, salt: int) -> Column:
    return F.xxhash64(chunk_id, F.lit(salt))


def _called(blocks: DataFrame, salt: int) -> DataFrame:
    """Blocks with numbers for ids: an id is twice as long as all else of a posting."""
    return blocks.withColumn("chunk_ids", F.transform("chunk_ids", lambda c: _chunk_number(c, salt)))


def _table(spark: SparkSession, path: str, schema: StructType, by: tuple[str, ...]) -> DataFrame:
    """A bucketed table at ``path``, told to this session's catalog if it isn't yet."""
    name = "lakedocs_" + hashlib.md5(path.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by ({', '.join(by)}) sorted by (term) into {BUCKETS} buckets location '{path}'")
    return spark.table(name)


def _write(df: DataFrame, path: str, by: tuple[str, ...], more: bool = False) -> None:
    """One file a bucket: the rows are dealt out as the table's buckets are. ``more``: beside those that are there."""
    name = "lakedocs_" + hashlib.md5(path.encode()).hexdigest()
    if not more:
        df.sparkSession.sql(f"drop table if exists {name}")
    dealt = df.repartition(BUCKETS, *by).sortWithinPartitions("term")
    with shuffles_go(df.sparkSession):
        dealt.write.mode("append" if more else "overwrite").format("parquet").bucketBy(BUCKETS, *by).sortBy("term").option("path", path).option("compression", "zstd").saveAsTable(name)


def _union(parts: list[DataFrame], again: str | None = "term") -> DataFrame:
    """Segments' rows together. The term is written anew: Spark takes a union of bucketed tables as dealt by their
    buckets, but adaptive execution may have read them otherwise, and a term's rows would then be summed apart."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if len(parts) == 1 or again is None else out.withColumn(again, F.concat(again, F.lit("")))


class Index:
    """The segments that a commit names, to be asked."""

    def __init__(self, spark: SparkSession, root: str, segments: list[dict]):
        self.spark, self.root, self.segments = spark, root, segments
        self.chunks, total = (sum(s[k] for s in segments) for k in ("chunks", "length"))
        self.mean = total / self.chunks if self.chunks else 0.0

    def _path(self, segment: dict, what: str) -> str:
        return f"{self.root}/_index/seg={segment['number']}/{what}"

    def _blocks(self, segment: dict) -> DataFrame:
        return _table(self.spark, self._path(segment, "postings"), StructType.fromJson(segment["postings"]), ("term", "part"))

    def _terms(self, segment: dict) -> DataFrame:
        return _table(self.spark, self._path(segment, "terms"), StructType.fromJson(segment["terms"]), ("term",))

    def _ids(self, k: int) -> DataFrame:
        return self.spark.read.schema(_IDS).parquet(self._path(self.segments[k], "ids"))

    def _gone(self, k: int) -> DataFrame | None:
        """The chunks that segments after ``k`` replace."""
        gone = [self.spark.read.schema("chunk_id string").parquet(self._path(s, "gone")) for s in self.segments[k + 1 :] if s["gone"]]
        return _union(gone, None) if gone else None

    def _alive(self, rows: DataFrame, k: int) -> DataFrame:
        """Rows of segment ``k`` without those of chunks that later segments replace."""
        gone = self._gone(k)
        if gone is not None:
            rows = rows.join(self._ids(k).join(gone, "chunk_id", "left_semi").select(F.col("n").alias("chunk_id")), "chunk_id", "left_anti")
        return rows.withColumn("chunk_id", F.struct(F.lit(k).alias("segment"), F.col("chunk_id").alias("n")))

    def ids(self) -> DataFrame:
        """(called, chunk_id): the ids of what :meth:`find` calls the chunks, of those that are there."""
        parts = []
        for k in range(len(self.segments)):
            rows, gone = self._ids(k), self._gone(k)
            rows = rows if gone is None else rows.join(gone, "chunk_id", "left_anti")
            parts.append(rows.select(F.struct(F.lit(k).alias("segment"), "n").alias("called"), "chunk_id"))
        return _union(parts, None) if parts else self.spark.createDataFrame([], f"called {_CALLED}, chunk_id string")

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows of :meth:`find`, or what was made of them, with their chunks' own ids."""
        return rows.withColumnRenamed("chunk_id", "called").join(self.ids(), "called").select(*rows.columns)

    def find(self, asked: DataFrame) -> DataFrame:
        """``asked``, which has ``term``, joined with the postings: chunk_id, tf, positions, length. Chunks are called by numbers
        until they are :meth:`named`."""
        dealt = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
        # Not broadcast, nor is the index shuffled: the asked terms go where their buckets are.
        found = [self._alive(_opened(dealt.hint("merge").join(self._blocks(s), ["term", "part"])).drop("part"), k) for k, s in enumerate(self.segments)]
        return _union(found) if found else asked.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("chunk_id", _CALLED), ("tf", "int"), ("positions", "array<int>"), ("length", "int"))]).limit(0)

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df): how many chunks hold each of ``terms`` (term), 0 left out."""
        found = [terms.select("term").hint("merge").join(self._terms(s), "term").select("term", "df") for s in self.segments]
        if not found:
            return terms.select("term", F.lit(0).cast("long").alias("df")).limit(0)
        return _union(found).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def with_stats(self, hits: DataFrame) -> DataFrame:
        """Adds ``n`` and ``mean``: how many chunks there are, and their mean length. The commit knows both."""
        return hits.withColumns({"n": F.lit(self.chunks), "mean": F.lit(float(self.mean))})

    def terms(self) -> DataFrame:
        """(term, df, cf) of the whole index."""
        if not self.segments:
            return self.spark.createDataFrame([], "term string, df long, cf long")
        return _union([self._terms(s) for s in self.segments]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def postings(self) -> DataFrame:
        """All that is alive."""
        rows = [self._alive(_opened(self._blocks(s)), k) for k, s in enumerate(self.segments)]
        return self.named(_union(rows)) if rows else self.spark.createDataFrame([], _POSTING)


class IndexWriter:
    """Adds and takes chunks. The segments are named in a store's commits, and each chunk's terms are in its
    table ``forward``, so that the index changes with the store's other tables or not at all."""

    def __init__(self, store: Store):
        store.tables.setdefault("forward", FORWARD)
        self.store, self.spark, self.root = store, store.spark, store.root

    def index(self, at: Commit | None = None) -> Index:
        return Index(self.spark, self.root, (at or self.store.commit()).notes.get("segments", []))

    def forward(self, chunks: DataFrame, text_col: str = "text") -> DataFrame:
        """(chunk_id, length, terms): what a chunk adds to the statistics. A row for each chunk with terms."""
        words = F.filter(words_of(text_col), lambda w: ~w.isin(*STOP))
        rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), words.alias("w"))
        return rows.filter(F.size("w") > 0).select("chunk_id", F.size("w").alias("length"), F.col("w").alias("terms"))

    def segment(self, number: int, was: Commit, chunks: DataFrame | None, gone: DataFrame | None, text_col: str = "text") -> list[dict]:
        """Writes segment ``number`` and returns the segments that hold with it. ``chunks`` come, ``gone`` (chunk_id) and
        former chunks of the same ids go. Called by the store's ``change``; ``chunks`` is read once for its ids and once
        for each part, whose texts alone are taken apart."""
        segments = list(was.notes.get("segments", []))
        here = {"number": number}
        path = lambda what: f"{self.root}/_index/seg={number}/{what}"
        ids = [x.select(F.col("chunk_id").cast("string").alias("chunk_id")) for x in (chunks, gone) if x is not None]
        ids = (ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])).distinct()
        old = self.store.read("forward", at=was)
        minus = (0, 0)
        if old is not None:
            old.join(ids, "chunk_id", "left_semi").select("chunk_id").write.mode("overwrite").parquet(path("gone"))
            lost = old.join(self.spark.read.schema("chunk_id string").parquet(path("gone")), "chunk_id", "left_semi")
            minus = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        here["gone"] = minus[0] > 0
        salt = self._number(ids if chunks is None else chunks.select(F.col("chunk_id").cast("string").alias("chunk_id")).distinct(), path("ids"))
        # One part after the other: disks hold the shuffle of one, and its blocks hold more chunks each.
        for k in range(SPLIT if chunks is not None else 1):
            made = _called(blocks_of(chunks, text_col, k) if chunks is not None else self.spark.createDataFrame([], _BLOCK), salt)
            _write(made, path("postings"), ("term", "part"), k > 0)
        here["postings"] = _json(made)
        mine = self.spark.read.schema(made.schema).parquet(path("postings"))
        # A block's last end is the number of its places.
        places = F.element_at("ends", -1).cast("long")
        counts = mine.groupBy("term").agg(F.sum(F.size("ends")).cast("long").alias("df"), F.sum(places).alias("cf"))
        if here["gone"]:
            each = lost.select("chunk_id", F.explode("terms").alias("term"))
            less = each.groupBy("term").agg((-F.countDistinct("chunk_id")).alias("df"), (-F.count(F.lit(1))).alias("cf"))
            counts = counts.unionByName(less).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        _write(counts, path("terms"), ("term",))
        here["terms"] = _json(counts)
        plus = mine.agg(F.coalesce(F.sum("leads"), F.lit(0)), F.coalesce(F.sum(places), F.lit(0))).first()
        here |= {"chunks": plus[0] - minus[0], "length": int(plus[1]) - int(minus[1])}
        return self._merged([*segments, here], number)

    def _number(self, ids: DataFrame, path: str) -> int:
        """Writes the numbers of a segment's chunks (chunk_id), each of one chunk; returns what they were made with."""
        for salt in itertools.count():
            ids.select("chunk_id", _chunk_number(F.col("chunk_id"), salt).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(path)
            have = self.spark.read.schema(_IDS).parquet(path).agg(F.count("n"), F.countDistinct("n")).first()
            if have[0] == have[1]:
                return salt

    def _merged(self, segments: list[dict], number: int) -> list[dict]:
        """One segment of all, where there are more than ``SEGMENTS``."""
        if len(segments) <= SEGMENTS:
            return segments
        whole = Index(self.spark, self.root, segments)
        name = f"{number}m"
        path = lambda what: f"{self.root}/_index/seg={name}/{what}"
        salt = self._number(whole.ids().select("chunk_id"), path("ids"))
        postings, terms = _called(_blocks_again(whole.postings()), salt), whole.terms()
        _write(postings, path("postings"), ("term", "part"))
        _write(terms, path("terms"), ("term",))
        return [{"number": name, "gone": False, "postings": _json(postings), "terms": _json(terms), "chunks": whole.chunks, "length": sum(s["length"] for s in segments)}]

    def expire(self) -> None:
        """Deletes segments that no kept commit names."""
        kept = [self.store.commit(n) for n in self.store.commits()]
        live = {f"seg={s['number']}" for c in kept for s in c.notes.get("segments", [])}
        for folder in self.store.files.names(f"{self.root}/_index"):
            if folder.startswith("seg=") and folder not in live and int(folder[4:].rstrip("m")) <= max(c.number for c in kept):
                for what in ("postings", "terms"):
                    self.spark.sql("drop table if exists lakedocs_" + hashlib.md5(f"{self.root}/_index/{folder}/{what}".encode()).hexdigest())
                self.store.files.delete(f"{self.root}/_index/{folder}")

    def change(self, chunks: DataFrame | None, gone: DataFrame | None = None, text_col: str = "text", stream: str | None = None, batch: int = -1) -> Index:
        """The index after ``chunks`` (chunk_id, text) have come and ``gone`` (chunk_id) have gone."""
        forward = None if chunks is None else self.forward(chunks, text_col)
        ids = [x.select(F.col("chunk_id").cast("string").alias("chunk_id")) for x in (chunks, gone) if x is not None]
        new = self.store.change({"forward": (forward, ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1]))}, stream, batch, lambda n, was: was.notes | {"segments": self.segment(n, was, chunks, gone, text_col)})
        self.expire()
        return self.index(new)


def _json(df: DataFrame) -> dict:
    return StructType([f.__class__(f.name, f.dataType) for f in df.schema]).jsonValue()


def build_index(chunks: DataFrame, root: str, text_col: str = "text") -> Index:
    """A new index of ``chunks`` (chunk_id, text) below ``root``: one segment, of the parts of ``chunks`` one after the other."""
    spark = chunks.sparkSession
    store = Store(spark, root, {})
    writer = IndexWriter(store)
    new = store.change({}, notes=lambda n, was: {"segments": writer.segment(n, was, chunks, None, text_col)})
    return writer.index(new)

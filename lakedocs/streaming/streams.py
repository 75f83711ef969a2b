"""Structured Streaming forms of the operators.

Event time columns must be timestamps with a zone (a Parquet column without one is cast first).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import blocks as B, chunks as C, graph as G, vectors as V
from ..operators.inverted_index import FORWARD, Index, IndexWriter
from ..plans.reports import STAGES
from ..sources.ingest import Policy, ingest
from ..sources.stage import dropped, staged
from ..sources.store import BUCKET, Commit, Store, Table

FILES = "path string, modificationTime timestamp, length long, content binary"
#: What a corpus is made of, all by document but for the index.
CORPUS = {
    "documents": Table(("doc_id",)), "blocks": Table(("doc_id",), order=("doc_id", "pos")), "chunks": Table(("doc_id",), order=("doc_id", "span_start")),
    "nodes": Table(("doc_id",), order=("doc_id", "pos")), "edges": Table(("doc_id",)), "vectors": Table(("doc_id",)), "forward": FORWARD,
}
DIM = 256


def corpus_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, dict(CORPUS))


def corpus_index(spark: SparkSession, root: str) -> Index:
    """The inverted index of the latest commit."""
    return IndexWriter(corpus_store(spark, root)).index()


def _touched(store: Store, name: str, ids: DataFrame, was: Commit) -> DataFrame | None:
    """Rows of a table of the documents ``ids`` (doc_id), from their buckets alone."""
    known = was.tables.get(name)
    if known is None:
        return None
    at = F.pmod(F.xxhash64("doc_id"), F.lit(known["buckets"])).cast("int")
    buckets = [r[0] for r in ids.select(at.alias(BUCKET)).distinct().collect()]  # a row for each bucket
    return store.read(name, buckets, was).join(ids, "doc_id", "left_semi")


def put_documents(store: Store, docs: DataFrame, stream: str | None = None, batch: int = -1, dim: int = DIM) -> Commit:
    """Documents (doc_id, text, ...) with all that is derived from them: blocks, chunks, graph, vectors and postings, by
    one commit. Documents of the same ids are replaced. Chunks whose text is as before keep their
    vectors, and those that are gone leave the index. A batch that was taken before changes nothing."""
    if stream is not None and store.taken(stream, batch):
        return store.commit()
    return _put_documents(store, staged(docs, "documents"), stream, batch, dim)


def _put_documents(store: Store, docs: DataFrame, stream: str | None, batch: int, dim: int) -> Commit:
    """The same of a staged table, which goes. What is read once is not staged but made where the store writes it, and what is
    staged goes as soon as nothing reads it."""
    was, writer = store.commit(), IndexWriter(store)
    blocks = staged(B.with_spans(B.artifacts_to_blocks(B.text_to_artifacts(docs, "line"))), "blocks")
    plain = staged(docs.drop("text"), "plain")
    dropped(docs)
    ids = plain.select("doc_id")
    chunks = staged(C.chunk_documents(blocks), "chunks")
    edges = G.contains_edges(blocks).unionByName(G.follows_edges(blocks))
    old = _touched(store, "vectors", ids, was)
    facts = chunks.select("doc_id", "chunk_id", "checksum", F.col("meta.types").alias("types"))
    held, gone = [], None
    made = V.hash_embed(chunks, "chunk_id", "text", dim).join(facts, "chunk_id").select(*facts.columns, "embedding")
    if old is not None:
        old = staged(old, "old-vectors")
        delta = V.index_delta(facts, old)
        fresh = chunks.join(delta.filter("action = 'upsert'"), "chunk_id", "left_semi")
        kept = old.join(facts.select("chunk_id"), "chunk_id", "left_semi").join(delta.filter("action = 'upsert'"), "chunk_id", "left_anti")
        made = V.hash_embed(fresh, "chunk_id", "text", dim).join(facts, "chunk_id").select(*facts.columns, "embedding").unionByName(kept.select(*made.columns))
        gone = staged(_touched(store, "chunks", ids, was).select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "gone")
        held = [old, gone]
    changes = {
        "documents": (plain, None), "blocks": (blocks, ids), "chunks": (chunks, ids), "nodes": (G.graph_nodes(blocks), ids), "edges": (edges, ids),
        "vectors": (made, ids), "forward": (writer.forward(chunks), gone),
    }

    def index(n: int, now: Commit) -> dict:
        """The last to be written; it reads chunks alone."""
        dropped(blocks, plain)
        return now.notes | {"segments": writer.segment(n, now, chunks, gone)}

    new = store.change(changes, stream, batch, index)
    writer.expire()
    dropped(chunks, *held)
    return new


def take_documents(store: Store, ids: DataFrame, tenant_id: str | None = None, wipe: bool = False) -> Commit:
    """Documents ``ids`` (doc_id) are marked DELETED, and what searches read of them goes by the same commit: chunks, vectors and
    postings. ``wipe``: blocks, graph and the documents' own rows go too. ``tenant_id``: only that tenant's."""
    was, writer = store.commit(), IndexWriter(store)
    docs = _touched(store, "documents", ids.select("doc_id").distinct(), was)
    if docs is None:
        return was
    docs = staged(docs if tenant_id is None else docs.filter(F.col("tenant_id") == tenant_id), "taken")
    gone = docs.select("doc_id")
    chunks = staged(_touched(store, "chunks", gone, was).select("chunk_id"), "gone")
    changes = {n: (None, gone) for n in ("chunks", "vectors", *(("blocks", "nodes", "edges", "documents") if wipe else ()))}
    changes["forward"] = (None, chunks)
    if not wipe:
        changes["documents"] = (docs.withColumn("state", F.lit("DELETED")), None)
    new = store.change(changes, notes=lambda n, now: now.notes | {"segments": writer.segment(n, now, None, chunks)})
    writer.expire()
    return new


def ingest_stream(spark: SparkSession, path: str, tables: str, checkpoint: str, tenant_id: str = "default", policy: Policy = Policy()) -> StreamingQuery:
    """New text files below ``path`` become documents, blocks, chunks, graph, vectors and postings of the store ``tables``.

    Each batch is one commit under its number: delivered twice, or lost between two tables and
    delivered again, it leaves the same tables.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.lit(tenant_id).alias("tenant_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("declared_mime"), "content")
    return ingest_rows_stream(rows, tables, checkpoint, policy)


def ingest_rows_stream(rows: DataFrame, tables: str, checkpoint: str, policy: Policy = Policy()) -> StreamingQuery:
    """The same of a stream (tenant_id, filename, declared_mime, content)."""

    def take(batch: DataFrame, n: int) -> None:
        store = corpus_store(batch.sparkSession, tables)
        if store.taken(checkpoint, n):
            return
        docs = ingest(batch, store.read("documents"), policy).filter("state = 'STORED' and not duplicate").withColumn("text", F.col("content").cast("string"))
        docs = staged(docs.select("doc_id", "tenant_id", "sha256", "uri", "mime", "size_bytes", "state", "filename", "text"), "new")
        if not docs.isEmpty():
            _put_documents(store, docs, checkpoint, n, DIM)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(df: DataFrame, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first document of each tenant and hash within the delay; older state is dropped."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["tenant_id", "sha256"])


#: ``hashes``: the first document of each tenant and hash, ever; ``duplicates``: those that came later.
SEEN = {"hashes": Table(("tenant_id", "sha256")), "duplicates": Table(("doc_id",))}


def put_hashes(store: Store, docs: DataFrame, stream: str | None = None, batch: int = -1) -> Commit:
    """Documents (doc_id, tenant_id, sha256) against all that the store knows: the first of a tenant and hash is kept
    there (of a batch the least id), later ones are duplicates of it. Only the buckets of the
    batch's hashes are read. A hash of many copies is reduced to its least id before it is joined back."""
    if stream is not None and store.taken(stream, batch):
        return store.commit()
    keys = ["tenant_id", "sha256"]
    docs = staged(docs.select("doc_id", *keys), "arrived")
    first = docs.groupBy(keys).agg(F.min("doc_id").alias("first_id"))
    was = store.commit()
    known = was.tables.get("hashes")
    if known is not None:
        at = F.pmod(F.xxhash64(*keys), F.lit(known["buckets"])).cast("int").alias(BUCKET)
        old = store.read("hashes", [r[0] for r in first.select(at).distinct().collect()], was)
        first = first.join(old.select(*keys, F.col("first_id").alias("_old")), keys, "left").select(*keys, F.coalesce("_old", "first_id").alias("first_id"))
    first = staged(first, "firsts")
    again = staged(docs.join(first, keys).filter("doc_id <> first_id").select("doc_id", F.col("first_id").alias("original_id")), "duplicates")
    return store.change({"hashes": (first, None), "duplicates": (again, None)}, stream, batch)


def dedupe_into(docs: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """A stream of documents against the store at ``root``: a hash stored days ago makes a duplicate."""

    def take(batch: DataFrame, n: int) -> None:
        put_hashes(Store(batch.sparkSession, root, dict(SEEN)), batch, checkpoint, n)

    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: ``counts``: rows of each window; ``late``: rows that came after their window was closed, by batch.
COUNTED = {"counts": Table(("start",), 16), "late": Table(("batch",), 16)}


def put_counts(store: Store, rows: DataFrame, size: str, slide: str, delay: str, ts: str = "ts", stream: str | None = None, batch: int = -1) -> Commit:
    """Adds a batch to the counts of windows of ``size``, one every ``slide``.

    A window is closed once an earlier batch had a row later than its end by ``delay``. What comes
    for it then is not lost: it is counted in ``late`` (batch, start, end, n). Counts and late rows
    add up to those of all rows. Rows without a time have no window. The mark up to which windows
    are closed is part of the commit."""
    if stream is not None and store.taken(stream, batch):
        return store.commit()
    was = store.commit()
    mark = was.notes.get("closed_until")
    window = F.window(ts, size, slide)
    seen = staged(rows.filter(F.col(ts).isNotNull()).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "newest"), "windows")
    newest = seen.agg(F.max(F.unix_micros(F.col("newest") - F.expr(f"interval {delay}"))).alias("mark")).first()["mark"]
    closed = F.lit(False) if mark is None else F.unix_micros("end") <= mark
    old = store.read("counts", at=was)
    fresh = seen.filter(~closed).select("start", "end", "n")
    if old is not None:
        fresh = fresh.join(old.select("start", F.col("n").alias("_n")), "start", "left").select("start", "end", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
    late = seen.filter(closed).select(F.lit(batch).cast("long").alias("batch"), "start", "end", "n")
    marks = [m for m in (mark, newest) if m is not None]
    return store.change({"counts": (staged(fresh, "counts"), None), "late": (staged(late, "late"), None)}, stream, batch, lambda _, now: now.notes | ({"closed_until": max(marks)} if marks else {}))


def counts_into(events: DataFrame, root: str, checkpoint: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour", ts: str = "ts") -> StreamingQuery:
    """A stream's windowed counts and late rows in the store at ``root``: hourly counts by default, sliding ones with ``slide``."""

    def take(batch: DataFrame, n: int) -> None:
        put_counts(Store(batch.sparkSession, root, dict(COUNTED)), batch, size, slide or size, delay, ts, checkpoint, n)

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_guard_stream(events: DataFrame, most: int = 120, delay: str = "2 minutes", client: str = "user_id") -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute"), F.col(client).alias("client")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("client", F.col("window.start").alias("window_start"), "n", (F.col("n") > most).alias("limited"))


def ingestion_history_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("window.start").alias("bucket"), "count")


def questions_24h_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Questions in each 24 hours, every hour."""
    asked = events.filter("stage = 'GENERATE'").withWatermark("ts", delay)
    counted = asked.groupBy(F.window("ts", "24 hours", "1 hour")).agg(F.count(F.lit(1)).alias("queries_24h"))
    return counted.select(F.col("window.end").alias("until"), "queries_24h")


class _Progress(StatefulProcessor):
    """A document's latest event, furthest stage and errors, until no event has come for ``keep_ms``."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "ts timestamp, event_id string, stage string, has_error boolean, step int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.state.get() if self.state.exists() else None
        ts, event_id, stage, error, step = tuple(was) if was else (None, None, None, False, 0)
        for r in rows:
            if ts is None or (r["ts"], r["event_id"]) > (ts, event_id):
                ts, event_id, stage = r["ts"], r["event_id"], r["stage"]
            error = error or r["status"] in ("ERROR", "FAIL")
            step = max(step, STAGES.index(r["stage"]) + 1 if r["stage"] in STAGES else 0)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(ts.timestamp() * 1000) + self.keep_ms)
        self.state.update((ts, event_id, stage, error, step))
        yield Row(doc_id=key[0], stage=stage, has_error=error, progress=step / 5)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, keep_hours: float = 24 * 7, delay: str = "1 hour") -> DataFrame:
    """(doc_id, stage, has_error, progress), for update mode. A document's state goes once the watermark is ``keep_hours``
    past its latest event; an event that comes later starts anew. Needs the RocksDB state store."""
    rows = events.filter("doc_id is not null and ts is not null").select("doc_id", "event_id", "stage", "status", "ts").withWatermark("ts", delay)
    return rows.groupBy("doc_id").transformWithState(_Progress(int(keep_hours * 3_600_000)), "doc_id string, stage string, has_error boolean, progress double", "Update", "EventTime")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def progress_into(events: DataFrame, root: str, checkpoint: str, keep_hours: float = 24 * 7, delay: str = "1 hour") -> StreamingQuery:
    """The latest progress of each document in the store at ``root``, table ``progress``: what goes from the state stays there."""
    spark = events.sparkSession
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)

    def take(batch: DataFrame, n: int) -> None:
        Store(batch.sparkSession, root, {"progress": Table(("doc_id",))}).change({"progress": (staged(batch, "progress"), None)}, checkpoint, n)

    return progress_stream(events, keep_hours, delay).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Questions as they come, hits and contexts appended at ``out``: ``answer`` is a batch plan such
    as search followed by pack_context. A batch's rows go to a folder of its own."""

    def take(batch: DataFrame, n: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return questions.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

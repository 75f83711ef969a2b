"""The structural graph of documents: nodes, contains and follows edges, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.keys import stable_id
from ..functions.text import strip
from ..sources.stage import staged
from . import neighbors as N
from .vectors import context_boost

LEVELS = range(1, 7)


def _node_id(doc, block):
    return stable_id(F.lit("node"), doc, block)


def graph_nodes(blocks: DataFrame) -> DataFrame:
    """A root for each document and a node for each block."""
    label = F.substring(strip(F.coalesce("text", F.lit(""))), 1, 160)
    label = F.when(label != "", label).otherwise(F.concat(F.initcap("type"), F.lit("@"), F.coalesce(F.col("page").cast("string"), F.lit("?"))))
    nodes = blocks.select(_node_id(F.col("doc_id"), F.col("block_id")).alias("node_id"), "doc_id", "type", label.alias("label"), F.col("block_id").alias("source_block_id"), "page", "pos")
    roots = blocks.select("doc_id").distinct().select(_node_id(F.col("doc_id"), F.lit("root")).alias("node_id"), "doc_id", F.lit("document").alias("type"), F.col("doc_id").alias("label"), F.lit(None).cast("string").alias("source_block_id"), F.lit(None).cast("int").alias("page"), F.lit(-1).alias("pos"))
    return roots.unionByName(nodes)


def contains_edges(blocks: DataFrame) -> DataFrame:
    """Parent to child: the nearest header above of a smaller level, else the root. A block that is
    no header has the nearest header whatever its level."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce("meta.level", F.lit(1))
    header = F.col("type") == "header"
    at = [F.max(F.when(header & (level == k), F.struct("pos", "block_id"))).over(before) for k in LEVELS]
    rows = blocks.select("doc_id", "pos", "block_id", "type", level.alias("level"), *[a.alias(f"h{k}") for k, a in zip(LEVELS, at, strict=True)])
    fits = F.array_compact(F.array(*[F.when((F.col("type") != "header") | (F.lit(k) < F.col("level")), F.col(f"h{k}")) for k in LEVELS]))
    parent = F.coalesce(F.array_max(fits)["block_id"], F.lit("root"))
    return _edges(rows.select("doc_id", _node_id(F.col("doc_id"), parent).alias("src_node_id"), _node_id(F.col("doc_id"), F.col("block_id")).alias("dst_node_id")), "contains")


def follows_edges(blocks: DataFrame) -> DataFrame:
    """Each block to the next."""
    last = F.lag("block_id").over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = blocks.select("doc_id", "block_id", last.alias("last")).filter("last is not null")
    return _edges(rows.select("doc_id", _node_id(F.col("doc_id"), F.col("last")).alias("src_node_id"), _node_id(F.col("doc_id"), F.col("block_id")).alias("dst_node_id")), "follows")


def _edges(rows: DataFrame, rel: str) -> DataFrame:
    return rows.select(stable_id(F.lit(rel), F.col("src_node_id"), F.col("dst_node_id")).alias("edge_id"), "doc_id", "src_node_id", "dst_node_id", F.lit(rel).alias("rel_type"))


def _packed(ident: Column) -> Column:
    """An id in half its bytes where it is a hash in hex, else as it is."""
    return F.when(ident.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"\x01"), F.unhex(ident))).otherwise(F.concat(F.lit(b"\x00"), F.encode(ident, "UTF-8")))


def _unpacked(key: Column) -> Column:
    rest = F.substring(key, 2, 2**31 - 1)
    return F.when(F.substring(key, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def graph_neighbors(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 32) -> DataFrame:
    """(seed_id, node_id, rel): children, parents (``incoming_``) and siblings (``shared_parent``) of the
    seed blocks, at most ``limit`` of each seed in order of relation and place.

    seeds: seed_id, block_id. The blocks of a seed, and what an edge ties, are of one document: nodes, edges and seeds are
    dealt out by it, once, and each document's neighbours are found where its rows are. A task holds some documents' rows, and
    half a million neighbours at once. Where ``doc_id`` is missing from seeds or edges, it is that of their node. Ids are packed on the way.
    """
    home = lambda: F.xxhash64(F.col("doc_id").cast("string")).alias("home")  # noqa: E731  Documents that share one do no harm.
    null = lambda t: F.lit(None).cast(t)
    place, ident = nodes.schema["pos"].dataType, seeds.schema["seed_id"].dataType
    if "doc_id" not in edges.columns:
        edges = edges.join(nodes.select(F.col("node_id").alias("dst_node_id"), "doc_id").distinct(), "dst_node_id")
    if "doc_id" not in seeds.columns:
        seeds = seeds.join(nodes.select(F.col("source_block_id").alias("block_id"), "doc_id").distinct(), "block_id")
    row = lambda k, a, b, rel, pos, seed: (home(), F.lit(k).cast("byte").alias("kind"), a.alias("a"), b.alias("b"), rel.alias("rel"), pos.alias("pos"), seed.alias("seed_id"))
    n = nodes.select(*row(N.NODE, _packed(F.col("node_id")), _packed(F.col("source_block_id")), null("string"), F.col("pos"), null(ident)))
    e = edges.select(*row(N.EDGE, _packed(F.col("src_node_id")), _packed(F.col("dst_node_id")), F.col("rel_type"), null(place), null(ident)))
    s = seeds.select(*row(N.SEED, _packed(F.col("block_id")), null("binary"), null("string"), null(place), F.col("seed_id")))
    rows = n.unionByName(e).unionByName(s).repartition("home").sortWithinPartitions("home")
    kind = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("seed_id", ident), T.StructField("rel", T.StringType()), T.StructField("pos", place), T.StructField("block", T.BinaryType()), T.StructField("rank", T.IntegerType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in N.documents(batches):
            for made in N.neighbors(some, limit):
                yield pa.RecordBatch.from_arrays(made, names=kind.names)

    return rows.mapInArrow(find, kind).select(_unpacked(F.col("key")).alias("node_id"), "seed_id", "rel", "pos", _unpacked(F.col("block")).alias("source_block_id"), "rank")


def block_chunk_map(chunks: DataFrame) -> DataFrame:
    """(block_id, chunk_id, doc_id)"""
    return chunks.select(F.explode("meta.source_block_ids").alias("block_id"), "chunk_id", "doc_id").distinct()


def expand_hits(hits: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, limit: int = 10, questions: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score_graph, from_rank): chunks next to the first hits that no hit has yet,
    at 0.6 of the hit's score; the first hit that finds one counts. With ``questions`` (query_id, q) the
    found chunk's own headers and types raise its score as they raise a hit's.

    hits: query_id, rank, chunk_id, score_vec.
    """
    doc = ["doc_id"] if "doc_id" in chunks.columns else []
    where = chunks.select("chunk_id", *doc, F.explode("meta.source_block_ids").alias("block_id"))  # what is there twice counts once below
    first = hits.filter(F.col("rank") <= limit)
    seeds = first.join(where, "chunk_id").select(F.concat_ws("#", F.col("query_id").cast("string"), F.col("chunk_id")).alias("seed_id"), "query_id", F.col("chunk_id").alias("from_chunk"), F.col("rank").alias("from_rank"), "score_vec", "block_id", *doc)
    seeds = staged(seeds, "seeds")
    near = graph_neighbors(seeds.select("seed_id", "block_id", *doc), nodes, edges).select("seed_id", F.col("source_block_id").alias("block_id"), F.col("rank").alias("near_rank"))
    found = near.join(seeds.drop("block_id", *doc).distinct(), "seed_id").join(where.drop(*doc), "block_id")
    fresh = found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    best = fresh.groupBy("query_id", "chunk_id").agg(F.min(F.struct("from_rank", "near_rank", "score_vec")).alias("m"))
    score = F.lit(0.6) * F.col("m.score_vec")
    if questions is not None:
        facts = chunks.select("chunk_id", F.col("meta.context_headers").alias("headers"), F.col("meta.types").alias("types"))
        best = best.join(facts, "chunk_id").join(questions.select("query_id", "q"), "query_id")
        score = F.round(score + context_boost(F.col("headers"), F.col("types"), F.col("q")), 6)
    return best.select("query_id", "chunk_id", score.alias("score_graph"), F.col("m.from_rank").alias("from_rank"))

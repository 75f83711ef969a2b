"""Search end to end, over a table of questions.

corpus: chunks (chunk_id, doc_id, text, meta, page_*, span_*), documents, index (vectors),
optionally postings, nodes, edges, invoices, and sets (doc_id, sets) of documents by name.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import enrich_query, is_numeric_question
from ..operators import filters, fusion, graph, keyword, keyword_scan, vectors
from ..operators.inverted_index import Index
from ..sources.stage import staged


@dataclass
class Corpus:
    chunks: DataFrame
    documents: DataFrame
    index: DataFrame
    postings: DataFrame | Index | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    invoices: DataFrame | None = None
    sets: DataFrame | None = None


def searchable(corpus: Corpus, tenant_id: str | None = None) -> DataFrame:
    """Chunks of live documents with what searches restrict by: types, mime, uri, filename, and vendor where the document
    is an invoice. ``tenant_id``: those of one tenant."""
    docs = corpus.documents.filter("state <> 'DELETED'")
    if tenant_id is not None:
        docs = docs.filter(F.col("tenant_id") == tenant_id)
    name = F.col("filename") if "filename" in docs.columns else F.element_at(F.split("uri", "/"), -1)
    docs = docs.select("doc_id", "tenant_id", "mime", "uri", "state", "collected_at", name.alias("filename"))
    if corpus.invoices is not None:
        vendors = corpus.invoices.groupBy(F.col("invoice_id").cast("string").alias("doc_id")).agg(F.min("vendor").alias("vendor"))
        docs = docs.join(vendors, "doc_id", "left")
    else:
        docs = docs.withColumn("vendor", F.lit(None).cast("string"))
    docs = docs.withColumn("sets", F.lit(None).cast("array<string>")) if corpus.sets is None else docs.join(corpus.sets, "doc_id", "left")
    return corpus.chunks.join(docs, "doc_id").withColumn("types", F.col("meta.types"))


def _facts(live: DataFrame) -> DataFrame:
    return live.select("chunk_id", "doc_id", "types", "mime", "uri", "filename", "vendor", "sets")


def keyword_leg(queries: DataFrame, corpus: Corpus, k: int, tenant_id: str | None = None, live: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): any of an enriched question's terms, among the live chunks that it may see. All
    restrictions hold before the first k are taken, so nothing below that cut is lost. A corpus without postings is read for it."""
    live = _facts(searchable(corpus, tenant_id)) if live is None else live
    asked = queries.withColumn("q", enrich_query(F.col("q")))
    if corpus.postings is None:
        return keyword_scan.keyword_scan(asked, corpus.chunks, live, k)
    return keyword.keyword_topk(asked, corpus.postings, k, mode="any", passing=lambda found: filters.passing(found, queries, live))


def search_vector(queries: DataFrame, corpus: Corpus, k: int, now: Column, tenant_id: str | None = None) -> DataFrame:
    """Nearest chunks with boosts for headers, tables and recency, widened along the graph. A question's documents and mimes
    hold before the nearest are taken; hits of other types than it asks for drop out afterwards.

    queries: query_id, q, embedding, doc_ids, types, mime_any.
    """
    depth = max(k, 60)
    queries = filters.with_restrictions(queries)
    live = searchable(corpus, tenant_id)
    n, sets = (F.coalesce(F.size(c), F.lit(0)) for c in ("doc_ids", "sets"))
    free, bound = queries.filter((n <= 0) & (sets <= 0)), queries.filter(n > 0)
    index = corpus.index.select("chunk_id", "embedding").join(live.select("chunk_id", "mime", "sets"), "chunk_id")
    near = vectors.vector_topk(free, index, depth, only=("mime_any", "mime"))
    if corpus.sets is not None:
        # A set may hold any share of the corpus: its questions go to the rows, as those that see all do.
        own = vectors.vector_topk(queries.filter((n <= 0) & (sets > 0)), index.filter(F.size("sets") > 0), depth, only=[("sets", "sets"), ("mime_any", "mime")])
        near = near.unionByName(own)
    # The documents that a question itself gives are found by id.
    own = bound.select("query_id", F.explode(F.array_distinct("doc_ids")).alias("doc_id")).join(live.select("doc_id", "chunk_id", "mime"), "doc_id")
    ask = bound.select("query_id", F.col("embedding").alias("e"), "mime_any")
    own = own.join(corpus.index.select("chunk_id", "embedding"), "chunk_id").join(ask, "query_id").filter((F.coalesce(F.size("mime_any"), F.lit(0)) <= 0) | F.array_contains("mime_any", F.col("mime")))
    own = vectors.ranked(own.select("query_id", "chunk_id", vectors.cosine(F.col("e"), F.col("embedding")).alias("score")), depth)
    hits = staged(near.unionByName(own), "nearest").withColumnRenamed("score", "score_vec")
    asked = queries.select("query_id", "q", F.col("types").alias("want"))
    full = hits.join(live.select("chunk_id", "collected_at", "types", F.col("meta.context_headers").alias("headers")), "chunk_id").join(asked, "query_id")
    full = full.filter((F.coalesce(F.size("want"), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap("types", "want"), F.lit(False)))
    score = F.col("score_vec") + vectors.recency_boost(F.col("collected_at"), now) + vectors.context_boost(F.col("headers"), F.col("types"), F.col("q"))
    scored = staged(full.select("query_id", "chunk_id", "score_vec", "rank", score.alias("score")), "scored")
    if corpus.nodes is not None and corpus.edges is not None:
        first = scored.filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score_vec")
        # Edges don't leave a document: only those of the first hits' documents are made and moved.
        docs = staged(first.join(live.select("chunk_id", "doc_id"), "chunk_id").select("doc_id").distinct(), "hit-docs")
        nodes, edges, chunks = (t.join(docs, "doc_id", "left_semi") for t in (corpus.nodes, corpus.edges, corpus.chunks))
        more = graph.expand_hits(first, nodes, edges, chunks, questions=queries)
        more = more.join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        scored = scored.select("query_id", "chunk_id", "score").unionByName(more.select("query_id", "chunk_id", F.col("score_graph").alias("score")))
    return vectors.ranked(scored.select("query_id", "chunk_id", "score"))


def search(queries: DataFrame, corpus: Corpus, today: Column, now: Column, k: int = 8, hybrid: bool = True, alpha: float = 0.7, tenant_id: str | None = None, mode: str = "rrf", scorer: Column | None = None) -> DataFrame:
    """Restrict, search both legs, fuse, re-rank, boost, diversify, cap, net, widen: at most k hits a question.

    queries: query_id, q, embedding, doc_ids, types, date_last_days, and any of
    ``filters.RESTRICTIONS``. ``mode``: rrf, or norm for scores scaled within each leg. ``scorer``: a
    new score of each candidate from its columns, such as a pandas UDF of ``q`` and ``text``. What
    several steps read is written once.
    """
    asked = filters.with_restrictions(queries)
    if corpus.invoices is not None:
        asked, members = filters.restrict_to_invoices(asked, corpus.invoices, today)
        sets = members.join(corpus.documents.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("set").alias("sets"))
        corpus = replace(corpus, sets=staged(sets, "sets"))
    asked = staged(asked, "asked")
    # Texts' lengths go along, texts stay.
    sized = replace(corpus, chunks=corpus.chunks.withColumn("n_text", F.length("text")))
    live = staged(searchable(sized, tenant_id).select("chunk_id", "doc_id", "n_text", "types", "mime", "uri", "filename", "vendor", "sets", "page_start", "page_end", "span_start", "span_end", F.col("meta.source_block_ids").alias("source_block_ids")), "live")
    facts, texts = live.drop("mime", "filename", "vendor"), corpus.chunks.select("chunk_id", "text")
    fused = staged(search_vector(asked, corpus, max(k, 32), now, tenant_id), "vector-leg")
    if hybrid:
        kw = staged(keyword_leg(asked, corpus, max(k, 100), live=_facts(live)), "keyword-leg")
        fused = (fusion.fuse_minmax if mode == "norm" else fusion.fuse_rrf)(fused, kw, alpha)
        fused = fusion.top_n(fused, max(50, 4 * k))
    full = fusion.fetched(filters.restrict_docs(fused.join(facts.drop("n_text", "sets"), "chunk_id"), asked), texts)
    if hybrid:
        # A second score, and what the question would rather see, before the diverse ones are picked.
        if scorer is not None:
            full = fusion.rerank(full.join(asked.select("query_id", "q"), "query_id"), scorer).drop("q")
        full = full.join(asked.select("query_id", F.col("boost_types").alias("_wanted")), "query_id")
        full = fusion.boost_types(full, F.col("_wanted")).drop("_wanted")
    full = staged(fusion.ranked(full.drop("rank")), "fused")
    if hybrid:
        picked = fusion.mmr(full, k).drop("score")
        full = picked.join(full.drop("rank"), ["query_id", "chunk_id"])
    hits = staged(fusion.cap_hits(full, 3, k), "hits")
    net = fusion.safety_net(asked, hits, facts, k)
    net = fusion.fetched(net.select("query_id", "chunk_id", "score", "rank").join(facts.drop("n_text", "sets"), "chunk_id"), texts)
    every = hits.select(*net.columns).unionByName(net)
    return fusion.expand_window(every, corpus.chunks)


def numeric(queries: DataFrame) -> DataFrame:
    """Questions that ask for a figure."""
    return queries.filter(is_numeric_question(F.col("q")))

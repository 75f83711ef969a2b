"""Registered queries: blocks, chunks, graph, vectors, keywords, fusion, contexts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import keys, text as T
from ..functions.stem import with_stems
from ..operators import blocks as B, chunks as C, context as A, facts, filters, fusion as H, graph as G, inverted_index as I, keyword as K, language as L, vectors as V
from ..sources import tables
from ..sources.stage import stage_path, staged
from ..sources.store import Files
from . import data as D, search as S

QUERIES: dict = {}
ORACLE: dict = {}
ts = lambda s: F.lit(s).cast("timestamp")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- blocks -----------------------------------------------------------------------------------


@query("B1_html_to_artifacts", r"select page_id::varchar as doc_id, len(regexp_extract_all(html, '<h[1-6][ >]'))::bigint as headers, len(regexp_extract_all(html, '<pre[ >]'))::bigint as codes from pages")
def _(spark, d):
    a = B.html_to_artifacts(D.read(spark, d, "pages"))
    got = a.groupBy("doc_id").agg(F.count_if(F.col("type") == "header").alias("headers"), F.count_if(F.col("type") == "code").alias("codes"))
    return D.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id")).join(got, "doc_id", "left").fillna(0)


@query("B2_text_to_artifacts", f"with {D.SQL_BLOCKS} select doc_id, pos, text from bl")
def _(spark, d):
    return B.text_to_artifacts(D.read(spark, d, "documents"), "line").select("doc_id", "pos", "text")


@query("B3_header_chain")
def _(spark, d):
    return D.page_artifacts(spark, d).select("doc_id", "pos", "type", F.array_join("headers", " / ").alias("headers"))


@query("B4_artifact_stats", f"with {D.SQL_BLOCKS} select doc_id, count(*)::bigint as artifact_total, sum(length(text))::bigint as text_chars, count(*)::bigint as paragraphs from bl group by doc_id")
def _(spark, d):
    return B.artifact_stats(B.text_to_artifacts(D.read(spark, d, "documents"), "line")).select("doc_id", "artifact_total", "text_chars", "paragraphs")


@query("B5_normalization_warnings", f"with {D.SQL_BLOCKS} select doc_id, case when sum(length(text)) < 200 then 'low_text_coverage' else '' end as warnings from bl group by doc_id")
def _(spark, d):
    return B.normalization_warnings(B.artifact_stats(B.text_to_artifacts(D.read(spark, d, "documents"), "line"))).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


@query("B6_choose_parse", "select doc_id::varchar as doc_id, case when n_chars < 500 then 'second' else 'first' end as tool from documents")
def _(spark, d):
    docs = D.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.array(F.lit("first"), F.lit("second"))).alias("tool"), "n_chars")
    second = F.col("tool") == "second"
    return B.choose_parse(docs.select("doc_id", "tool", F.when(second, 2).otherwise(1).alias("tables"), F.when(second, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("text_chars")))


@query("B7_strip_repeated_edges", f"with {D.SQL_BLOCKS}, p as (select *, pos % 3 as page from bl), e as (select doc_id, page, min_by(text, pos) as a, max_by(text, pos) as b from p group by all), s as (select doc_id, text, count(*) as n from (select doc_id, page, a as text from e union select doc_id, page, b from e) group by all), r as (select *, row_number() over (partition by doc_id order by n desc, text) as k from s), x as (select doc_id, text from r where k <= 2 and n >= 2) select p.doc_id, count(*)::bigint as kept from p left join x on x.doc_id = p.doc_id and x.text = p.text where x.text is null group by p.doc_id")
def _(spark, d):
    rows = D.line_blocks(spark, d).withColumn("page", F.col("pos") % 3)
    return B.strip_repeated_edges(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("B8_artifacts_to_blocks", f"with {D.SQL_BLOCKS} select doc_id, pos, type, text from bl")
def _(spark, d):
    return D.line_blocks(spark, d).select("doc_id", "pos", "type", "text")


@query("B9_with_spans", f"with {D.SQL_BLOCKS} select doc_id, pos, (coalesce(sum(length(text) + 2) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0))::int as span_start, (coalesce(sum(length(text) + 2) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) + length(text))::int as span_end from bl")
def _(spark, d):
    return D.line_blocks(spark, d).select("doc_id", "pos", "span_start", "span_end")


@query("B10_looks_like_table", "with l as (select doc_id, unnest(string_split(text, chr(10))) as x from documents), p as (select doc_id, count(*) filter (length(x) - length(replace(x, '|', '')) >= 2) as bars, count(*) filter (contains(x, '  ')) as wide from l where trim(x) <> '' group by doc_id) select doc_id, bars >= 2 or wide >= 2 as is_table from p")
def _(spark, d):
    return D.read(spark, d, "documents").filter(F.trim("text") != "").select("doc_id", T.looks_like_table(F.col("text"))["is_table"].alias("is_table"))


@query("B12_check_blocks", f"with {D.SQL_BLOCKS} select distinct doc_id, 'OK' as status from bl")
def _(spark, d):
    return B.check_blocks(D.line_blocks(spark, d), B.text_to_artifacts(D.read(spark, d, "documents"), "line")).select("doc_id", "status")


_VOTE = ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(chr(39) + s + chr(39) for s in words)}))) as n_{lang}" for lang, words in sorted(B.STOP_WORDS.items()))


@query("B13_with_language", rf"with w as (select doc_id, lang, regexp_split_to_array(lower(text), '[^\p{{L}}]+') as w from documents), v as (select doc_id, lang, {_VOTE} from w), g as (select lang, case when greatest(n_de, n_en, n_es, n_fr) = 0 then null when n_de = greatest(n_de, n_en, n_es, n_fr) then 'de' when n_en = greatest(n_en, n_es, n_fr) then 'en' when n_es >= n_fr then 'es' else 'fr' end as language from v) select lang, language, count(*)::bigint as n from g group by all")
def _(spark, d):
    return B.with_language(D.read(spark, d, "documents")).groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


@query("B13_language_profiles")
def _(spark, d):
    """Profiles of 100 documents a language; all documents told by them, and how many rightly, those of the sample apart."""
    docs = D.read(spark, d, "documents")
    sample = staged(L.labelled_sample(docs, per_language=100), "sample")
    told = L.with_language_by_profile(docs.select("doc_id", "lang", "text"), L.fit_profiles(sample)).drop("text")
    told = told.join(sample.select("doc_id", F.lit(True).alias("s")), "doc_id", "left").withColumn("held_out", F.col("s").isNull())
    return told.groupBy("lang", "held_out").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("language") == F.col("lang")).alias("n_right"), F.round(F.avg((F.col("language") == F.col("lang")).cast("double")), 4).alias("accuracy"))


@query("B14_citation_url", "select page_id, '/ui/open/' || page_id || case when page_id % 2 = 0 then '#p-' || (page_id % 7) else '' end as url from pages")
def _(spark, d):
    p = F.col("page_id")
    return D.read(spark, d, "pages").select(p, keys.citation_url(p, F.when(p % 2 == 0, p % 7)).alias("url"))


# --- chunks -----------------------------------------------------------------------------------


@query("C1_est_tokens", "select doc_id, ceil(length(coalesce(text, '')) / 4.0)::int as tokens from documents")
def _(spark, d):
    return D.read(spark, d, "documents").select("doc_id", T.est_tokens(F.col("text")).alias("tokens"))


@query("C2_norm_text", "with l as (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) as x, unnest(range(len(string_split(text, chr(10))))) as k from documents) select doc_id, md5(string_agg(x, chr(10) order by k)) as h from l where x <> '' group by doc_id")
def _(spark, d):
    return D.read(spark, d, "documents").filter(F.trim("text") != "").select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("h"))


@query("C3_plan_chunks", f"with {D.SQL_BLOCKS} select doc_id, case when sum(length(text)) < 600 then 'tiny' else 'section' end as strategy, sum(length(text))::bigint as total_chars, count(*)::bigint as block_count from bl group by doc_id")
def _(spark, d):
    return C.plan_chunks(D.line_blocks(spark, d)).select("doc_id", "strategy", "total_chars", "block_count")


@query("C4_chunk_tiny", f"with {D.SQL_BLOCKS} select doc_id, md5(string_agg(trim(text), chr(10) order by pos)) as h from bl group by doc_id having sum(length(text)) < 600")
def _(spark, d):
    b = D.line_blocks(spark, d)
    return C.chunk_tiny(b, C.plan_chunks(b)).select("doc_id", F.md5("text").alias("h"))


@query("C6_narrative_segments", f"with {D.SQL_BLOCKS}, big as (select doc_id from bl group by doc_id having sum(length(text)) >= 600) select doc_id, pos, ceil(length(trim(text)) / 4.0)::int as tokens from bl join big using (doc_id)")
def _(spark, d):
    b = D.line_blocks(spark, d)
    return C.narrative_segments(b, C.plan_chunks(b)).select("doc_id", "pos", "tokens")


@query("C7_chunk_targets", f"with {D.SQL_BLOCKS} select doc_id, 800::int as target from bl group by doc_id")
def _(spark, d):
    return C.chunk_targets(D.line_blocks(spark, d))


@query("C8_chunk_documents")
def _(spark, d):
    return C.chunk_documents(D.line_blocks(spark, d)).select("chunk_id", "doc_id", "ordinal", "span_start", "span_end", "meta.tokens", "checksum")


@query("C8_chunk_pages")
def _(spark, d):
    return C.chunk_documents(D.page_blocks(spark, d)).select("chunk_id", "doc_id", "ordinal", "text")


@query("C11_cap_per_doc", f"with {D.SQL_BLOCKS} select doc_id, least(5, count(*))::bigint as n from bl group by doc_id")
def _(spark, d):
    return C.cap_per_doc(D.line_blocks(spark, d), 5, ("span_start",)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("C12_checksum", f"with {D.SQL_BLOCKS} select doc_id, pos, sha256(text) as checksum from bl")
def _(spark, d):
    b = D.line_blocks(spark, d).withColumns({"ordinal": F.col("pos"), "meta": F.struct(F.lit("section").alias("strategy"))})
    return C.with_chunk_ids(b).select("doc_id", "pos", "checksum")


@query("C13_check_chunks")
def _(spark, d):
    b = D.line_blocks(spark, d)
    return C.check_chunks(C.chunk_documents(b), b).select("doc_id", "status", F.array_join("warnings", ",").alias("warnings"))


# --- graph ------------------------------------------------------------------------------------


@query("G1_graph_nodes", f"with {D.SQL_BLOCKS} select doc_id, 'paragraph' as type, substr(trim(text), 1, 160) as label from bl union all select distinct doc_id, 'document', doc_id from bl")
def _(spark, d):
    return G.graph_nodes(D.line_blocks(spark, d)).select("doc_id", "type", "label")


@query("G2_contains_edges")
def _(spark, d):
    return G.contains_edges(D.page_blocks(spark, d)).select("doc_id", "src_node_id", "dst_node_id")


@query("G3_follows_edges", f"with {D.SQL_BLOCKS} select doc_id, (count(*) - 1)::bigint as n from bl group by doc_id having count(*) > 1")
def _(spark, d):
    return G.follows_edges(D.line_blocks(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("G4_graph_neighbors", f"""with {D.SQL_BLOCKS}, b as (select doc_id || '#' || pos as seed_id, row_number() over (partition by doc_id order by pos) as k, count(*) over (partition by doc_id) as n from bl), f as (select *, (k < n)::int as next, (k > 1)::int as last from b)
 select seed_id, 'follows' as rel, 1::bigint as n from f where next = 1 union all select seed_id, 'incoming_contains', 1 from f union all select seed_id, 'incoming_follows', 1 from f where last = 1 union all select seed_id, 'shared_parent', least(n - 1, 31 - next - last)::bigint from f where n > 1""")
def _(spark, d):
    """The neighbours of every block, by relation."""
    b = staged(D.line_blocks(spark, d).drop("span_start", "span_end", "text"), "blocks").withColumn("text", F.lit(None).cast("string"))  # a label's, which isn't asked for
    nodes, edges = G.graph_nodes(b), G.contains_edges(b).unionByName(G.follows_edges(b))
    seeds = b.select("doc_id", F.concat("doc_id", F.lit("#"), "pos").alias("seed_id"), "block_id")
    return G.graph_neighbors(seeds, nodes, edges).groupBy("seed_id", "rel").agg(F.count(F.lit(1)).alias("n"))


# --- vectors ----------------------------------------------------------------------------------

_COS = "list_cosine_similarity(q.embedding::double[], i.embedding::double[])"


def _index(spark, d):
    e = D.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"), "embedding", F.sha2(F.col("label").cast("string"), 256).alias("checksum"))


def _asked(spark, d):
    return D.read(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("V1_hash_embed")
def _(spark, d):
    e = V.hash_embed(D.read(spark, d, "documents"), "doc_id", "text", 64)
    return e.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("V2_index_delta", "select vec_id as chunk_id, case when vec_id % 4 = 0 then 'delete' else 'upsert' end as action from embeddings where vec_id % 4 in (0, 1) union all select vec_id, 'upsert' from embeddings where vec_id % 4 = 2")
def _(spark, d):
    i, c = _index(spark, d), F.col("chunk_id") % 4
    return V.index_delta(i.filter(c != 0).withColumn("checksum", F.when(c == 2, "new").otherwise(F.col("checksum"))), i.filter(c != 1))


@query("V3_check_dim", "select vec_id as chunk_id from embeddings where vec_id % 3 <> 0")
def _(spark, d):
    return V.check_dim(_index(spark, d).withColumn("embedding", F.when(F.col("chunk_id") % 3 == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding"))), 64).select("chunk_id")


@query("V4_apply_delta", "select vec_id as chunk_id, case when vec_id % 4 = 1 then 'new' else '' end as doc_id from embeddings where vec_id % 4 <> 0")
def _(spark, d):
    i = _index(spark, d).withColumn("doc_id", F.lit("")).drop("embedding")
    delta = i.filter("chunk_id % 4 in (0, 1)").select("chunk_id", F.when(F.col("chunk_id") % 4 == 0, "delete").otherwise("upsert").alias("action"))
    return V.apply_delta(i, i.withColumn("doc_id", F.lit("new")), delta).select("chunk_id", "doc_id")


@query("V5_vector_topk", f"with s as (select q.vec_id as query_id, i.vec_id as chunk_id, {_COS} as c from embeddings q, embeddings i where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by c desc, chunk_id) as rank from s) select query_id, chunk_id, round(c, 6) as score, rank::int as rank from r where rank <= 10")
def _(spark, d):
    return V.vector_topk(_asked(spark, d), _index(spark, d), 10).withColumn("score", F.round("score", 6))


@query("V6_vector_topk_lsh")
def _(spark, d):
    return V.vector_topk_lsh(_asked(spark, d), _index(spark, d), 10, 24, 6).withColumn("score", F.round("score", 6))


@query("V7_backfill", f"with {D.SQL_DOCS}, {D.SQL_BLOCKS} select doc_id || '#' || pos as chunk_id, bl.text, uri, mime from bl join docs using (doc_id) where state <> 'DELETED'")
def _(spark, d):
    c = D.line_blocks(spark, d).select(F.concat("doc_id", F.lit("#"), "pos").alias("chunk_id"), "doc_id", "text", "meta", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "span_start", "span_end", "pos")
    return V.backfill(c.select("chunk_id"), c, D.documents(spark, d)).select("chunk_id", "text", "uri", "mime")


@query("V8_recency_boost", f"with {D.SQL_EVENTS} select event_id, case when date_diff('second', ts, timestamp '{D.NOW}') < 86400 then 0.05 when date_diff('second', ts, timestamp '{D.NOW}') < 604800 then 0.02 else 0 end::double as boost from ev")
def _(spark, d):
    return D.events(spark, d).select("event_id", V.recency_boost(F.col("ts"), ts(D.NOW)).cast("double").alias("boost"))


@query("V9_context_boost", r"select conv_id, turn, round(0.05 * len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')), ['the', 'total', 'of', role])) + case when regexp_matches(coalesce(text, ''), '(?i)\b(total|amount|due|sum|balance|qty|quantity|price|fee|fees|tax|subtotal|grand\s*total)\b') then 0.03 else 0 end, 4)::double as boost from conversations")
def _(spark, d):
    c = D.read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.round(V.context_boost(F.array(F.lit("The Total"), F.lit("of"), F.col("role")), F.array(F.lit("table")), F.col("text")), 4).cast("double").alias("boost"))


# --- keywords ---------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in K.STOP)
_TERMS = rf"""w as (select doc_id::varchar as chunk_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from documents), tk as (select chunk_id, unnest(w) as term, unnest(range(len(w)))::int as pos from w), terms as (select * from tk where term not in ({_STOP}))"""
_POSTINGS = f"{_TERMS}, len_ as (select chunk_id, count(*) as length from terms group by 1), post as (select term, chunk_id, count(*) as tf, length from terms join len_ using (chunk_id) group by all)"
_ASKED_T = f"{D.SQL_QUESTIONS}, asked as (select distinct query_id, term from (select query_id, unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}]+')) as term from qs) where term not in ({_STOP}) and term <> 'or')"
_BM25 = f"""{_POSTINGS}, {_ASKED_T}, st as (select count(*) as n, avg(length) as mean from len_), df as (select term, count(*) as df from post group by 1),
 s as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) as score, count(*) as got from asked join post using (term) join df using (term), st group by all)"""


def _terms(spark, d):
    return K.analyze(D.documents(spark, d), "doc_id").withColumnRenamed("doc_id", "chunk_id")


#: Indexes of this process's applications: (application, the documents' files with their sizes and times) -> index.
_BUILT: dict = {}


def _postings(spark, d, anew=False):
    """The documents' index on disk: each document is a chunk. It is written once for the files as they are."""
    key = (spark.sparkContext.applicationId, d, Files(spark, d).states(f"{d}/documents.parquet"))
    if anew or key not in _BUILT:
        _BUILT[key] = I.build_index(D.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"), stage_path(spark, "index"))
    return _BUILT[key]


@query("K1_analyze", f"with {_TERMS} select chunk_id, count(*)::bigint as n, count(distinct term)::bigint as terms, max(pos) as last from terms group by chunk_id")
def _(spark, d):
    return _terms(spark, d).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"), F.max("pos").alias("last"))


@query("K1_stems")
def _(spark, d):
    """Stems of all words of the documents' texts, with their words and documents."""
    docs = D.documents(spark, d)
    terms = K.analyze(docs, "doc_id").select("doc_id", "term").distinct()
    named = terms.join(with_stems(terms), "term")
    return named.groupBy("stem").agg(F.countDistinct("term").alias("words"), F.min("term").alias("first_word"), F.countDistinct("doc_id").alias("docs"))


@query("K2_build_postings", f"with {_POSTINGS} select term, count(*)::bigint as df, sum(tf)::bigint as cf from post group by term")
def _(spark, d):
    """Builds the index anew, whatever there is."""
    return _postings(spark, d, True).terms()


@query("K3_websearch_terms", f"with {_ASKED_T} select query_id, term from asked")
def _(spark, d):
    return K.websearch_terms(D.questions(spark, d)).select("query_id", F.explode("terms").alias("term")).distinct()


@query("K4_enrich_query", "select conv_id, turn, trim(coalesce(text, '')) || ' invoice line items total amount due date' as q from conversations where not regexp_matches(lower(coalesce(text, '')), 'expense|fees|receipt|contract|clause|term|obligation')")
def _(spark, d):
    c = D.read(spark, d, "conversations").filter(~F.lower(F.coalesce("text", F.lit(""))).rlike("expense|fees|receipt|contract|clause|term|obligation"))
    return c.select("conv_id", "turn", T.enrich_query(F.concat(F.trim(F.coalesce("text", F.lit(""))), F.lit(" invoice"))).alias("q"))


@query("K5_keyword_topk", f"with {_BM25}, r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) select query_id, chunk_id, round(score, 6) as score, rank::int as rank from r where rank <= 10")
def _(spark, d):
    return K.keyword_topk(D.questions(spark, d), _postings(spark, d), 10, mode="any").withColumn("score", F.round("score", 6))


@query("K5_keyword_topk_all", f"with {_BM25}, need as (select query_id, count(*) as want from asked group by 1), r as (select s.*, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s join need using (query_id) where got = want) select query_id, chunk_id, round(score, 6) as score, rank::int as rank from r where rank <= 10")
def _(spark, d):
    return K.keyword_topk(D.questions(spark, d), _postings(spark, d), 10).withColumn("score", F.round("score", 6))


@query("K6_cover_density")
def _(spark, d):
    return K.keyword_topk(D.questions(spark, d), _postings(spark, d), 10, scorer="cover").withColumn("score", F.round("score", 6))


@query("K8_norm_by_max", f"with {_BM25} select query_id, chunk_id, round(score / max(score) over (partition by query_id), 6) as score_kw from s")
def _(spark, d):
    found = K.keyword_topk(D.questions(spark, d), _postings(spark, d), 10**9, mode="any")
    return K.norm_by_max(found).select("query_id", "chunk_id", F.round("score_kw", 6).alias("score_kw"))


@query("K9_docs_with_all_terms", f"with {_POSTINGS}, {_ASKED_T}, need as (select query_id, count(*) as want from asked group by 1), g as (select query_id, chunk_id as doc_id, count(*) as got from asked join post using (term) group by all), r as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) as n from g join need using (query_id) where got = want) select query_id, doc_id from r where n <= 50")
def _(spark, d):
    terms = K.websearch_terms(D.questions(spark, d)).select("query_id", F.explode("terms").alias("term")).distinct()
    return K.docs_with_all_terms(terms, _postings(spark, d), D.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "doc_id"))


@query("K10_scan_any_term", f"with {D.SQL_DOCS} select doc_id from docs where contains(lower(text), 'tion the') or contains(lower(text), 'que la') order by collected_at desc, doc_id limit 200")
def _(spark, d):
    docs = D.documents(spark, d)
    return K.scan_any_term(docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text"), ["TION the", "que la"], docs.withColumnRenamed("collected_at", "extracted_at")).select("doc_id")


@query("K10_scan_any_terms", f"""with {D.SQL_DOCS}, w as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]{{7,}}')) as term from benchmark), f as (select distinct query_id, doc_id, collected_at from w join docs on contains(lower(text), term)),
 r as (select *, row_number() over (partition by query_id order by collected_at desc, doc_id) as rank from f) select query_id, doc_id as chunk_id, rank::int as rank from r where rank <= 200""")
def _(spark, d):
    """Each benchmark text asks for all its words of seven letters and more."""
    docs = D.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.col("collected_at").alias("extracted_at"))
    asked = D.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{7,}"), F.lit(0)).alias("terms"))
    return K.scan_any_terms(docs, asked, docs.select("doc_id", "extracted_at"))


# --- fusion -----------------------------------------------------------------------------------

_LEGS = f"""s as (select q.vec_id as query_id, i.vec_id as chunk_id, round({_COS}, 9) as c from embeddings q, embeddings i where q.vec_id % 100 = 0),
 v as (select *, row_number() over (partition by query_id order by c desc, chunk_id) as rank from s qualify rank <= 20),
 k as (select query_id, chunk_id, c * (chunk_id % 3) as c, row_number() over (partition by query_id order by c * (chunk_id % 3) desc, chunk_id) as rank from s qualify rank <= 20),
 j as (select coalesce(v.query_id, k.query_id) as query_id, coalesce(v.chunk_id, k.chunk_id) as chunk_id, v.c as cv, k.c as ck, v.rank as rv, k.rank as rk from v full join k on v.query_id = k.query_id and v.chunk_id = k.chunk_id)"""


def _legs(spark, d):
    asked, index = _asked(spark, d), _index(spark, d).withColumn("w", F.col("chunk_id") % 3)
    return V.vector_topk(asked, index, 20, digits=9), V.vector_topk(asked, index, 20, digits=9, weight="w")


@query("H1_fuse_rrf", f"with {_LEGS} select query_id, chunk_id, round(0.7 / (60 + coalesce(rv, 1000000000)) + 0.3 / (60 + coalesce(rk, 1000000000)), 8) as score from j")
def _(spark, d):
    return H.fuse_rrf(*_legs(spark, d)).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query("H2_fuse_minmax", f"with {_LEGS}, mv as (select query_id, min(c) as lo, max(c) as hi from v group by 1), mk as (select query_id, min(c) as lo, max(c) as hi from k group by 1) select query_id, chunk_id, round(coalesce(0.7 * case when mv.hi > mv.lo then (cv - mv.lo) / (mv.hi - mv.lo) else 0 end, 0) + coalesce(0.3 * case when mk.hi > mk.lo then (ck - mk.lo) / (mk.hi - mk.lo) else 0 end, 0), 6) as score from j join mv using (query_id) join mk using (query_id)")
def _(spark, d):
    return H.fuse_minmax(*_legs(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("H3_merge_hits", f"with {_LEGS} select query_id, chunk_id, round(coalesce(ck, cv), 6) as score from j")
def _(spark, d):
    return H.merge_hits(*_legs(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("H4_top_n", f"with {_LEGS} select query_id, chunk_id, rank::int as rank from v where rank <= 7")
def _(spark, d):
    return H.top_n(_legs(spark, d)[0], 7).select("query_id", "chunk_id", "rank")


@query("H5_rerank", f"with {_LEGS} select query_id, chunk_id, row_number() over (partition by query_id order by chunk_id % 11 desc, chunk_id)::int as rank from v")
def _(spark, d):
    return H.rerank(_legs(spark, d)[0], F.col("chunk_id") % 11).select("query_id", "chunk_id", "rank")


@query("H6_boost_types", f"with {_LEGS} select query_id, chunk_id, round(c + case when chunk_id % 2 = 0 then 0.05 else 0 end, 6) as score from v")
def _(spark, d):
    hits = _legs(spark, d)[0].withColumn("types", F.array(F.when(F.col("chunk_id") % 2 == 0, "table").otherwise("list")))
    return H.boost_types(hits, F.array(F.lit("table"))).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> ''))"


@query("H7_token_set", f"select doc_id, len({_TOK})::int as n from documents")
def _(spark, d):
    return D.read(spark, d, "documents").select("doc_id", F.size(T.token_set(F.col("text"))).alias("n"))


@query("H8_jaccard", f"with t as (select conv_id, turn, {_TOK} as s, lead({_TOK}) over (partition by conv_id order by turn) as n from conversations) select conv_id, turn, round(case when len(s) = 0 or len(n) = 0 then 0 else len(list_intersect(s, n)) / len(list_distinct(list_concat(s, n))) end, 6)::double as j from t where n is not null")
def _(spark, d):
    c = D.read(spark, d, "conversations").withColumn("n", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("k", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("k is not null")
    return c.select("conv_id", "turn", F.round(T.jaccard(T.token_set(F.col("text")), T.token_set(F.col("n"))), 6).alias("j"))


def _hits(spark, d, k=40):
    docs = D.documents(spark, d)
    found = K.keyword_topk(D.questions(spark, d), _postings(spark, d), k, mode="any")
    return H.fetched(found, docs.select(F.col("doc_id").alias("chunk_id"), "tenant_id", "text", "uri"))


@query("H9_mmr")
def _(spark, d):
    return H.mmr(_hits(spark, d), 8).select("query_id", "chunk_id", "rank")


@query("H10_cap_per_doc", f"with {_BM25}, r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 40), c as (select r.*, row_number() over (partition by query_id, source order by rank) as k from r join documents on chunk_id = doc_id::varchar), e as (select query_id, chunk_id, row_number() over (partition by query_id order by rank) as rank from c where k <= 3) select query_id, chunk_id, rank::int as rank from e where rank <= 8")
def _(spark, d):
    return H.cap_hits(_hits(spark, d).withColumnRenamed("tenant_id", "doc_id"), 3, 8).select("query_id", "chunk_id", "rank")


@query("H11_safety_net", f"with {D.SQL_QUESTIONS}, top as (select doc_id::varchar as chunk_id, row_number() over (order by length(text) desc, doc_id::varchar) as rank from documents qualify rank <= 8) select query_id, chunk_id, rank::int as rank, 0.005::double as score from qs, top where query_id % 4 = 0")
def _(spark, d):
    q = D.questions(spark, d)
    corpus = D.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.array(F.lit("paragraph")).alias("types"))
    out = H.safety_net(q, q.filter("query_id % 4 <> 0"), corpus)
    return out.select("query_id", "chunk_id", "rank", F.col("score").cast("double").alias("score"))


@query("H12_expand_window", f"with {D.SQL_BLOCKS}, w as (select doc_id, pos, concat_ws(chr(10) || chr(10), lag(text) over o, text, lead(text) over o) as text, count(*) over (partition by doc_id) as n from bl window o as (partition by doc_id order by pos)) select doc_id, pos, md5(text) as h, n > 1 as window_expanded from w")
def _(spark, d):
    b = D.line_blocks(spark, d).withColumn("chunk_id", F.concat("doc_id", F.lit("#"), "pos"))
    hits = b.select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), "chunk_id", "doc_id", "pos", "text", "span_start", "span_end")
    return H.expand_window(hits, b).select("doc_id", "pos", F.md5("text").alias("h"), "window_expanded")


@query("P2_restrict_docs", f"with {_BM25} select query_id, chunk_id from s where query_id % 2 = 0 or chunk_id in ('1', '2', '3')")
def _(spark, d):
    q = D.questions(spark, d).withColumn("doc_ids", F.when(F.col("query_id") % 2 == 1, F.array(F.lit("1"), F.lit("2"), F.lit("3"))))
    found = K.keyword_topk(q, _postings(spark, d), 10**9, mode="any").withColumn("doc_id", F.col("chunk_id"))
    return filters.restrict_docs(found, q).select("query_id", "chunk_id")


# --- contexts ---------------------------------------------------------------------------------


def _full_hits(spark, d, k=16):
    return _hits(spark, d, k).select("query_id", "rank", "chunk_id", F.col("tenant_id").alias("doc_id"), "text", F.array(F.lit("paragraph")).alias("types"), F.array("chunk_id").alias("source_block_ids"), (F.col("rank") * 3).alias("page_start"), (F.col("rank") * 3).alias("page_end"), "uri", "score")


@query("A2_round_robin", f"with {_BM25}, r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 16), c as (select r.query_id, chunk_id, rank, row_number() over (partition by query_id, source order by score desc, rank) as k, min(rank) over (partition by query_id, source) as f from r join documents on chunk_id = doc_id::varchar) select query_id, chunk_id, row_number() over (partition by query_id order by k, f)::int as turn from c")
def _(spark, d):
    return A.round_robin(_full_hits(spark, d), D.questions(spark, d)).select("query_id", "chunk_id", "turn")


@query("A4_pack_context")
def _(spark, d):
    out = A.pack_context(_full_hits(spark, d), D.questions(spark, d))
    return out.select("query_id", F.md5("context").alias("h"), F.size("footnotes").alias("notes"), F.array_join("used_chunks", ",").alias("used"))


@query("A6_build_prompts")
def _(spark, d):
    q = D.questions(spark, d)
    return A.build_prompts(A.pack_context(_full_hits(spark, d), q), q).select("query_id", "mode", F.md5(F.to_json("messages")).alias("h"))


@query("A7_with_spend_hit", f"with {D.SQL_INVOICES}, q as (select c_custkey as query_id from customer), t as (select sum(total) as v from inv where invoice_date between date '2000-10-01' and date '2000-12-31') select query_id, 'Structured metric: total_spend from 2000-10-01 to 2000-12-31 = ' || printf('%.2f', v::double) as text from q, t")
def _(spark, d):
    q = D.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("total spend last quarter").alias("q"))
    none = q.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit("").alias("text"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return A.with_spend_hit(none, q, D.invoices(spark, d), F.lit(D.TODAY)).select("query_id", "text")


@query("A8_sum_numbers", "select o_orderkey, round(o_totalprice + o_custkey, 2) as total from orders where o_custkey > 0")
def _(spark, d):
    line = F.concat(F.lit("paid $"), F.format_number("o_totalprice", 2), F.lit("\nand "), F.col("o_custkey").cast("string"), F.lit(" more"))
    return D.read(spark, d, "orders").filter("o_custkey > 0").select("o_orderkey", T.sum_numbers(line).alias("total"))


@query("A9_parse_answers", "select c_custkey as query_id, case c_custkey % 3 when 2 then 'not json' else 'yes [^1]' end as answer, c_custkey % 3 <> 2 as valid from customer")
def _(spark, d):
    body = '{"answer": "yes [^1]", "citations": [{"n": 1}], "confidence": 0.5}'
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, body).when(k == 1, "```json\n" + body + "\n```").otherwise("not json")
    return A.parse_answers(D.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), raw.alias("raw"))).select("query_id", "answer", "valid")


@query("A10_citation_numbers", "select o_orderkey, case when o_custkey % 9 = 3 then '3' else '3,' || (o_custkey % 9) end as cited from orders")
def _(spark, d):
    s = F.concat(F.lit("so [^3] and [^"), (F.col("o_custkey") % 9).cast("string"), F.lit("] [^3] [x]"))
    return D.read(spark, d, "orders").select("o_orderkey", F.array_join(T.citation_numbers(s).cast("array<string>"), ",").alias("cited"))


@query("A11_resolve_citations", "select c_custkey as query_id, unnest(case when c_custkey % 2 = 0 then [3, 1] else [1, 2] end) as n from customer")
def _(spark, d):
    c = D.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    none = F.array().cast("array<int>")
    ans = c.select("query_id", F.when(F.col("query_id") % 2 == 0, "a [^3] b [^1] c [^9]").otherwise("none").alias("answer"), none.alias("citations"))
    notes = c.select("query_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n")).select("query_id", "n", F.lit("d").alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(4).alias("page_start"))
    return A.resolve_citations(ans, notes).select("query_id", "n")


_T3 = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 3))"
_N = r"list_distinct(regexp_extract_all(coalesce({0}, ''), '\b\d+(?:[\.,]\d+)?\b'))"


@query("A12_groundedness", f"""with t as (select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as c from conversations), x as (select conv_id, turn, {_T3.format('a')} as ta, {_T3.format('c')} as tc, {_N.format('a')} as na, {_N.format('c')} as nc from t where c is not null),
 y as (select *, len(list_intersect(ta, tc)) / greatest(1, len(ta)) as base from x) select conv_id, turn, case when len(ta) = 0 then 0 else round(round(0.4 * base + 0.6 * case when len(na) > 0 then len(list_intersect(na, nc)) / len(na) else base end, 3), 1) end::double as g from y""")
def _(spark, d):
    c = D.read(spark, d, "conversations").withColumn("n", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("k", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("n is not null")
    return c.select("conv_id", "turn", F.round(T.groundedness(F.col("text"), F.col("n")), 1).alias("g"))


@query("A13_score_answers")
def _(spark, d):
    c = D.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("context"), F.lit(0.5).alias("confidence"), F.lit(1).alias("n_citations"))
    return A.score_answers(c).select("query_id", "groundedness", "confidence", "warning")


@query("A14_with_sources", "select c_custkey as query_id, 'a' || chr(10) || chr(10) || '**Sources:**' || chr(10) || '- u' || (c_custkey % 3) || chr(10) || '- z' as answer from customer")
def _(spark, d):
    c = D.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    u = F.concat(F.lit("u"), (F.col("query_id") % 3).cast("string"))
    cites = c.select("query_id", F.posexplode(F.array(u, F.lit("z"), u)).alias("place", "uri"))
    return A.with_sources(c.withColumn("answer", F.lit("a")), cites)


# --- structured -------------------------------------------------------------------------------


def _invoice_blocks(spark, d):
    """Orders written out as documents: a header, a paragraph and a table of lines."""
    o, l = D.read(spark, d, "orders"), D.read(spark, d, "lineitem")
    rows = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), F.format_string("%.2f", "l_extendedprice")).alias("r")))), lambda x: x["r"]), "\n").alias("t"))
    j = o.join(rows, o["o_orderkey"] == rows["l_orderkey"])
    head = F.concat(F.lit("Acme "), F.col("o_custkey").cast("string"), F.lit("\nInvoice number: INV-"), F.col("o_orderkey").cast("string"), F.lit("\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nTotal: USD? "), F.lit("\nGrand total: "), F.format_string("%.2f", "o_totalprice"), F.lit(" USD"))
    part = F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("paragraph").alias("type"), head.alias("text")), F.struct(F.lit(1).alias("pos"), F.lit("table").alias("type"), F.concat(F.lit("Item description | Qty | Amount\n"), "t").alias("text"))))
    return j.select(F.col("o_orderkey").cast("string").alias("doc_id"), part.alias("p")).select("doc_id", "p.*")


@query("X1_classify_docs", "select distinct l_orderkey::varchar as doc_id, 'invoice' as doc_class from lineitem join orders on o_orderkey = l_orderkey")
def _(spark, d):
    return facts.classify_docs(_invoice_blocks(spark, d))


@query("X2_extract_invoices", "select distinct o_orderkey::varchar as invoice_id, 'Acme ' || o_custkey as vendor, 'INV-' || o_orderkey as invoice_number, o_orderdate::date as invoice_date, o_totalprice::double as total, 'USD' as currency from orders join lineitem on o_orderkey = l_orderkey")
def _(spark, d):
    return facts.extract_invoices(_invoice_blocks(spark, d)).withColumn("total", F.col("total").cast("double")).drop("due_date")


@query("X4_extract_line_items", "select l_orderkey::varchar as invoice_id, 'part ' || l_partkey as description, l_quantity::int::double as qty, round(l_extendedprice, 2)::double as amount from lineitem join orders on o_orderkey = l_orderkey")
def _(spark, d):
    return facts.extract_line_items(_invoice_blocks(spark, d)).select("invoice_id", "description", F.col("qty").cast("double").alias("qty"), F.col("amount").cast("double").alias("amount"))


@query("X5_extract_contracts", "select o_orderkey::varchar as contract_id, 'Acme' as party_a, 'C' || o_custkey as party_b, o_orderdate::date as effective_date from orders")
def _(spark, d):
    text = F.concat(F.lit("This agreement is between Acme and C"), F.col("o_custkey").cast("string"), F.lit(" here.\nEffective Date: "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return facts.extract_contracts(D.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("pos"), F.lit("paragraph").alias("type"), text.alias("text")))


@query("S18_from_content_list", "select page_id::varchar as doc_id, 0 as pos, 'text' as type, url as text from pages union all select page_id::varchar, 1, 'table', '' from pages")
def _(spark, d):
    items = F.concat(F.lit('[{"text": '), F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2), F.lit(', "bbox": [1, 2]}, {"type": "table", "table_body": [["a", "b"]]}]'))
    rows = D.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), items.alias("items_json"))
    return tables.from_content_list(rows).select("doc_id", "pos", "type", "text")


# --- search -----------------------------------------------------------------------------------


def corpus(spark, d) -> S.Corpus:
    """Chunks and vectors are written once, since a search reads each many times; the graph is made where it is read, of the
    documents that it is read for. Without postings: one table of questions doesn't repay an index."""
    keep = staged
    b = D.line_blocks(spark, d)
    chunks = keep(C.chunk_documents(b), "chunks")
    e = keep(V.hash_embed(chunks, "chunk_id", "text", 64), "vectors")
    edges = G.contains_edges(b).unionByName(G.follows_edges(b))
    return S.Corpus(chunks, D.documents(spark, d), e, None, G.graph_nodes(b), edges, D.invoices(spark, d))


@query("H13_search")
def _(spark, d):
    q = D.search_questions(spark, d)
    q = staged(q.join(V.hash_embed(q, "query_id", "q", 64), "query_id"))
    out = S.search(q, corpus(spark, d), F.lit(D.TODAY), ts(D.NOW))
    return out.select("query_id", "rank", "chunk_id", "doc_id", "window_expanded")


@query("V10_search_vector")
def _(spark, d):
    q = D.search_questions(spark, d)
    q = staged(q.join(V.hash_embed(q, "query_id", "q", 64), "query_id"))
    return S.search_vector(q, corpus(spark, d), 10, ts(D.NOW)).filter("rank <= 10").select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))

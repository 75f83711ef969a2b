"""Registered queries: table versions, manifests, header chains, edges, chunks and facts, one operator each.

``_titled`` makes headers of three levels of some lines, so that chains and edges have work to do.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import keys, text as T
from ..operators import blocks as B, chunks as C, context as A, facts, graph as G
from ..sources import ingest, tables
from ..sources.stage import stage_path, staged
from . import data as D

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def _titled(spark, d):
    """Lines as artifacts; a line whose length is a multiple of four is a header of level 1 to 3."""
    a = B.text_to_artifacts(D.read(spark, d, "documents"), "line")
    header = F.length("text") % 4 == 0
    return a.withColumns({"type": F.when(header, "header").otherwise(F.col("type")), "level": F.when(header, (F.length("text") % 3 + 1).cast("int"))})


#: Of each level the last header before the line, by its place.
_TITLED = f"""with {D.SQL_BLOCKS}, t as (select doc_id, pos, text, length(text) % 4 = 0 as header, length(text) % 3 + 1 as level from bl),
 h as (select *, {", ".join(f"last_value(case when header and level = {k} then pos end ignore nulls) over w as h{k}" for k in (1, 2, 3))} from t window w as (partition by doc_id order by pos rows between unbounded preceding and 1 preceding))"""


# --- sources ----------------------------------------------------------------------------------


@query("S12_replace_partitions", "select doc_id::varchar as doc_id, lang, case when lang = 'en' then 'new' else 'old' end as version from documents")
def _(spark, d):
    rows = D.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    path = stage_path(spark, "versions")
    tables.replace_partitions(rows.withColumn("version", F.lit("old")), path, ["lang"])
    tables.replace_partitions(rows.filter("lang = 'en'").withColumn("version", F.lit("new")), path, ["lang"])
    return tables.current(spark, path)


@query("S16_read_manifests", f"with {D.SQL_BLOCKS} select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as pos, 'paragraph' as type, md5(text) as h, 0 as page_idx from bl")
def _(spark, d):
    """S17 writes what this reads."""
    a = B.text_to_artifacts(D.read(spark, d, "documents"), "line").select("doc_id", "pos", "type", "text", "page_idx")
    path = stage_path(spark, "manifests")
    tables.write_manifests(a, path)
    return tables.read_manifests(spark, path).select("doc_id", "pos", "type", F.md5("text").alias("h"), "page_idx")


@query("S17_write_manifests", f"with {D.SQL_BLOCKS} select doc_id, count(*)::bigint as artifact_total, sum(length(text))::bigint as text_chars, 0::bigint as tables from bl group by doc_id")
def _(spark, d):
    path = stage_path(spark, "manifests")
    tables.write_manifests(B.text_to_artifacts(D.read(spark, d, "documents"), "line"), path)
    stats = spark.read.schema("doc_id string, stats struct<artifact_total:bigint,text_chars:bigint,tables:bigint>").json(path)
    return stats.select("doc_id", "stats.*")


@query("S19_from_ref_tree", "with l as (select doc_id::varchar as doc_id, string_split(text, chr(10)) as l from documents) select doc_id, unnest(range(len(l)))::int as pos, 'text' as type, md5(unnest(l)) as h from l")
def _(spark, d):
    lines = F.split("text", "\n")
    refs = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.struct(F.concat(F.lit("#/texts/"), k.cast("string")).alias("$ref")))
    tree = F.struct(F.struct(refs.alias("children")).alias("body"), F.transform(lines, lambda x: F.struct(x.alias("text"))).alias("texts"))
    trees = D.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.to_json(tree).alias("tree_json"))
    return tables.from_ref_tree(trees).select("doc_id", "pos", "type", F.md5("text").alias("h"))


# --- blocks and graph -------------------------------------------------------------------------


@query(
    "B3_header_chain_lines",
    f"""{_TITLED}, o as (select *, h1 is not null as ok1, h2 is not null and (h1 is null or h1 < h2) as ok2, h3 is not null and (greatest(h1, h2) is null or greatest(h1, h2) < h3) as ok3 from h),
 n as (select *, case when header then level - 1 when ok3 then 3 when ok2 then 2 when ok1 then 1 else 0 end as depth from o)
 select n.doc_id, n.pos, array_to_string([case when ok1 then a.text else '' end, case when ok2 then b.text else '' end, case when ok3 then c.text else '' end][1:depth], ' / ') as headers
 from n left join bl a on a.doc_id = n.doc_id and a.pos = h1 left join bl b on b.doc_id = n.doc_id and b.pos = h2 left join bl c on c.doc_id = n.doc_id and c.pos = h3""",
)
def _(spark, d):
    return B.with_header_chain(_titled(spark, d)).select("doc_id", "pos", F.array_join("headers", " / ").alias("headers"))


@query("B11_table_shape", "with t as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: len(string_split(x, ' '))) as w from documents) select doc_id, len(w)::int as rows, list_max(w)::int as cols from t")
def _(spark, d):
    cells = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
    return D.read(spark, d, "documents").select("doc_id", T.table_shape(cells).alias("s")).select("doc_id", "s.*")


@query("G2_contains_edges_lines", f"{_TITLED} select doc_id, pos, coalesce(case when not header then greatest(h1, h2, h3) when level = 3 then greatest(h1, h2) when level = 2 then h1 end, -1)::int as parent_pos from h")
def _(spark, d):
    b = B.artifacts_to_blocks(_titled(spark, d))
    nodes = G.graph_nodes(b)
    ends = [nodes.select(F.col("node_id").alias(f"{x}_node_id"), F.col("pos").alias(p)) for x, p in (("src", "parent_pos"), ("dst", "pos"))]
    return G.contains_edges(b).join(ends[0], "src_node_id").join(ends[1], "dst_node_id").select("doc_id", "pos", "parent_pos")


@query("G5_block_chunk_map", f"with {D.SQL_BLOCKS} select doc_id, count(*)::bigint as blocks from bl group by doc_id")
def _(spark, d):
    """Every block is in a chunk."""
    b = D.line_blocks(spark, d)
    return G.block_chunk_map(C.chunk_documents(b)).join(b.select("block_id"), "block_id").groupBy("doc_id").agg(F.countDistinct("block_id").alias("blocks"))


@query("G6_expand_hits", f"""with {D.SQL_BLOCKS}, k as (select *, row_number() over (partition by doc_id order by pos) as k from bl)
 select doc_id as query_id, doc_id || '#' || pos as chunk_id, round(0.6::double + case when pos % 3 = 0 then 0.1 else 0 end + case when contains(text, ',') then 0.03 else 0 end, 6) as score_graph, 1 as from_rank from k where k between 2 and 31""")
def _(spark, d):
    """A document's first line is the hit; the next line and its siblings, up to 32 with the root, are found. Every third
    line stands under a header that the question names, and lines with commas count as tables."""
    # Lines are made once. Of their texts only the commas are asked for: no labels are read.
    b = staged(D.line_blocks(spark, d).drop("span_start", "span_end").withColumn("text", F.when(F.contains("text", F.lit(",")), ",").otherwise("-")), "blocks")
    nodes, edges = G.graph_nodes(b), G.contains_edges(b).unionByName(G.follows_edges(b))
    chunk = F.concat("doc_id", F.lit("#"), "pos")
    headers = F.array(F.when(F.col("pos") % 3 == 0, "Grand total").otherwise("Notes"))
    types = F.array(F.when(F.contains("text", F.lit(",")), "table").otherwise("paragraph"))
    chunks = b.select(chunk.alias("chunk_id"), "doc_id", F.struct(F.array("block_id").alias("source_block_ids"), headers.alias("context_headers"), types.alias("types")).alias("meta"))
    first = b.groupBy("doc_id").agg(F.min("pos").alias("pos"))
    hits = first.select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), chunk.alias("chunk_id"), F.lit(1.0).alias("score_vec"))
    return G.expand_hits(hits, nodes, edges, chunks, questions=hits.select("query_id", F.lit("the grand total please").alias("q")))


# --- chunks -----------------------------------------------------------------------------------


@query("C5_chunk_tables", f"with {D.SQL_BLOCKS} select doc_id, pos as ordinal, md5(trim(text)) as h, 'layout' as strategy from bl where contains(text, ',')")
def _(spark, d):
    b = D.line_blocks(spark, d).withColumn("type", F.when(F.col("text").contains(","), "table").otherwise(F.col("type")))
    return C.chunk_tables(b, C.plan_chunks(b)).select("doc_id", "ordinal", F.md5("text").alias("h"), "meta.strategy")


@query(
    "C14_embed_text",
    "select doc_id, md5(case when lang = 'en' then '[table rows=' || (doc_id % 7) || ' cols=?] ' when lang = 'de' then '[list] ' else '' end || source || ' / ' || lang || chr(10) || chr(10) || text) as h from documents",
)
def _(spark, d):
    kind = F.when(F.col("lang") == "en", "table").when(F.col("lang") == "de", "list").otherwise("paragraph")
    meta = F.struct(F.array(kind).alias("types"), F.array("source", "lang").alias("context_headers"), (F.col("doc_id") % 7).cast("int").alias("rows"), F.lit(None).cast("int").alias("cols"))
    docs = D.read(spark, d, "documents").withColumn("meta", meta)
    return docs.select("doc_id", F.md5(T.embed_text(F.col("meta"), F.col("text"))).alias("h"))


# --- facts and answers ------------------------------------------------------------------------


@query("R5_student_fee_facts", """with f as (select o_custkey, o_totalprice from orders order by o_orderkey limit 1)
 select c_custkey as query_id, case when c_custkey % 3 <> 0 then 'Customer No ' || chr((65 + o_custkey % 26)::int) end as student, case when c_custkey % 3 <> 1 then round(o_totalprice, 2)::double end as value, case c_custkey % 3 when 0 then 0.45 when 1 then 0.35 else 0.8 end::double as confidence from customer, f""")
def _(spark, d):
    """Customers ask for the name, the fees or both; the fact is the first of the corpus, here the first order's."""
    k = F.col("c_custkey") % 3
    asked = D.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("student_fees").alias("fact_kind"), F.when(k == 0, "which fees").when(k == 1, "the student name").otherwise("student name and fees").alias("q"))
    name = F.concat(F.lit("Student name: Customer No "), F.char(65 + F.col("o_custkey") % 26), F.lit("\n1. Total: "), F.format_string("%.2f", "o_totalprice"))
    chunks = D.read(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("chunk_id"), name.alias("text"))
    return facts.student_fee_facts(asked, chunks).withColumn("value", F.col("value").cast("double")).withColumn("confidence", F.round("confidence", 4).cast("double"))


@query("R8_page_of", "select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 1 when 1 then l_linenumber when 2 then l_linenumber + 10 else 1 end::int as page from lineitem")
def _(spark, d):
    n = F.col("l_linenumber")
    none = F.lit(None).cast("string")
    start = F.when(n % 4 == 1, F.concat(F.lit(" "), n.cast("string"))).when(n % 4 == 2, "cover").otherwise(none)
    meta = F.create_map(F.lit("page_start"), start, F.lit("pg"), F.when(n % 4 == 2, (n + 10).cast("string")).when(n % 4 == 3, "x"))
    return D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", keys.page_of(meta).alias("page"))


_TOK3 = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 3))"
_NUM = r"list_distinct(regexp_extract_all(coalesce({0}, ''), '\b\d+(?:[\.,]\d+)?\b'))"


@query(
    "A13_score_answers_turns",
    f"""with t as (select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as c from conversations), x as (select conv_id, turn, a, {_TOK3.format('a')} as ta, {_TOK3.format('c')} as tc, {_NUM.format('a')} as na, {_NUM.format('c')} as nc from t),
 y as (select *, len(list_intersect(ta, tc)) / greatest(1, len(ta)) as base from x), g as (select *, case when len(ta) = 0 then 0 else round(0.4 * base + 0.6 * case when len(na) > 0 then len(list_intersect(na, nc)) / len(na) else base end, 3) end as g from y)
 select conv_id, turn, case when g < 0.18 or turn % 3 = 0 then 'low_groundedness' end as warning, round(0.25 + 0.5 * g, 1)::double as confidence,
 md5(case when g < 0.18 or turn % 3 = 0 then 'Note: Based on limited matching context, this may be incomplete.' || chr(10) || chr(10) else '' end || coalesce(a, '')) as h from g""",
)
def _(spark, d):
    next_text = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = D.read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), next_text.alias("context"), F.lit(0.5).alias("confidence"), (F.col("turn") % 3).cast("int").alias("n_citations"))
    return A.score_answers(c).select("conv_id", "turn", "warning", F.round("confidence", 1).alias("confidence"), F.md5("answer").alias("h"))


@query("C7_targets_by_type", f"""with {D.SQL_BLOCKS}, k as (select doc_id, count(*) as n, case when count(*) filter (length(text) % 11 = 0) > 0 then 640 else 800 end as t, count(*) filter (length(text) % 11 > 0 and length(text) % 3 = 0) as lists from bl group by doc_id)
 select doc_id, case when lists >= greatest(2, floor(n * 0.2)) then greatest(350, floor(t * 0.85)) else t end::int as target from k""")
def _(spark, d):
    n = F.length("text")
    return C.chunk_targets(D.line_blocks(spark, d).withColumn("type", F.when(n % 11 == 0, "code").when(n % 3 == 0, "list").otherwise("paragraph")))


# --- decisions ----------------------------------------------------------------------------------


@query("S6_batch_states", """with b as (select doc_id, coalesce(n_chars, 0) as size, count(*) over (partition by coalesce(n_chars, 0) // 100) as files from documents)
 select doc_id, case when files > 10 or size = 0 then 'REJECTED' else 'STORED' end as state, case when files > 10 then 'too_many_files' when size = 0 then 'empty_file' end as reason from b""")
def _(spark, d):
    size = F.coalesce("n_chars", F.lit(0))
    docs = D.read(spark, d, "documents").select("doc_id", F.floor(size / 100).alias("batch"), F.lit("a.txt").alias("filename"), F.lit("text/plain").alias("mime"), size.alias("size_bytes"))
    return ingest.check_ingest(docs, ingest.Policy(), batch_col="batch").select("doc_id", "state", "reason")


@query("B12_damaged_blocks", f"""with {D.SQL_BLOCKS}, o as (select doc_id, count(*) as n, count(*) filter (length(text) % 7 = 0) as tables, sum(length(text)) as chars, sum(length(regexp_replace(text, '[^\\x20-\\x7E\\s]', '', 'g'))) as good from bl where pos % 3 > 0 group by doc_id),
 a as (select doc_id, sum(length(text)) as a_chars from bl group by doc_id),
 w as (select a.doc_id, concat_ws(',', case when coalesce(n, 0) = 0 then 'no_blocks' end, case when tables > 0 then 'table_count_mismatch' end, case when n > 20 then 'blocks_capped' end, case when good < 0.05 * chars then 'low_printable_ratio' end, case when chars < 0.6 * a_chars then 'low_coverage' end) as warnings from a left join o on o.doc_id = a.doc_id)
 select doc_id, case when warnings = '' then 'OK' else 'WARN' end as status, warnings from w""")
def _(spark, d):
    blocks = D.line_blocks(spark, d).filter("pos % 3 > 0").withColumn("type", F.when(F.length("text") % 7 == 0, "table").otherwise(F.col("type")))
    found = B.check_blocks(blocks, B.text_to_artifacts(D.read(spark, d, "documents"), "line"), 20)
    return found.select("doc_id", "status", F.array_join("warnings", ",").alias("warnings"))


@query("X1_classify_texts", f"""with {D.SQL_BLOCKS}, r as (select doc_id, lower(substr(text, 1, 400)) as t, length(text) % 37 = 0 as is_table, row_number() over (partition by doc_id order by pos) as n from bl),
 g as (select doc_id, coalesce(string_agg(t, chr(10) order by n) filter (n <= 30), '') as t, bool_or(is_table) as has from r group by doc_id)
 select doc_id, case when contains(t, 'agreement') or contains(t, 'party') or contains(t, 'effective date') or contains(t, 'term') then 'contract' when contains(t, 'invoice') or has then 'invoice' else 'generic' end as doc_class from g""")
def _(spark, d):
    return facts.classify_docs(D.line_blocks(spark, d).withColumn("type", F.when(F.length("text") % 37 == 0, "table").otherwise(F.col("type"))))

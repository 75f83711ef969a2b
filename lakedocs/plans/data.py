"""The supplied tables read as the engine's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import blocks as B

NOW, TODAY = "2024-01-30 12:00:00", "2001-01-15"
STAGE = {"signup": "STORED", "view": "EXTRACTED", "click": "CHUNKED", "purchase": "GENERATE", "error": "NORMALIZED"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    key = F.col("doc_id")
    return d.select(
        key.cast("string").alias("doc_id"), F.col("source").alias("tenant_id"), F.sha2("text", 256).alias("sha256"), F.concat(F.lit("documents/"), "source", F.lit("/"), key.cast("string"), F.lit(".txt")).alias("uri"),
        F.lit("text/plain").alias("mime"), F.octet_length("text").cast("long").alias("size_bytes"), F.when(key % 17 == 0, "DELETED").otherwise("STORED").alias("state"),
        F.timestamp_seconds(F.lit(1704067200) + key * 60).alias("collected_at"), "text", "lang", "n_chars",
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(
        F.col("o_orderkey").cast("string").alias("invoice_id"), F.col("c_name").alias("vendor"), F.concat(F.lit("INV-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("invoice_number"),
        F.to_date("o_orderdate").alias("invoice_date"), F.col("o_totalprice").cast("decimal(14,2)").alias("total"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    stage = F.create_map(*[F.lit(x) for kv in STAGE.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("t").alias("tenant_id"), (F.col("user_id") % 100).cast("string").alias("doc_id"), F.coalesce(stage, F.lit("SYSTEM")).alias("stage"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("details_json"), (F.col("user_id") % 10).cast("string").alias("job_id"), "user_id",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each benchmark text."""
    b = read(spark, sf_dir, "benchmark")
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    none = F.array().cast("array<string>")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("q"), none.alias("doc_ids"), none.alias("types"), F.lit(None).cast("int").alias("date_last_days"))


def search_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, and some that name a month, an invoice number, and a number of days."""
    q = questions(spark, sf_dir)
    more = [(-1, "invoices of March 1996", None), (-2, "total for invoice INV-1996-1", None), (-3, "license and rights", 30)]
    none = F.array().cast("array<string>")
    asked = spark.createDataFrame(more, "query_id long, q string, date_last_days int")
    return q.unionByName(asked.select(F.col("query_id").cast(q.schema["query_id"].dataType), "q", none.alias("doc_ids"), none.alias("types"), "date_last_days"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return B.with_spans(B.artifacts_to_blocks(B.text_to_artifacts(d, "line")))


def page_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_header_chain(B.html_to_artifacts(read(spark, sf_dir, "pages")))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_spans(B.artifacts_to_blocks(page_artifacts(spark, sf_dir)))


SQL_DOCS = """docs as (select doc_id::varchar as doc_id, source as tenant_id, sha256(text) as sha256, 'documents/' || source || '/' || doc_id || '.txt' as uri, 'text/plain' as mime,
 octet_length(encode(text))::bigint as size_bytes, case when doc_id % 17 = 0 then 'DELETED' else 'STORED' end as state, timestamp '2024-01-01 00:00:00' + doc_id * interval 1 minute as collected_at, text, lang, n_chars, doc_id as num from documents)"""
SQL_INVOICES = """inv as (select o_orderkey::varchar as invoice_id, c_name as vendor, 'INV-' || year(o_orderdate) || '-' || o_orderkey as invoice_number, o_orderdate::date as invoice_date, o_totalprice::decimal(14,2) as total from orders join customer on o_custkey = c_custkey)"""
SQL_EVENTS = """ev as (select event_id::varchar as event_id, (user_id % 100)::varchar as doc_id, case event_type when 'signup' then 'STORED' when 'view' then 'EXTRACTED' when 'click' then 'CHUNKED' when 'purchase' then 'GENERATE' when 'error' then 'NORMALIZED' else 'SYSTEM' end as stage,
 case when event_type = 'error' then 'ERROR' else 'OK' end as status, ts, props as details_json, (user_id % 10)::varchar as job_id, user_id from events)"""
SQL_QUESTIONS = r"""qs as (select item_id as query_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+'), ' ') as q from benchmark)"""
SQL_BLOCKS = """lines as (select doc_id::varchar as doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
bl as (select doc_id, pos::int as pos, 'paragraph' as type, text from lines where trim(text) <> '')"""

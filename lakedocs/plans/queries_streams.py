"""Registered queries of the streaming forms: the given tables go through a stream, and what its store holds
at the end is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import keyword as K
from ..sources.stage import stage_path
from ..sources.store import Store
from ..streaming import streams as S
from . import data as D, queries_search as Q

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def streamed(df: DataFrame, by: str | None = None, at_once: int = 1000) -> DataFrame:
    """``df`` written in a few files and read as a stream, ``at_once`` files a batch; rows of one value of ``by`` together."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, "stream")
    dealt = df.repartition(4) if by is None else df.repartition(4, by)
    dealt.write.option("compression", "zstd").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once).parquet(path)


def _run(spark: SparkSession, start) -> str:
    """The store that a stream has filled: ``start`` gets its folder and that of the checkpoint."""
    root = stage_path(spark, "store")
    start(root, stage_path(spark, "checkpoint")).awaitTermination()
    return root


def _events(spark, d) -> DataFrame:
    e = D.events(spark, d)
    return e.select("event_id", "doc_id", "stage", "status", "ts")


@query("T1_ingest_stream", "with u as (select distinct text from documents where text <> ''), l as (select sha256(text) as sha256, unnest(string_split(text, chr(10))) as line from u) select sha256, count(*) filter (where trim(line) <> '')::bigint as n_blocks from l group by sha256")
def _(spark, d):
    rows = D.documents(spark, d).select(F.lit("t").alias("tenant_id"), F.concat("doc_id", F.lit(".txt")).alias("filename"), F.lit(None).cast("string").alias("declared_mime"), F.encode("text", "UTF-8").alias("content"))
    root = _run(spark, lambda root, at: S.ingest_rows_stream(streamed(rows), root, at))
    store = S.corpus_store(spark, root)
    n = store.read("blocks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return store.read("documents").join(n, "doc_id", "left").select("sha256", F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


_FIRST = "select doc_id::varchar as doc_id, lang as tenant_id, sha256(text) as sha256, source in ('src0', 'src1', 'src2') as stored from documents"


@query("T2_dedupe_stored", f"with r as ({_FIRST}), o as (select tenant_id, sha256, coalesce(min(doc_id) filter (where stored), min(doc_id)) as original_id from r group by all) select doc_id, original_id from r join o using (tenant_id, sha256) where doc_id <> original_id")
def _(spark, d):
    """Three sources' documents are in the store; the others come as a stream."""
    rows = D.documents(spark, d).select("doc_id", F.col("lang").alias("tenant_id"), "sha256", "tenant_id")
    rows = rows.toDF("doc_id", "tenant_id", "sha256", "source")
    stored = F.col("source").isin("src0", "src1", "src2")

    def start(root, at):
        S.put_hashes(Store(spark, root, dict(S.SEEN)), rows.filter(stored).drop("source"))
        return S.dedupe_into(streamed(rows.filter(~stored).drop("source")), root, at)

    return Store(spark, _run(spark, start), {}).read("duplicates").select("doc_id", "original_id")


def _all_rows(store: Store) -> DataFrame:
    """Counts and late rows together."""
    both = store.read("counts").select("start", "end", "n").unionByName(store.read("late").select("start", "end", "n"))
    return both.groupBy("start", "end").agg(F.sum("n").alias("n"))


@query("T4_hourly_counts", f"with {D.SQL_EVENTS} select date_trunc('hour', ts)::timestamp as bucket, count(*)::bigint as count from ev group by 1")
def _(spark, d):
    """Event types one after the other, so that most rows are late; those are counted too."""
    root = _run(spark, lambda root, at: S.counts_into(streamed(_events(spark, d), "stage", 1), root, at))
    return _all_rows(Store(spark, root, {})).select(F.col("start").cast("timestamp_ntz").alias("bucket"), F.col("n").alias("count"))


@query("T5_questions_24h", f"with {D.SQL_EVENTS}, e as (select date_trunc('hour', ts) + unnest(range(1, 25)) * interval 1 hour as until from ev where stage = 'GENERATE') select until::timestamp as until, count(*)::bigint as queries_24h from e group by 1")
def _(spark, d):
    root = _run(spark, lambda root, at: S.counts_into(streamed(_events(spark, d).filter("stage = 'GENERATE'"), None, 1), root, at, "24 hours", "1 hour"))
    return _all_rows(Store(spark, root, {})).select(F.col("end").cast("timestamp_ntz").alias("until"), F.col("n").alias("queries_24h"))


@query("T6_progress", f"""with {D.SQL_EVENTS} select doc_id, max_by(stage, ts::varchar || '/' || event_id) as stage, bool_or(status in ('ERROR', 'FAIL')) as has_error,
 max(case stage when 'STORED' then 1 when 'NORMALIZED' then 2 when 'EXTRACTED' then 3 when 'CHUNKED' then 4 when 'EMBEDDED' then 5 else 0 end) / 5.0 as progress from ev group by doc_id""")
def _(spark, d):
    """In one batch: what is behind the watermark of an earlier one would be left out."""
    root = _run(spark, lambda root, at: S.progress_into(streamed(_events(spark, d)), root, at, 24 * 60))
    return Store(spark, root, {}).read("progress")


@query("T7_question_stream", Q.ORACLE["K5_keyword_topk"])
def _(spark, d):
    index = Q._postings(spark, d)
    asked = streamed(D.questions(spark, d).select("query_id", "q"), None, 2)
    out = stage_path(spark, "answers")
    S.search_stream(asked, lambda q: K.keyword_topk(q, index, 10, mode="any"), out, stage_path(spark, "checkpoint")).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")

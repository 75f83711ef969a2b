"""Reporting and lifecycle: spend, dashboards, activity, progress, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import blob_key

STAGES = ["STORED", "NORMALIZED", "EXTRACTED", "CHUNKED", "EMBEDDED"]


def total_spend(invoices: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row: the total of invoices dated from start to end, 0 without any."""
    return invoices.filter(F.col("invoice_date").between(start, end)).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_spend"))


def dashboard_stats(docs: DataFrame, events: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """One row: live documents, questions in 24 hours, chunks of live documents."""
    live = docs.filter("state <> 'DELETED'")
    a = live.agg(F.count(F.lit(1)).alias("documents"))
    b = events.filter((F.col("stage") == "GENERATE") & (F.col("ts") > now - F.expr("interval 24 hours"))).agg(F.count(F.lit(1)).alias("queries_24h"))
    c = chunks.join(live.select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("chunks"))
    return a.crossJoin(b).crossJoin(c)  # a row each


def ingestion_history(docs: DataFrame, now: Column, col: str = "collected_at") -> DataFrame:
    """Documents an hour over the last day, hours without any left out."""
    recent = docs.filter((F.col(col) > now - F.expr("interval 24 hours")) & (F.col(col) <= now))
    return recent.groupBy(F.date_trunc("hour", col).alias("bucket")).agg(F.count(F.lit(1)).alias("count")).orderBy("bucket")


def recent_activity(events: DataFrame, docs: DataFrame, mode: str = "ALL", limit: int = 50) -> DataFrame:
    """The newest events with title, kind and document name."""
    rows = events
    if mode == "INGEST":
        rows = rows.filter(F.col("stage").isin(*STAGES))
    elif mode == "QUERY":
        rows = rows.filter("stage = 'GENERATE'")
    elif mode == "ERROR":
        rows = rows.filter(F.col("status").isin("ERROR", "FAIL", "WARN"))
    top = rows.orderBy(F.desc("ts"), "event_id").limit(limit).join(docs.select("doc_id", "uri"), "doc_id", "left")
    said = lambda k: F.nullif(F.get_json_object("details_json", f"$.{k}"), F.lit(""))
    stage = F.col("stage")
    title = (
        F.when(stage == "GENERATE", F.coalesce(said("q"), F.lit("User Query"))).when(stage == "STORED", F.coalesce(said("filename"), "uri", F.lit("File Upload"))).when(stage == "NORMALIZED", F.lit("Normalized Document"))
        .when(stage == "CHUNKED", F.concat(F.lit("Chunked ("), F.coalesce(said("chunks"), F.lit("None")), F.lit(" parts)"))).when(stage == "EMBEDDED", F.concat(F.lit("Embedded ("), F.coalesce(said("count"), F.lit("None")), F.lit(" vectors)"))).otherwise(F.concat(F.lit("System: "), stage))
    )
    kind = F.when(stage == "GENERATE", "query").when(stage == "STORED", "ingest").when(stage.isin(*STAGES[1:]), "process").otherwise("system")
    name = F.element_at(F.split(F.coalesce(said("filename"), "uri"), "/"), -1)
    return top.select("event_id", "doc_id", "stage", "status", "ts", title.alias("title"), kind.alias("type"), name.alias("document_name"))


def pipeline_summary(events: DataFrame, limit: int = 20, timings: str = "$.timings") -> DataFrame:
    """(step, records, avg_ms): average of each timing over the last ``limit`` pipeline events."""
    last = events.filter("stage = 'PIPELINE'").orderBy(F.desc("ts"), "event_id").limit(limit)
    rows = last.select(F.explode(F.from_json(F.get_json_object("details_json", timings), "map<string,double>")).alias("step", "ms"))
    return rows.filter("ms is not null").groupBy("step").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("ms"), 2).alias("avg_ms"))


def list_documents(docs: DataFrame, limit: int = 1000) -> DataFrame:
    """Live documents, newest first."""
    return docs.filter("state <> 'DELETED'").orderBy(F.desc("collected_at"), "doc_id").limit(min(limit, 1000))


def pipeline_status(docs: DataFrame, normalized: DataFrame, blocks: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Which steps each document has been through, by the existence of rows."""
    out = docs.select("doc_id")
    for name, rows in (("normalized", normalized), ("extracted", blocks), ("chunked", chunks), ("embedded", index)):
        out = out.join(rows.select("doc_id").distinct().withColumn(f"_{name}", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(f"_{n}", F.lit(False)).alias(n) for n in ("normalized", "extracted", "chunked", "embedded")])


def document_progress(events: DataFrame) -> DataFrame:
    """(doc_id, stage, has_error, progress): latest event, any error, furthest stage of five."""
    step = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0))
    rows = events.filter("doc_id is not null").withColumn("_step", step)
    return rows.groupBy("doc_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.bool_or(F.col("status").isin("ERROR", "FAIL")).alias("has_error"), (F.max("_step") / 5).alias("progress"))


def job_progress(events: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(job_id, done, size, progress): documents processed of those in the job, in percent."""
    done = events.groupBy("job_id").agg(F.countDistinct(F.when(F.col("status").isin("OK", "WARN"), F.col("doc_id"))).alias("done"), F.countDistinct("doc_id").alias("seen"))
    out = done.join(sizes, "job_id", "left") if sizes is not None else done.withColumn("size", F.col("seen"))
    return out.select("job_id", "done", "size", F.round(100 * F.col("done") / F.greatest(F.lit(1), F.col("size")), 2).alias("progress"))


def soft_delete(docs: DataFrame, ids: DataFrame, tenant_id: str) -> DataFrame:
    """Documents with those of ``ids`` (doc_id) that are the tenant's marked DELETED."""
    gone = ids.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    out = docs.join(gone, "doc_id", "left")
    return out.withColumn("state", F.when(F.coalesce("_gone", F.lit(False)) & (F.col("tenant_id") == tenant_id), "DELETED").otherwise(F.col("state"))).drop("_gone").select(*docs.columns)


def wipe_tenant(tables: dict[str, DataFrame], tenant_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the tenant's rows, and (table, deleted). Tables with a tenant_id go by it,
    tables with a doc_id by their document, tables with an invoice_id or contract_id likewise."""
    docs = tables["documents"]
    gone = docs.filter(F.col("tenant_id") == tenant_id).select("doc_id").distinct()
    kept, counts = {}, None
    for name, df in tables.items():
        if "tenant_id" in df.columns:
            out, lost = df.filter(F.coalesce(F.col("tenant_id") != tenant_id, F.lit(True))), df.filter(F.col("tenant_id") == tenant_id)
        else:
            key = next(k for k in ("doc_id", "invoice_id", "contract_id") if k in df.columns)
            ids = gone.withColumnRenamed("doc_id", key)
            out, lost = df.join(ids, key, "left_anti"), df.join(ids, key, "left_semi")
        kept[name] = out
        n = lost.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def storage_keys(docs: DataFrame, norms: DataFrame) -> DataFrame:
    """(doc_id, uri, blob_key, canonical_uri)"""
    return docs.select("doc_id", "uri", blob_key(F.col("sha256")).alias("blob_key")).join(norms.select("doc_id", "canonical_uri"), "doc_id", "left")


def latest_plan(plans: DataFrame) -> DataFrame:
    """The newest plan of each document; ties to the greater plan_id."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("created_at"), F.desc("plan_id")))
    return plans.withColumn("_n", n).filter("_n = 1").drop("_n")


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("doc_id", "span_start")


def find_documents(docs: DataFrame, q: str) -> DataFrame:
    """Live documents whose file name holds ``q``, case ignored."""
    name = F.element_at(F.split("uri", "/"), -1)
    return docs.filter("state <> 'DELETED'").withColumn("filename", name).filter(F.contains(F.lower("filename"), F.lit(q.lower())))


def rate_guard(events: DataFrame, most: int = 120, client: str = "user_id") -> DataFrame:
    """(client, window_start, n, limited) of each client and minute."""
    return events.groupBy(F.col(client).alias("client"), F.date_trunc("minute", "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("n")).withColumn("limited", F.col("n") > most)

"""Ingest: hashing, policy checks, deduplication, events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.hosts import host_of, with_not_public
from ..functions.keys import blob_key, url_basename, with_content_hash

#: Extensions and their types.
MIME = {
    "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json",
    "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff", "zip": "application/zip",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
OCTETS = "application/octet-stream"


@dataclass(frozen=True)
class Policy:
    """Limits of what is taken in."""

    max_name: int = 200
    denied: tuple[str, ...] = (".js", ".exe", ".sh", ".bat", ".dll", ".msi", ".apk", ".bin")
    max_bytes: int = 50 * 1024 * 1024
    allowed_mime: tuple[str, ...] = ("application/", "text/", "image/")
    max_files: int = 10


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, filename, length, modified, content) of every file below ``path`` that has any bytes: Spark's
    file sources leave empty ones out. Those are for :func:`check_ingest`, by the sizes that are declared."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.col("modificationTime").alias("modified"), "content")


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^./\\]+)$", 1))


def guessed_mime(filename: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(table[extension(filename)], F.lit(OCTETS))


def with_mime(df: DataFrame, declared: str = "declared_mime", filename: str = "filename") -> DataFrame:
    """Adds ``mime``: what was declared unless that says nothing, else by extension."""
    said = F.nullif(F.nullif(F.trim(F.col(declared)), F.lit("")), F.lit(OCTETS))
    return df.withColumn("mime", F.coalesce(said, guessed_mime(F.col(filename))))


def check_ingest(df: DataFrame, policy: Policy = Policy(), strict: bool = False, batch_col: str | None = None) -> DataFrame:
    """Adds ``state``, ``reason`` and ``warnings`` from filename, mime and size_bytes.

    Rules in order: name too long, extension denied, empty, too large, type not allowed. Empty
    files are always rejected, the rest only if ``strict``; else each is a warning. A batch of
    too many files is rejected whole. Null counts as an empty name, no size, no type.
    """
    name, size, mime = F.coalesce("filename", F.lit("")), F.coalesce("size_bytes", F.lit(0)), F.coalesce("mime", F.lit(""))
    allowed = F.lit(False)
    for p in policy.allowed_mime:
        allowed = allowed | mime.startswith(p)
    rules = [
        ("filename_too_long", F.length(name) > policy.max_name),
        ("extension_denied", F.concat(F.lit("."), extension(name)).isin(*policy.denied)),
        ("empty_file", size == 0),
        ("file_too_large", size > policy.max_bytes),
        ("mime_not_allowed", ~allowed),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(what)) for what, test in rules]))
    out = df.withColumn("_broken", broken)
    if batch_col:
        too_many = F.count(F.lit(1)).over(Window.partitionBy(batch_col)) > policy.max_files
    else:
        too_many = F.lit(False)
    reason = F.when(too_many, F.lit("too_many_files")).when(F.lit(strict), F.get("_broken", F.lit(0))).when(F.array_contains("_broken", "empty_file"), F.lit("empty_file"))
    out = out.withColumn("reason", reason)
    return out.withColumns({"state": F.when(F.col("reason").isNotNull(), "REJECTED").otherwise("STORED"), "warnings": F.when(F.col("reason").isNull(), F.col("_broken")).otherwise(F.array().cast("array<string>"))}).drop("_broken")


def dedupe_documents(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``duplicate`` and ``original_id``: the first document (least doc_id) of the tenant with
    the same hash, an existing live one before any new one. Deleted documents don't count.

    A hash of many copies is reduced to its least id before it is joined back.
    """
    keys = ["tenant_id", "sha256"]
    first = new.groupBy(keys).agg(F.min("doc_id").alias("_first"))
    if existing is not None:
        live = existing.filter("state <> 'DELETED'").groupBy(keys).agg(F.min("doc_id").alias("_known"))
        first = first.join(live, keys, "left").select(*keys, F.coalesce("_known", "_first").alias("_first"))
    out = new.join(first, keys, "left")
    return out.withColumn("original_id", F.coalesce("_first", "doc_id")).withColumn("duplicate", F.col("original_id") != F.col("doc_id")).drop("_first")


def check_mime_extension(df: DataFrame) -> DataFrame:
    """Adds ``mime_warning`` where type and extension disagree; an unknown extension never does."""
    by_name = guessed_mime(F.col("filename"))
    return df.withColumn("mime_warning", F.when((by_name != OCTETS) & (by_name != F.col("mime")), F.concat(F.lit("mime_mismatch:"), F.col("mime"), F.lit("!="), by_name)))


def check_blob_sizes(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Documents whose stored blob is missing or of another size."""
    sized = blobs.select("sha256", F.col("length").alias("stored_bytes"))
    return docs.join(sized, "sha256", "left").filter(F.col("stored_bytes").isNull() | (F.col("stored_bytes") != F.col("size_bytes"))).select("doc_id", "sha256", "size_bytes", "stored_bytes")


def flag_unsafe_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``unsafe_reason``: no host, or a literal address that isn't public, in any spelling that systems read
    (``127.1``, ``0x7f000001``, ``[::ffff:7f00:1]``). Names aren't resolved."""
    host = F.col("_host")
    out = with_not_public(df.withColumn("_host", host_of(F.col(url))), "_host", "unsafe_reason")
    named = F.when(host == "", "no_host").when((host == "localhost") | host.endswith(".localhost"), "loopback")
    return out.withColumn("unsafe_reason", named.otherwise(F.col("unsafe_reason"))).drop("_host")


def to_events(df: DataFrame, stage: str, status: str | Column, details: list[str], ts: Column) -> DataFrame:
    """Rows of the event log: one for each row of ``df`` (tenant_id, doc_id)."""
    said = F.to_json(F.struct(*details))
    status = F.lit(status) if isinstance(status, str) else status
    return df.select(F.sha2(F.concat_ws("\x1f", "tenant_id", "doc_id", F.lit(stage), ts.cast("string"), said), 256).alias("event_id"), "tenant_id", "doc_id", F.lit(stage).alias("stage"), status.alias("status"), F.lit(1).alias("attempt"), ts.cast("timestamp").alias("ts"), said.alias("details_json"))


def feedback_events(df: DataFrame) -> DataFrame:
    """Feedback (tenant_id, query_id, score, comment, ts) as events; a score is cut to -1, 0 or 1."""
    rows = df.withColumns({"doc_id": F.lit(None).cast("string"), "score": F.signum("score").cast("int")})
    return to_events(rows, "FEEDBACK", "OK", ["query_id", "score", "comment"], F.col("ts"))


def ingest(files: DataFrame, existing: DataFrame | None = None, policy: Policy = Policy(), strict: bool = False) -> DataFrame:
    """Files (tenant_id, filename, declared_mime, content) to documents: hash, type, check, dedupe."""
    rows = with_mime(with_content_hash(files))
    rows = check_ingest(rows, policy, strict).withColumn("doc_id", F.sha2(F.concat_ws("\x1f", "tenant_id", "sha256"), 256)).withColumn("uri", blob_key(F.col("sha256")))
    # Copies within a batch get one id; of them the least name stays.
    first = Window.partitionBy("doc_id").orderBy("filename")
    rows = rows.withColumn("_nth", F.row_number().over(first)).withColumn("duplicate", F.col("_nth") > 1).drop("_nth")
    if existing is not None:
        known = existing.filter("state <> 'DELETED'").select("doc_id").distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "doc_id", "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("_known", F.lit(False))).drop("_known")
    return rows


__all__ = ["MIME", "Policy", "blob_key", "check_blob_sizes", "check_ingest", "check_mime_extension", "dedupe_documents", "feedback_events", "flag_unsafe_urls", "ingest", "read_files", "to_events", "url_basename", "with_content_hash", "with_mime"]

"""Restrictions of a search: fixed columns, sets a question, date ranges, invoice numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import parse_date_range
from ..functions.text import is_numeric_question
from ..sources.stage import staged

#: Fixed value: first characters of a number by which invoices are left out.
HEAD = 8
#: Fixed value: what an invoice number looks like.
INVOICE_NUMBER = r"\b([A-Z]{2,6}[-_/]?[0-9]{2,4}[-_/]?[0-9]{1,6})\b"


def filter_corpus(df: DataFrame, tenant_id: str | None = None, types: list[str] | None = None, mime_any: list[str] | None = None, uri_like: str | None = None, filename_like: str | None = None, vendor_like: str | None = None, invoices: DataFrame | None = None) -> DataFrame:
    """Rows (chunks joined with their documents) that pass; an empty restriction passes all.
    Deleted documents never pass."""
    out = df.filter("state <> 'DELETED'")
    if tenant_id is not None:
        out = out.filter(F.col("tenant_id") == tenant_id)
    if types:
        out = out.filter(F.arrays_overlap("types", F.array(*map(F.lit, types))))
    if mime_any:
        out = out.filter(F.col("mime").isin(*mime_any))
    if uri_like:
        out = out.filter(F.contains(F.lower("uri"), F.lit(uri_like.lower())))
    if filename_like:
        out = out.filter(F.contains(F.lower("filename"), F.lit(filename_like.lower())))
    if vendor_like and invoices is not None:
        named = invoices.filter(F.contains(F.lower("vendor"), F.lit(vendor_like.lower()))).select(F.col("invoice_id").alias("doc_id"))
        out = out.join(named, "doc_id", "left_semi")
    return out


def restrict_docs(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits within their question's ``doc_ids``; a question without any keeps all its hits."""
    free = queries.filter("doc_ids is null or size(doc_ids) = 0").select("query_id")
    bound = queries.filter("size(doc_ids) > 0").select("query_id", F.explode("doc_ids").alias("doc_id"))
    return hits.join(free, "query_id", "left_semi").unionByName(hits.join(bound, ["query_id", "doc_id"], "left_semi").select(*hits.columns))


def _cut(queries: DataFrame) -> DataFrame:
    """``doc_ids`` cut to the column ``_ids``; a set that would be empty is ignored."""
    have = F.coalesce("doc_ids", F.array().cast("array<string>"))
    both = F.when(F.size(have) > 0, F.array_intersect(have, "_ids")).otherwise(F.col("_ids"))
    return queries.withColumn("doc_ids", F.when(F.col("_ids").isNotNull() & (F.size(both) > 0), both).otherwise(have)).drop("_ids")


def span_days(spans: DataFrame) -> DataFrame:
    """(span, day): the days of each different ``span`` (struct<start, end>). A span is one phrase of a
    question, so there are few, of some thousand days at most; days are keys to join by."""
    return spans.select("span").filter("span is not null").distinct().select("span", F.explode(F.sequence("span.start", "span.end")).alias("day"))


def _days(invoices: DataFrame) -> DataFrame:
    return invoices.select(F.col("invoice_id").cast("string").alias("id"), F.col("invoice_date").alias("day"))


def _dated(spans: DataFrame, invoices: DataFrame, limit: int | None) -> DataFrame:
    """(span, _ids): invoices dated in each span, sorted; of more than ``limit`` the first ones, cut
    before they are collected. Found once for each span, however many questions name it."""
    met = span_days(spans).join(_days(invoices), "day").select("span", "id").distinct()
    if limit is not None:
        met = met.withColumn("n", F.row_number().over(Window.partitionBy("span").orderBy("id"))).filter(F.col("n") <= limit)
    return met.groupBy("span").agg(F.sort_array(F.collect_list("id")).alias("_ids"))


def _tables_too(span: Column) -> Column:
    types = F.coalesce("types", F.array().cast("array<string>"))
    return F.when(span.isNotNull() & is_numeric_question(F.col("q")), F.array_union(types, F.array(F.lit("table")))).otherwise(types)


def restrict_by_date(queries: DataFrame, invoices: DataFrame, today: Column, limit: int = 1000) -> DataFrame:
    """Questions that name a time, cut to the invoices dated in it (the first ``limit``, a stated
    cut of the filter); numeric ones ask for tables too. Adds ``date_range``."""
    asked = queries.withColumn("date_range", parse_date_range(F.col("q"), today))
    found = _dated(asked.select(F.col("date_range").alias("span")), invoices, limit)
    return _cut(asked.join(found.withColumnRenamed("span", "date_range"), "date_range", "left")).withColumn("types", _tables_too(F.col("date_range"))).select(*asked.columns)


def _numbered(numbers: DataFrame, invoices: DataFrame) -> DataFrame:
    """(_number, id): the invoices that contain each of ``numbers`` (_number), which begin with a letter and end in a digit.

    A number that stands in an invoice's is a piece of it that begins with a letter. Invoices without any
    asked number's first characters are left out; the others' pieces of the asked lengths are joined
    by themselves, once for each different number.
    """
    numbers = staged(numbers.select("_number").distinct(), "numbers")
    heads = staged(numbers.select(F.substring("_number", 1, HEAD).alias("head")).distinct(), "heads")
    sizes = sorted(r[0] for r in numbers.select(F.length("_number")).distinct().collect())  # as many as a number has characters
    short = sorted({min(HEAD, n) for n in sizes})
    n = F.upper("invoice_number")
    rest = F.transform(F.filter(F.sequence(F.lit(1), F.length(n)), lambda k: F.substring(n, k, F.lit(1)).rlike("[A-Z]")), lambda k: F.substring(n, k, F.length(n)))
    rows = invoices.filter(F.length("invoice_number") > 0).select(F.col("invoice_id").cast("string").alias("id"), F.explode(F.array_distinct(rest)).alias("rest"))
    starts = rows.select("id", "rest", F.explode(F.array_distinct(F.array(*[F.substring("rest", 1, k) for k in short]))).alias("head")) if short else rows.withColumn("head", F.lit(None).cast("string"))
    some = starts.join(heads, "head", "left_semi").select("id", "rest").distinct() if len(short) > 1 else starts.join(heads, "head", "left_semi").select("id", "rest")
    pieces = some.select("id", F.explode(F.array_distinct(F.array(*[F.when(F.length("rest") >= k, F.substring("rest", 1, k)) for k in sizes] or [F.lit(None).cast("string")]))).alias("_number")).filter("_number is not null")
    return pieces.join(numbers, "_number").distinct()


def restrict_by_number(queries: DataFrame, invoices: DataFrame, limit: int | None = 50, pattern: str = INVOICE_NUMBER) -> DataFrame:
    """Questions that name an invoice number, cut to the invoices that contain it (the first ``limit`` by id, a stated
    cut of the filter, made before they are collected; None: all).

    ``pattern``: its first group is two letters at least, then digits.
    """
    number = F.regexp_extract(F.upper("q"), pattern, 1)
    # Questions without a number have a key each, so none of them is a common one.
    keyed = queries.withColumn("_number", F.when(number != "", number).otherwise(F.concat(F.lit("?"), F.coalesce(F.col("query_id").cast("string"), F.lit("")))))
    met = _numbered(keyed.filter(~F.col("_number").startswith("?")), invoices)
    if limit is not None:
        met = met.withColumn("n", F.row_number().over(Window.partitionBy("_number").orderBy("id"))).filter(F.col("n") <= limit)
    found = met.groupBy("_number").agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    return _cut(keyed.join(found, "_number", "left")).select(*queries.columns)


def _last_days(today: Column) -> Column:
    t = today.cast("date")
    return F.when(F.col("date_last_days") > 0, F.struct(F.date_sub(t, F.col("date_last_days")).alias("start"), t.alias("end")))


def restrict_last_days(queries: DataFrame, invoices: DataFrame, today: Column, limit: int = 1000) -> DataFrame:
    """Questions with ``date_last_days``, cut to the invoices of those days (the first ``limit`` by id)."""
    asked = queries.withColumn("span", _last_days(today))
    return _cut(asked.join(_dated(asked.select("span"), invoices, limit), "span", "left")).select(*queries.columns)


def restrict_to_invoices(queries: DataFrame, invoices: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """What :func:`restrict_by_date`, :func:`restrict_by_number` and :func:`restrict_last_days` do one after the other, without
    their limits: (questions, members). A question of whom any invoices are found has the name of its set in ``sets``, and no
    ``doc_ids`` any more, as those within its set are in it; members (set, doc_id) holds all of each set.

    Questions that give the same documents and name the same times and numbers share a set. Sets are rows and no arrays:
    no task and no question holds one, however many invoices a year has.
    """
    number = F.nullif(F.regexp_extract(F.upper("q"), INVOICE_NUMBER, 1), F.lit(""))
    asked = queries.withColumns({"doc_ids": F.coalesce("doc_ids", F.array().cast("array<string>")), "_span": parse_date_range(F.col("q"), today), "_number": number, "_days": _last_days(today)})
    asked = asked.withColumn("types", _tables_too(F.col("_span")))
    named = F.col("_span").isNotNull() | F.col("_number").isNotNull() | F.col("_days").isNotNull()
    # Of 128 bits: questions of one set are known by it.
    asked = asked.withColumn("_set", F.when(named, F.md5(F.to_json(F.struct(F.array_sort(F.array_distinct("doc_ids")).alias("d"), "_span", "_number", "_days")))))
    of = staged(asked.filter("_set is not null").select(F.col("_set").alias("set"), "doc_ids", "_span", "_number", "_days").dropDuplicates(["set"]), "sets")
    now = of.select("set", F.explode("doc_ids").alias("id"))
    found = of.select("set").limit(0)
    for what in ("_span", "_number", "_days"):
        some = of.filter(F.col(what).isNotNull()).select("set", what)
        if some.isEmpty():
            continue
        if what == "_number":
            new = some.join(_numbered(some, invoices), what)
        else:
            new = some.join(span_days(some.withColumnRenamed(what, "span")).withColumnRenamed("span", what), what).join(_days(invoices), "day")
        new = staged(new.select("set", "id"), "invoices")
        # A set that would be empty is ignored.
        both = new.join(now, ["set", "id"], "left_semi").unionByName(new.join(now.select("set").distinct(), "set", "left_anti"))
        both = staged(both.distinct(), "within")
        met = both.select("set").distinct()
        now, found = both.unionByName(now.join(met, "set", "left_anti")), found.unionByName(met)
    found = staged(found.distinct(), "found")
    members = staged(now.join(found, "set", "left_semi").select("set", F.col("id").alias("doc_id")), "members")
    asked = asked.join(found.withColumn("_found", F.lit(True)).withColumnRenamed("set", "_set"), "_set", "left")
    kept = F.when(F.col("_found").isNull(), F.col("doc_ids")).otherwise(F.array().cast("array<string>"))
    asked = asked.withColumns({"sets": F.when(F.col("_found"), F.array("_set")), "doc_ids": kept})
    return asked.select(*queries.columns, *[c for c in ("sets",) if c not in queries.columns]), members


#: What a question may ask of its chunks, null or empty if it doesn't. ``sets``: names of sets of documents, which chunks have too.
RESTRICTIONS = {"doc_ids": "array<string>", "sets": "array<string>", "types": "array<string>", "mime_any": "array<string>", "uri_like": "string", "filename_like": "string", "vendor_like": "string", "boost_types": "array<string>"}


def with_restrictions(queries: DataFrame) -> DataFrame:
    """``queries`` with all columns of ``RESTRICTIONS``."""
    return queries.withColumns({c: F.lit(None).cast(t) for c, t in RESTRICTIONS.items() if c not in queries.columns})


def passing(rows: DataFrame, queries: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (query_id, chunk_id, ...) whose chunk is among ``facts`` (chunk_id, doc_id, types, mime, uri, filename, vendor) and
    passes its question's restrictions; parts of names match in any case."""
    ask = with_restrictions(queries).select("query_id", *[F.col(c).alias(f"_{c}") for c in RESTRICTIONS if c != "boost_types"])
    j = rows.select("query_id", "chunk_id").join(facts, "chunk_id").join(ask, "query_id")
    free = lambda c: F.coalesce(F.size(f"_{c}"), F.lit(0)) <= 0
    okay = free("doc_ids") | F.array_contains("_doc_ids", F.col("doc_id"))
    if "sets" in facts.columns:
        okay = okay & (free("sets") | F.arrays_overlap("sets", "_sets"))
    okay = okay & (free("types") | F.arrays_overlap("types", "_types")) & (free("mime_any") | F.array_contains("_mime_any", F.col("mime")))
    for c, like in (("uri", "_uri_like"), ("filename", "_filename_like"), ("vendor", "_vendor_like")):
        okay = okay & ((F.coalesce(like, F.lit("")) == "") | F.contains(F.lower(c), F.lower(like)))
    return rows.join(j.filter(F.coalesce(okay, F.lit(False))).select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")

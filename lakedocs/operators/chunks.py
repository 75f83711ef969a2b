"""From blocks to token-bounded, overlapping passages.

chunk: chunk_id, doc_id, ordinal, span_start, span_end, page_start, page_end, text, meta, checksum
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import stable_id
from ..functions.text import est_tokens, norm_text
from .blocks import with_header_chain

TARGET, OVERLAP, TINY, ORPHAN, MOST = 800, 120, 600, 50, 5000
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " "]
META = "struct<types:array<string>,source_block_ids:array<string>,tokens:int,strategy:string,context_headers:array<string>,rows:int,cols:int,html:string>"


def _strategy(tables: Column, chars: Column) -> Column:
    return F.when(tables > 0, "layout").when(chars < TINY, "tiny").otherwise("section")


def _target(blocks: Column, code: Column, lists: Column, target: int) -> Column:
    least = F.when(code > 0, F.greatest(F.lit(300), F.lit(int(0.8 * target)))).otherwise(F.lit(target))
    return F.when(lists >= F.greatest(F.lit(2), F.floor(blocks * 0.2)), F.greatest(F.lit(350), F.floor(least * 0.85))).otherwise(least).cast("int")


def _of_type(kind: str) -> Column:
    return F.count_if(F.col("type") == kind)


def plan_chunks(blocks: DataFrame) -> DataFrame:
    """One plan a document: how to chunk it, and its sizes."""
    total, table = F.sum(F.length("text")), F.coalesce(F.sum(F.when(F.col("type") == "table", F.length("text"))), F.lit(0))
    plans = blocks.groupBy("doc_id").agg(total.alias("total_chars"), table.alias("table_chars"), F.count_if(F.col("type") == "table").alias("tables"), F.min("page").alias("p1"), F.max("page").alias("p2"), F.count(F.lit(1)).alias("block_count"))
    strategy = _strategy(F.col("tables"), F.col("total_chars"))
    density = F.round(F.col("table_chars") / F.greatest(F.lit(1), F.col("total_chars")), 3)
    return plans.select("doc_id", strategy.alias("strategy"), "total_chars", density.alias("table_density"), F.array("p1", "p2").alias("page_span"), "block_count")


def chunk_targets(blocks: DataFrame, target: int = TARGET) -> DataFrame:
    """(doc_id, target): less for documents with code or many lists."""
    return blocks.groupBy("doc_id").agg(_target(F.count(F.lit(1)), _of_type("code"), _of_type("list"), target).alias("target"))


def _root(filename):
    return F.when(filename.isNotNull(), F.array(F.concat(F.lit("[Document: "), filename, F.lit("]")))).otherwise(F.array().cast("array<string>"))


def chunk_tiny(blocks: DataFrame, plans: DataFrame) -> DataFrame:
    """Small documents whole: all blocks in one chunk under their distinct headers. ``blocks`` may have ``filename``."""
    rows = blocks.join(plans.filter("strategy = 'tiny'").select("doc_id"), "doc_id", "left_semi")
    name = F.max("filename") if "filename" in blocks.columns else F.lit(None).cast("string")
    parts = F.sort_array(F.collect_list(F.struct("pos", "type", "text", "block_id", F.col("meta.headers").alias("headers"))))
    got = rows.groupBy("doc_id").agg(parts.alias("p"), name.alias("filename"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    headers = F.array_distinct(F.filter(F.concat(_root(F.col("filename")), F.flatten(F.transform("p", lambda x: F.coalesce(x["headers"], F.array().cast("array<string>"))))), lambda h: h != ""))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    text = norm_text(F.concat_ws("\n\n", F.when(F.size(headers) > 0, F.array_join(headers, " / ")), body))
    meta = F.struct(F.array_sort(F.array_distinct(F.transform("p", lambda x: x["type"]))).alias("types"), F.transform("p", lambda x: x["block_id"]).alias("source_block_ids"), est_tokens(text).alias("tokens"), F.lit("tiny").alias("strategy"), headers.alias("context_headers"), *[F.lit(None).cast(t).alias(c) for c, t in (("rows", "int"), ("cols", "int"), ("html", "string"))])
    return got.filter(F.size("p") > 0).select("doc_id", F.lit(0).alias("ordinal"), "span_start", "span_end", "page_start", "page_end", text.alias("text"), meta.alias("meta"))


def chunk_tables(blocks: DataFrame, plans: DataFrame) -> DataFrame:
    """Each table of the larger documents is a chunk."""
    rows = blocks.filter("type = 'table'").join(plans.filter("strategy <> 'tiny'").select("doc_id", "strategy"), "doc_id")
    root = _root(F.col("filename")) if "filename" in blocks.columns else F.array().cast("array<string>")
    headers = F.array_distinct(F.filter(F.concat(root, F.coalesce("meta.headers", F.array().cast("array<string>"))), lambda h: h != ""))
    text = norm_text(F.concat_ws("\n\n", F.when(F.size(headers) > 0, F.array_join(headers, " / ")), "text"))
    meta = F.struct(F.array(F.lit("table")).alias("types"), F.array("block_id").alias("source_block_ids"), est_tokens(text).alias("tokens"), "strategy", headers.alias("context_headers"), "meta.rows", "meta.cols", "meta.html")
    return rows.select("doc_id", F.col("pos").alias("ordinal"), "span_start", "span_end", F.col("page").alias("page_start"), F.col("page").alias("page_end"), text.alias("text"), meta.alias("meta"))


def narrative_segments(blocks: DataFrame, plans: DataFrame) -> DataFrame:
    """(doc_id, pos, type, text, prefix, headers, tokens, ...): what is told between tables and headers."""
    told = with_told(blocks.join(plans.filter("strategy <> 'tiny'").select("doc_id", "strategy"), "doc_id"))
    out = told.filter("told <> ''").select("doc_id", "strategy", "pos", "block_id", "type", F.col("told").alias("text"), "headers", "page", "span_start", "span_end")
    return out.withColumn("tokens", est_tokens(F.col("text")))


def with_told(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``headers``, what each stands under, and ``told``, its text for a passage (null for
    headers and tables)."""
    chained = with_header_chain(blocks.drop("headers").withColumns({"level": F.col("meta.level"), "page_idx": F.lit(0)}))
    own = F.col("meta.headers")
    chain = F.when(F.size(own) > 0, own).otherwise(F.col("headers"))
    root = _root(F.col("filename")) if "filename" in blocks.columns else F.array().cast("array<string>")
    headers = F.array_distinct(F.filter(F.concat(root, chain), lambda h: h != ""))
    text = F.when(F.col("type") == "list", F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("• "), F.trim(x))), "\n")).otherwise(F.col("text"))
    return chained.withColumns({"headers": headers, "told": F.when(~F.col("type").isin("header", "table"), norm_text(text))}).drop("level", "page_idx")


def split_text(text: str, target: int, overlap: int) -> list[str]:
    """Parts of at most ``target`` tokens. No text is lost: separators stay with what they end, and a
    piece without any is cut into slices."""
    size = lambda s: math.ceil(len(s) / 4)
    if size(text) <= target:
        return [text]
    parts = None
    for sep in SEPARATORS:
        found = [x for x in re.split(f"(?<={re.escape(sep)})", text) if x]
        if len(found) > 1:
            parts = found
            break
    if parts is None:
        return [text[k : k + 4 * target] for k in range(0, len(text), 4 * target)]
    parts = [y for x in parts for y in (split_text(x, target, 0) if size(x) > target else [x])]
    out, k = [], 0
    while k < len(parts):
        j, used = k, 0
        while j < len(parts) and (j == k or used + size(parts[j]) <= target):
            used += size(parts[j])
            j += 1
        out.append("".join(parts[k:j]))
        if j >= len(parts):
            break
        back, room = j, overlap
        while back - 1 > k and size(parts[back - 1]) <= room:
            back -= 1
            room -= size(parts[back])
        k = back
    return out


def _packed(rows: list, target: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of the chunks of a document's rows (text, tokens, segment)."""
    spans, k = [], 0
    while k < len(rows):
        j, used = k, 0
        while j < len(rows) and (j == k or used + rows[j][1] <= target):
            used += rows[j][1]
            j += 1
        if spans and used < ORPHAN and spans[-1][2] < 1.2 * target:
            spans[-1] = (spans[-1][0], j, spans[-1][2] + used)
        else:
            spans.append((k, j, used))
        if j >= len(rows):
            break
        room = overlap * (0.5 if rows[k][2]["type"] in ("list", "header") else 1.5 if rows[k][1] > int(0.7 * target) else 1)
        back = j
        while back - 1 > k and rows[back - 1][1] <= room:
            back -= 1
            room -= rows[back][1]
        k = back
    return [(k, j) for k, j, _ in spans]


def _chunk_rows(segments: list[dict], overlap: int) -> list[tuple]:
    target, rows = segments[0]["target"], []
    for s in segments:
        for text in split_text(s["text"], target, 0 if s["type"] == "table" else overlap):
            rows.append((text, math.ceil(len(text) / 4), s))
    made = []
    for n, (k, j) in enumerate(_packed(rows, target, overlap)):
        part = [x[2] for x in rows[k:j]]
        heads = list(dict.fromkeys(h for s in part for h in (s["headers"] or [])))
        pages = [s["page"] for s in part if s["page"] is not None]
        body = "\n\n".join(x[0] for x in rows[k:j])
        text = " / ".join(heads) + "\n\n" + body if heads else body
        ids = list(dict.fromkeys(s["block_id"] for s in part))
        made.append((part[0]["doc_id"], n, part[0]["span_start"], max(s["span_end"] for s in part), min(pages, default=None), max(pages, default=None), text, sorted({s["type"] for s in part}), ids, math.ceil(len(text) / 4), part[0]["strategy"], heads))
    return made


def pack_segments(segments: DataFrame, targets: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Segments packed in order into chunks of at most the target, each next one starting some
    whole segments back. Packing follows a document's order, so documents are dealt out by id and
    sorted, and a task folds them one after the other, many to an Arrow batch."""
    schema = "doc_id string, ordinal int, span_start int, span_end int, page_start int, page_end int, text string, types array<string>, source_block_ids array<string>, tokens int, strategy string, context_headers array<string>"
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def fold(batches):
        held, made = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["doc_id"] != row["doc_id"]:
                    made += _chunk_rows(held, overlap)
                    held = []
                held.append(row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow.types, strict=True)], schema=arrow)
                made = []
        if held:
            made = _chunk_rows(held, overlap)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow.types, strict=True)], schema=arrow)

    cols = ["doc_id", "pos", "type", "text", "headers", "block_id", "page", "span_start", "span_end", "strategy", "target"]
    dealt = segments.join(targets, "doc_id").select(*cols).repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    packed = dealt.mapInArrow(fold, schema)
    meta = F.struct("types", "source_block_ids", "tokens", "strategy", "context_headers", *[F.lit(None).cast(t).alias(c) for c, t in (("rows", "int"), ("cols", "int"), ("html", "string"))])
    return packed.select("doc_id", "ordinal", "span_start", "span_end", "page_start", "page_end", "text", meta.alias("meta"))


def cap_per_doc(rows: DataFrame, most: int = MOST, order: tuple[str, ...] = ("span_start", "ordinal"), by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first rows of each document (a stated limit of the index)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Adds checksum (of the text) and a deterministic chunk_id."""
    out = chunks.withColumn("checksum", F.sha2("text", 256))
    return out.withColumn("chunk_id", stable_id(F.col("doc_id"), F.col("meta.strategy"), F.col("ordinal"), F.col("checksum")))


def check_chunks(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, status, warnings): coverage, largest chunk, share of very small chunks."""
    told = F.col("meta.types") != F.array(F.lit("table"))
    got = chunks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.max("meta.tokens").alias("most"), F.count_if(told).alias("told"), F.count_if(told & (F.col("meta.tokens") < 60)).alias("small"))
    have = blocks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("all"))
    j = have.join(got, "doc_id", "left")
    found = F.array_compact(F.array(F.when(F.coalesce("chars", F.lit(0)) < 0.85 * F.col("all"), "low_coverage"), F.when(F.col("most") > 1400, "oversized_chunk"), F.when(F.col("small") > 0.3 * F.col("told"), "many_small_chunks")))
    return j.select("doc_id", F.when(F.size(found) > 0, "WARN").otherwise("OK").alias("status"), found.alias("warnings"))


def _whole(rows: list[dict]) -> tuple:
    """Rows of one document as they stand, in one chunk: a tiny document, or one table."""
    heads = list(dict.fromkeys(h for r in rows for h in r["own"]))
    body = "\n\n".join(r["text"] for r in rows)
    text = " / ".join(heads) + "\n\n" + body if heads else body
    pages = [r["page"] for r in rows if r["page"] is not None]
    kinds = sorted({r["type"] for r in rows})
    first, table = rows[0], rows[0] if rows[0]["strategy"] != "tiny" else {}
    return (first["doc_id"], False, first["pos"] if table else 0, min(r["span_start"] for r in rows), max(r["span_end"] for r in rows), min(pages, default=None), max(pages, default=None), text, kinds, [r["block_id"] for r in rows], first["strategy"], heads, table.get("rows"), table.get("cols"), table.get("html"))


def _document_chunks(rows: list[dict], overlap: int, most: int) -> list[tuple]:
    """All chunks of a document's blocks, which come in order: the columns of ``FOLDED``."""
    if rows[0]["strategy"] == "tiny":
        return [_whole(rows)]
    made = [_whole([r]) for r in rows if r["type"] == "table"]
    told = [r | {"text": r["told"], "headers": r["headers"]} for r in rows if r["told"]]
    if told:
        made += [(c[0], True, *c[1:9], *c[10:], None, None, None) for c in _chunk_rows(told, overlap)]
    return sorted(made, key=lambda c: (c[3], c[2]))[:most]


FOLDED = "doc_id string, packed boolean, ordinal int, span_start int, span_end int, page_start int, page_end int, text string, types array<string>, source_block_ids array<string>, strategy string, context_headers array<string>, rows int, cols int, html string"


def chunk_documents(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """All of it: plans, tiny documents, tables, packed narrative, cap, ids. Blocks have spans.

    The same rows as :func:`chunk_tiny`, :func:`chunk_tables` and :func:`pack_segments` give, but in one
    pass: plans and header chains are windows over a document's rows, which the blocks' spans have
    brought together already, and a task folds its documents one after the other.
    """
    doc = Window.partitionBy("doc_id")
    chars, n = F.sum(F.length("text")).over(doc), F.count(F.lit(1)).over(doc)
    planned = blocks.withColumns({"strategy": _strategy(_of_type("table").over(doc), chars), "target": _target(n, _of_type("code").over(doc), _of_type("list").over(doc), target)})
    planned = with_told(planned)
    root = _root(F.col("filename")) if "filename" in blocks.columns else F.array().cast("array<string>")
    own = F.array_distinct(F.filter(F.concat(root, F.coalesce("meta.headers", F.array().cast("array<string>"))), lambda h: h != ""))
    tiny, table = F.col("strategy") == "tiny", F.col("type") == "table"
    rows = planned.select(
        "doc_id", "pos", "type", "block_id", "page", "span_start", "span_end", "strategy", "target",
        F.when(tiny | table, F.col("text")).alias("text"), F.when(tiny | table, own).alias("own"), F.when(~tiny, F.col("told")).alias("told"), F.when(~tiny, F.col("headers")).alias("headers"),
        *[F.when(table, F.col(f"meta.{c}")).alias(c) for c in ("rows", "cols", "html")],
    ).sortWithinPartitions("doc_id", "pos")
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOLDED.split(", ")])

    def fold(batches):
        held, made = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["doc_id"] != row["doc_id"]:
                    made += _document_chunks(held, overlap, most)
                    held = []
                held.append(row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow.types, strict=True)], schema=arrow)
                made = []
        if held and (made := _document_chunks(held, overlap, most)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow.types, strict=True)], schema=arrow)

    out = rows.mapInArrow(fold, FOLDED).withColumn("text", F.when(F.col("packed"), F.col("text")).otherwise(norm_text(F.col("text"))))
    meta = F.struct("types", "source_block_ids", est_tokens(F.col("text")).alias("tokens"), "strategy", "context_headers", "rows", "cols", "html").cast(META)
    return with_chunk_ids(out.select("doc_id", "ordinal", "span_start", "span_end", "page_start", "page_end", "text", meta.alias("meta")))

"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are runs of ``window`` consecutive words (an item of fewer words is one window).
A window is a set of placed shingles, and a document contains it only if it holds all of them;
so one necessary shingle finds every candidate, and the rarest one finds the fewest.

1. Documents are scanned once. A bit table of fixed size, made from all shingles of the items,
   lets through the shingles that may be an item's; they are written with their places.
2. Shingles are counted over all documents and ordered by rarity; each window's prefix is its
   rarest shingle. A window with a shingle that no document has is gone.
3. The prefix joins the written shingles; bounds on place and length drop what cannot fit.
4. What is left is verified: every shingle of the window at its own place in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import written
from .wordhash import ALNUM, shingles, slices, words

SHINGLE = 5
BITS = 1 << 26


def _grams(texts: pa.Array, widths: list[int]):
    """(number of words of each text, [(width, hash, text, place in it)]) of a slice."""
    hashes, _, _, first = words(texts, ALNUM)
    found = []
    for k in widths:
        h, at = shingles(hashes, first, k)
        text = np.searchsorted(first, at, "right") - 1
        found.append((k, h, text, at - first[text]))
    return np.diff(first), found


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window_id, item_id, n_words, offset, n_shingles, shingle): a row for each placed shingle."""
    schema = "window_id long, item_id long, n_words int, offset int, n_shingles int, shingle long"

    def cut(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(len(ids)):
                hashes, _, _, first = words(texts[low : low + 1], ALNUM)
                total = int(first[-1])
                rows = []
                if total:
                    size, width = min(window, total), min(SHINGLE, total)
                    h, _ = shingles(hashes, first, width)
                    signed = h.view(np.int64).tolist()
                    for start in range(total - size + 1):
                        part = signed[start : start + size - width + 1]
                        rows += [(task << 40 | n, ids[low], size, j, len(part), x) for j, x in enumerate(part)]
                        n += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["window_id", "item_id", "n_words", "offset", "n_shingles", "shingle"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    documents: row_key, doc_id, n_words, a row for each row of ``docs``, written.
    spans: row_key, doc_id, start, end (words, end excluded), item_id, of the verified windows.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
    Null text has no words; so has an item of null text, which matches nothing. Ids may be null
    or repeated: rows are told apart by ``row_key``. Copies of an item are items of their own.
    """
    spark = docs.sparkSession
    placed = written(item_windows(items, window, item_id_col, item_text_col), "windows")
    some = placed.selectExpr("cast(shiftrightunsigned(shingle, 38) as int) as bit").groupBy(F.expr("shiftright(bit, 3)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, bit & 7))").alias("v")).toPandas()  # BITS / 8 rows at most
    bits = np.zeros(BITS // 8, np.uint8)
    bits[some["byte"].to_numpy(np.int64)] = some["v"].to_numpy(np.uint8)
    widths = [r["w"] for r in placed.select(F.least(F.lit(SHINGLE), "n_words").alias("w")).distinct().collect()]  # SHINGLE rows at most
    shared = spark.sparkContext.broadcast(bits)  # BITS / 8 bytes, however many items there are
    schema = "row_key long, doc_id long, n_words long, places array<int>, shingles array<long>"

    def scan(batches):
        table, task, row = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, high in slices(batch.column(1)):
                n, found = _grams(batch.column(1)[low:high], widths)
                text, place, shingle = [np.concatenate(x) if x else np.empty(0, np.int64) for x in ([f[2] for f in found], [f[3] for f in found], [f[1] for f in found])]
                shingle = shingle.astype(np.uint64)
                bit = (shingle >> np.uint64(38)).astype(np.int64)
                keep = np.flatnonzero(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                keep = keep[np.lexsort((place[keep], text[keep]))]
                at = np.searchsorted(text[keep], np.arange(high - low + 1))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for x in (pa.array(place[keep], pa.int32()), pa.array(shingle[keep].view(np.int64)))]
                keys = pa.array((task << 40) + row + np.arange(high - low))
                row += high - low
                yield pa.RecordBatch.from_arrays([keys, batch.column(0)[low:high], pa.array(n, pa.int64()), *lists], ["row_key", "doc_id", "n_words", "places", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = written(rows.mapInArrow(scan, schema), "scanned")
    held = scanned.filter(F.size("places") > 0).select("row_key", "n_words", F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("shingles").alias("shingle"))).alias("x")).select("row_key", "n_words", "x.place", "x.shingle")

    # Rarity over all documents; a window that has a shingle of no document is out.
    known = placed.select("shingle").distinct()
    counts = written(held.join(known, "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "rarity")
    ranked = placed.join(counts, "shingle").withColumn("have", F.count(F.lit(1)).over(Window.partitionBy("window_id"))).filter("have = n_shingles")
    prefix = ranked.groupBy("window_id", "item_id", "n_words").agg(F.min_by(F.struct("offset", "shingle"), F.struct("n", "offset")).alias("p")).select("window_id", "item_id", F.col("n_words").alias("len"), "p.offset", "p.shingle")
    prefix = written(prefix, "prefix")
    candidates = held.join(prefix, "shingle").withColumn("start", F.col("place") - F.col("offset")).filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    # Windows of equal words are verified once, under the least window id.
    same = placed.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("offset", "shingle"))).alias("all")).withColumn("twin", F.min("window_id").over(Window.partitionBy("all"))).select("window_id", "twin")
    same = written(same, "twins")
    unique = candidates.join(same, "window_id").select("row_key", "twin", "start", "len").distinct()
    wanted = unique.join(placed.select(F.col("window_id").alias("twin"), "offset", "shingle", "n_shingles"), "twin").withColumn("place", F.col("start") + F.col("offset"))
    seen = wanted.join(held.select("row_key", "place", "shingle"), ["row_key", "place", "shingle"])
    verified = seen.groupBy("row_key", "twin", "start", "len", "n_shingles").agg(F.countDistinct("place").alias("got")).filter("got = n_shingles")
    items_of = same.join(placed.select("window_id", "item_id").distinct(), "window_id").select("twin", "item_id").distinct()
    spans = verified.select("row_key", "twin", "start", (F.col("start") + F.col("len")).alias("end"))
    documents = scanned.select("row_key", "doc_id", "n_words")
    found = spans.join(items_of, "twin").join(documents.drop("n_words"), "row_key")
    return documents, written(found.select("row_key", "doc_id", "start", "end", "item_id"), "spans")


def report(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """A row for each document: words, words inside a hit, items that hit."""
    by_start = Window.partitionBy("row_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    merged = spans.select("row_key", "start", "end").distinct().withColumn("reach", F.coalesce(F.max("end").over(by_start), F.lit(0)))
    hit = merged.groupBy("row_key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).cast("long").alias("n_hit"))
    items = spans.select("row_key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row_key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    none = F.sha2(F.lit(""), 256)
    return (
        documents.join(hit.join(items, "row_key", "left"), "row_key", "left")
        .select("row_key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).drop("row_key")


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    "op6_benchmark_decontamination": f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
i as (select item_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
iw as (select item_id, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s, w from i where len(w) > 0),
win as (select distinct item_id, n, list_aggregate(w[s : s + n - 1], 'string_agg', ' ') as g from iw),
sizes as (select distinct n from win),
dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as s, w from d, sizes where len(w) >= n),
hits as (select dw.doc_id, dw.s, dw.n, win.item_id from dw join win on dw.n = win.n and list_aggregate(dw.w[dw.s : dw.s + dw.n - 1], 'string_agg', ' ') = win.g),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, sha256(string_agg(k, ',' order by k)) as h from (select distinct doc_id, item_id::varchar as k from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)""",
}

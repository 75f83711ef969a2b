"""SimHash fingerprints of documents, and permuted block tables that find all within a radius.

All of it is DataFrame functions. A term's 64-bit hash votes on 64 signed bits with the term's
weight. Sixteen sums count the votes, four bits to a sum: bits j, j+16, j+32 and j+48 of a hash
are the lanes of ``(hash >>> j) & 0x0001000100010001``. A lane holds 15 bits, so a text's words
are summed in runs of ``RUN`` and the runs are unpacked before they are added up.
"""

from __future__ import annotations

from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import written

LANES = 0x0001000100010001
RUN, HEAVIEST = 4096, 7


def terms(text: Column) -> Column:
    """Lower-cased words between white space; weights grow with length, as short words are common."""
    return F.split(F.lower(text), r"\s+")


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, fingerprint long): a row for each row of ``rows``, whose keys must be unique.

    Null and empty texts, and texts of white space, have no terms and the fingerprint 0. Equal
    texts have equal fingerprints. Vote ties leave the bit 0. Other columns are not read.
    """
    words = rows.select(*keys, F.posexplode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "term"))
    words = words.select(*keys, F.shiftright("pos", 12).alias("_run"), F.xxhash64("term").alias("_h"), F.when(F.col("term") == "", 0).otherwise(F.least(F.lit(HEAVIEST), F.greatest(F.lit(1), F.length("term") - 2))).cast("long").alias("_w"))
    lanes = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(LANES)) * F.col("_w")).alias(f"_s{j}") for j in range(16)]
    runs = words.groupBy(*keys, "_run").agg(F.sum("_w").alias("_w"), *lanes)
    one = lambda i: F.shiftrightunsigned(f"_s{i % 16}", 16 * (i // 16)).bitwiseAND(F.lit(0xFFFF))
    votes = runs.groupBy(*keys).agg(F.sum("_w").alias("_w"), *[F.sum(one(i)).alias(f"_v{i}") for i in range(64)])
    bits = [F.when(F.col(f"_v{i}") * 2 > F.col("_w"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return votes.select(*keys, out.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of differing bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_tables(fp: str, radius: int, blocks: int) -> Column:
    """The keys of a fingerprint: each choice of ``blocks - radius`` blocks, hashed with its number.

    Fingerprints that differ in at most ``radius`` bits agree on the blocks of some choice.
    """
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for n, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        out.append(F.xxhash64(F.lit(n), F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*out)


def within_radius(queries: DataFrame, rows: DataFrame, query_key: str, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query key, fingerprint, distance): every different fingerprint of ``rows`` within ``radius``
    bits of the query's. Each fingerprint is indexed once however many rows have it."""
    assert 0 <= radius < blocks <= 16
    index = rows.select("fingerprint").filter("fingerprint is not null").distinct().withColumn("_key", F.explode(block_tables("fingerprint", radius, blocks)))
    asked = queries.select(query_key, F.col("fingerprint").alias("_q")).filter("_q is not null")
    asked = asked.withColumn("_key", F.explode(block_tables("_q", radius, blocks)))
    near = asked.join(index, "_key").withColumn("distance", F.bit_count(F.col("_q").bitwiseXOR(F.col("fingerprint"))))
    return near.filter(F.col("distance") <= radius).select(query_key, "fingerprint", "distance").distinct()


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, next_key, doc_id, text, next_text): each document with the next in ascending id
    order, the last with the first. Null text counts as empty, a null id comes first, equal ids
    follow one another in order of their texts' hashes. Other columns go. An empty table has no rows,
    and a single document follows itself.

    Documents go to many ranges of ids, and the first of each range goes to the range before it
    too: no window spans more than a range. An id that several bounds name, as it has so many of the
    rows, has as many ranges, by its texts' hashes. The driver sees the ranges' bounds only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(place, [k / n for k in range(1, n)], F.lit(50 * n))).first()[0] or []
    bounds = sorted(bounds)
    step = isqrt(len(bounds)) + 1
    coarse, fine = F.array(*[F.lit(x) for x in bounds[::step]]), F.array(*[F.lit(x) for x in bounds])

    def bounds_where(fits) -> Column:
        """How many bounds, the first ones, ``fits`` holds for."""
        low = F.greatest(F.size(F.filter(coarse, fits)) - 1, F.lit(0))
        return low * step + F.size(F.filter(F.slice(fine, low * step + 1, F.lit(step)), fits))

    rows = rows.withColumn("_at", place).withColumn("_h", F.xxhash64("text"))
    upto = bounds_where(lambda x: x <= F.col("_at")) if bounds else F.lit(0)
    if len(set(bounds)) < len(bounds):
        rows = rows.withColumn("_upto", upto).withColumn("_own", F.col("_upto") - bounds_where(lambda x: x < F.col("_at")))
        share = F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_own"))
        upto = F.when(F.col("_own") > 1, F.col("_upto") - F.col("_own") + 1 + F.least(share, F.col("_own") - 1)).otherwise(F.col("_upto"))
    rows = rows.withColumn("_bucket", upto.cast("long")).drop("_upto", "_own")
    starts = rows.groupBy("_bucket").agg(F.min(F.struct("_at", "_h")).alias("s")).select("_bucket", "s.*").collect()  # a row for each range
    firsts = sorted(map(tuple, starts))
    before = [(at, h, firsts[k - 1][0]) for k, (_, at, h) in enumerate(firsts)]
    ghosts = spark.createDataFrame(before, "_at long, _h long, _ghost long")
    sent = rows.join(F.broadcast(ghosts), ["_at", "_h"], "left").withColumn("_to", F.explode(F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")), F.when(F.col("_ghost").isNotNull(), F.struct(F.col("_ghost").alias("b"), F.lit(True).alias("g")))))))
    sent = sent.select("doc_id", "_at", "text", "_bucket", F.col("_to.b").alias("_in"), F.col("_to.g").alias("_g"))
    order = Window.partitionBy("_in").orderBy("_g", "_at", F.xxhash64("text"), "text")
    nth = F.row_number().over(order) - 1
    key = F.shiftleft("_in", 40) + nth
    next_key = F.when(F.lead("_g").over(order), F.shiftleft(F.lead("_bucket").over(order), 40)).otherwise(key + 1)
    return sent.select(key.alias("row_key"), next_key.alias("next_key"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "_g").filter("not _g").drop("_g")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = followed(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    # One pass over the texts: what is known of a document rides along as part of its key.
    facts = ["row_key", "next_key", "doc_id", "n_chars", "edited_sha256"]
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    texts = both.select(*facts, F.posexplode(F.array("text", "edited")).alias("which", "body"))
    prints = fingerprints(texts, [*facts, "which"], "body")
    own, other = [F.max(F.when(F.col("which") == k, F.col("fingerprint"))) for k in (0, 1)]
    known = written(prints.groupBy(*facts).agg(own.alias("fp"), other.alias("edited_fp")), "simhash")
    following = known.select(F.col("row_key").alias("next_key"), F.col("fp").alias("next_fp"))
    # A search asks for the documents whose id is divisible by 100, against all.
    own = known.select("row_key", "doc_id", F.col("fp").alias("fingerprint"))
    near = within_radius(own.filter("doc_id % 100 = 0"), own, "row_key").filter("distance > 0").groupBy("row_key").agg(F.sort_array(F.collect_list("fingerprint")).alias("near"))
    out = known.join(following, "next_key").join(near, "row_key", "left")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.coalesce(F.array_join(F.transform("near", hexed), ","), F.lit(""))).alias("fingerprints_within_3"),
    )


QUERIES = {"op9_simhash": op9_simhash}

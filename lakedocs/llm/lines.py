"""Line deduplication on the suffix array of the corpus's line sequences.

A document is the sequence of its lines that are not blank; the corpus is all these sequences.
Documents with equal texts are one sequence from here on: their copies are repeated whole.

1. Doubling. ``prefixes`` ranks suffixes by their first 1, 2, 4, ... lines. Ranks keep the order
   of the suffix array: two suffixes have one rank after round k exactly if they share 2**k lines,
   and only those go on to the next round, until none is left.
2. Intervals. Suffixes of one rank are an interval of the array with a longest common prefix of
   2**k lines at least. ``intervals`` finds the exact prefix: an interval's members are told apart
   by ranks of 2**(k-1), 2**(k-2), ... more lines. Of each narrower interval the first occurrence
   stands for it in the wider one, so there are never more than two rows a suffix.
3. In the end a row is a suffix in the deepest interval in which it isn't the first occurrence:
   its maximal repeated run is that interval's common prefix, and the interval's first occurrence
   is the copy that stays. Runs of ``min_lines`` lines and ``min_chars`` characters are deleted.

DataFrame functions only. A common line or run is a key that is counted before it is joined;
the few keys with a five-hundredth of all rows each are joined apart, so none fills a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import keyed, set_aside, spread_join, written

#: Characters of blank lines, beside the line feed: Unicode's white space and separators.
WHITE = "".join(map(chr, [9, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
AT = ["_key", "nth"]


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE)) == ""


def sequences(docs: DataFrame, text_col: str) -> DataFrame:
    """(_key, first, lines): the lines that are not blank, with their places in the text, and
    whether no lesser key has the same text. Written. Null text has no row."""
    text = F.col(text_col).cast("string")
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("body")))
    told = F.filter(numbered, lambda s: ~is_blank(s["body"]))
    hashed = F.transform(told, lambda s: F.struct(s["line"].alias("line"), F.length(s["body"]).alias("chars"), F.xxhash64(s["body"]).alias("a"), F.xxhash64(s["body"], F.lit("b")).alias("b")))
    rows = docs.filter(text.isNotNull()).select("_key", F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("b")).alias("b"), hashed.alias("lines"))
    rows = written(rows.filter(F.size("lines") > 0), "sequences")
    first = rows.groupBy("a", "b").agg(F.min("_key").alias("_key")).select("_key", F.lit(True).alias("first"))
    return rows.join(first, "_key", "left").select("_key", F.coalesce("first", F.lit(False)).alias("first"), "lines")


def ranked(counts: DataFrame, order: list[str]) -> DataFrame:
    """``counts`` with ``rank``, a long in the order of ``order``. Written."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(counts.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def prefixes(rows: DataFrame) -> list[DataFrame]:
    """A table for each k: (_key, nth, rank, first) of the suffixes whose first 2**k lines are those
    of another suffix too, and whether theirs is the first occurrence. All written.

    rows: _key, nth, line, chars, a, b. Table 0 has line, chars and ``before`` too: the characters
    of the document's rows of this table before it.
    """
    where = F.min(F.struct(*AT)).alias("at")
    n = F.count(F.lit(1)).alias("n")
    counts = ranked(rows.groupBy("a", "b").agg(n, where).filter("n > 1"), ["a", "b"])
    first = (F.struct(*AT) == F.col("at")).alias("first")
    met = spread_join(rows, counts, ["a", "b"])
    sums = F.coalesce(F.sum("chars").over(Window.partitionBy("_key").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = [written(met.select(*AT, "line", "chars", sums.alias("before"), "rank", first), "prefixes")]
    while True:
        step = 1 << (len(out) - 1)
        ahead = F.first("rank").over(Window.partitionBy("_key").orderBy("nth").rangeBetween(step, step))
        pairs = written(out[-1].select(*AT, F.col("rank").alias("x"), ahead.alias("y")).filter("y is not null"), "pairs")
        counts = ranked(pairs.groupBy("x", "y").agg(n, where).filter("n > 1"), ["x", "y"])
        sizes = counts.agg(F.sum("n"), F.max("n")).first()
        if sizes[0] is None:
            return out
        out.append(written(spread_join(pairs, counts, ["x", "y"], sizes=sizes).select(*AT, "rank", first), "prefixes"))


def intervals(tables: list[DataFrame]) -> DataFrame:
    """(_key, nth, src_key, src_nth, lines): of each suffix that shares lines with an earlier one
    the longest such prefix, and the first occurrence of that prefix.

    The members of an interval are called by its first occurrence (src) and depth (lines).
    """
    now = None
    for k in range(len(tables) - 1, -1, -1):
        if now is not None:  # told apart by 2**k more lines
            step = 1 << k
            more = tables[k].select("_key", F.col("nth").alias("_at"), F.col("rank").alias("y"))
            look = written(now.withColumn("_at", F.col("nth") + F.col("lines")).join(more, ["_key", "_at"], "left").drop("_at"), "look")
            names = ["src_key", "src_nth", "lines", "y"]
            inner = look.filter("y is not null").groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*AT)).alias("at")).filter("n > 1")
            got = spread_join(look, written(inner, "inner"), names, "left")
            wide = F.struct("src_key", "src_nth", "lines")
            deep = F.struct(F.col("at._key").alias("src_key"), F.col("at.nth").alias("src_nth"), (F.col("lines") + step).alias("lines"))
            both = F.when(F.col("n").isNull(), F.array(wide)).when(F.struct(*AT) == F.col("at"), F.array(wide, deep)).otherwise(F.array(deep))
            now = got.select(*AT, F.explode(both).alias("i")).select(*AT, "i.*")
        here = tables[k]
        if k + 1 < len(tables):  # of a deeper interval the first occurrence alone
            longer = tables[k + 1].select(*AT, F.col("first").alias("stands"))
            here = here.join(longer, AT, "left").filter("stands is null or stands")
        classes = written(here.select(*AT, "rank"), "members")
        several = classes.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*AT)).alias("at")).filter("n > 1")
        own = spread_join(classes, written(several, "several"), ["rank"]).select(*AT, F.col("at._key").alias("src_key"), F.col("at.nth").alias("src_nth"), F.lit(1 << k).cast("long").alias("lines"))
        now = written(own if now is None else now.unionByName(own), "intervals")
    return now.filter("_key <> src_key or nth <> src_nth")


def repeated_runs(docs: DataFrame, min_lines: int, min_chars: int, text_col: str) -> DataFrame:
    """(_key, start, end, lines, src_key): maximal repeated runs that are not the first copy, by the
    places of their first and last lines in the text. ``docs`` has ``_key``. Written.

    Runs of one document may overlap; a document that is a copy as a whole has one run (its
    src_key is null).
    """
    seqs = sequences(docs, text_col)
    rows = written(seqs.filter("first").select("_key", F.posexplode("lines").alias("nth", "l")).select("_key", F.col("nth").cast("long").alias("nth"), "l.*"), "lines")
    tables = prefixes(rows)
    place = tables[0].select("_key", "nth", "line", "before", (F.col("before") + F.col("chars")).alias("after"))
    runs = intervals(tables).filter(F.col("lines") >= min_lines).withColumn("last", F.col("nth") + F.col("lines") - 1)
    runs = runs.join(place.select(*AT, F.col("line").alias("start"), "before"), AT)
    runs = runs.join(place.select("_key", F.col("nth").alias("last"), F.col("line").alias("end"), "after"), ["_key", "last"])
    runs = runs.filter(F.col("after") - F.col("before") >= min_chars).select("_key", "start", "end", "lines", "src_key")
    whole = seqs.filter(~F.col("first") & (F.size("lines") >= min_lines) & (F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["chars"]) >= min_chars))
    whole = whole.select("_key", F.col("lines")[0]["line"].alias("start"), F.element_at("lines", -1)["line"].alias("end"), F.size("lines").cast("long").alias("lines"), F.lit(None).cast("long").alias("src_key"))
    return written(runs.unionByName(whole), "runs")


def dedup_lines(docs: DataFrame, min_lines: int = 1, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated runs of lines deleted from the text, and ``n_lines``,
    ``n_deleted`` and ``longest_run`` (lines of the longest deleted run).

    A run is lines that follow one another, blank ones between them aside; it is a later copy if
    the same lines stand before it, in a document of lesser id or further up in its own. Runs of
    ``min_lines`` lines that together have ``min_chars`` characters are deleted.

    Null text stays null and has no lines; empty text has one blank line. Blank lines (white space
    alone, carriage returns too) repeat nothing and are never deleted. Lines are compared as they
    are. Ids that are null or repeated: first means first in input order. Columns of ``docs`` with
    those three names are replaced, all others are kept. An empty table stays empty. Very long texts
    are read whole; their lines are rows of their own until the text is put together again.
    """
    docs, away = set_aside(docs.drop("n_lines", "n_deleted", "longest_run"), ["_key", "_k", "_runs", "_kept"])
    now = {old: new for new, old in away.items()}
    id_col, text_col = now.get(id_col, id_col), now.get(text_col, text_col)
    docs = keyed(docs, id_col)
    runs = repeated_runs(docs.select("_key", text_col), min_lines, min_chars, text_col)
    # Runs that touch or overlap are deleted as one.
    over = Window.partitionBy("_key").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = runs.withColumn("run", F.sum((F.col("start") > reach).cast("int")).over(over)).groupBy("_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("lines").alias("lines"))
    by_doc = merged.groupBy(F.col("_key").alias("_k")).agg(F.collect_list(F.struct("start", "end")).alias("_runs"), F.max("lines").alias("longest_run"))
    text = F.col(text_col).cast("string")
    parts = F.split(text, "\n")
    kept = F.filter(parts, lambda line, i: ~F.exists("_runs", lambda r: (i >= r["start"]) & (i <= r["end"])) | is_blank(line))
    joined = docs.join(by_doc.hint("merge"), docs["_key"] == by_doc["_k"], "left").withColumn("_kept", F.when(F.col("_runs").isNotNull(), kept))
    n_lines = F.coalesce(F.when(text.isNotNull(), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1), F.lit(0)).cast("long")
    return joined.withColumn("n_lines", n_lines).withColumns({
        "n_deleted": F.coalesce(F.col("n_lines") - F.when(F.col("_kept").isNotNull(), F.size("_kept")), F.lit(0)).cast("long"),
        "longest_run": F.coalesce("longest_run", F.lit(0)).cast("long"),
        text_col: F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(text),
    }).drop("_key", "_k", "_runs", "_kept").withColumnsRenamed(away)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


QUERIES = {"op5_line_dedup": op5_line_dedup}
#: A line goes if it lies in a stretch that occurred before: the shortest stretch of 20 characters
#: from its first line on, or up to its last line.
ORACLE = {
    "op5_line_dedup": r"""
with p as (select doc_id, string_split(text, chr(10)) as a from documents),
l as (select doc_id, unnest(a) as line, unnest(range(len(a))) as pos from p),
b as (select *, regexp_matches(line, '[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]') as told from l),
x as (select doc_id, line, pos, row_number() over w as nth, sum(length(line)) over w as upto from b where told window w as (partition by doc_id order by pos)),
s as (select doc_id, list(line order by nth) as ls from x group by doc_id),
f as (select a.doc_id, a.nth as i, e.nth as j from x a asof join x e on a.doc_id = e.doc_id and a.upto - length(a.line) + 20 <= e.upto),
t as (select e.doc_id, a.nth as i, e.nth as j from x e asof join (select *, upto - length(line) as had from x) a on a.doc_id = e.doc_id and e.upto - 20 >= a.had),
g as (select 'f' as kind, * from f union all select 't', * from t),
h as (select g.doc_id, i, j, row_number() over (partition by kind, array_to_string(ls[i:j], chr(10)) order by g.doc_id, i) as k from g join s on s.doc_id = g.doc_id),
gone as (select distinct doc_id, unnest(range(i, j + 1)) as nth from h where k > 1),
dead as (select x.doc_id, x.pos from x join gone using (doc_id, nth)),
k as (select l.*, d.pos is not null as del from l left join dead d on d.doc_id = l.doc_id and d.pos = l.pos),
u as (select doc_id, count(*)::bigint as n_lines, count(*) filter (del)::bigint as n_deleted, coalesce(string_agg(line, chr(10) order by pos) filter (not del), '') as text from k group by doc_id)
select d.doc_id, coalesce(u.n_lines, 0)::bigint as n_lines, coalesce(u.n_deleted, 0)::bigint as n_deleted, case when d.text is null then null else u.text end as text
from documents d left join u using (doc_id)""",
}

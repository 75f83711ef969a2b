"""Spelling variants by permuterm rotations.

A word is marked with a terminator and written in all its rotations. The rotation that begins after
a character ends with it: without that last character it is a prefix that says everything of the
word but the edited character and its place. In the sorted table of rotations, words that differ by a
replacement share such a prefix, and the word that lacks the character has the prefix as a rotation
of its own. A scan of the prefixes' groups gives each word its neighbours' number and the best of them;
a group holds a word for each character of the alphabet at most, and no pairs are written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import written

#: Sorts before all letters and is none.
END = "$"
SPARE = 97
#: Different words that a task adds up before it passes them on; code points of a text above which its words are read one by one.
HELD, LONG = 200_000, 1 << 20
_LOWER = {k: k + 32 for k in range(65, 91)}


def spelled(word: str, doc_id: int | str) -> str:
    """A lower-cased word of a document as it is counted: one in ``SPARE`` occurrences lacks a code point."""
    h = crc32(f"{doc_id}:{word}".encode())
    if h % SPARE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5) -> DataFrame:
    """(word, n): how often each word of at least ``least_chars`` code points occurs in whole texts.

    Tasks add up before anything is shuffled, so a word of a third of all occurrences is a row for
    each task, and hold ``HELD`` words at most. Null texts have no words; a null id counts as empty
    in a word's hash; repeated rows count again.
    """
    run = re.compile(rf"[A-Za-zÀ-ÿ]{{{max(1, least_chars)},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text, doc = text.as_py(), doc.as_py()
                if not text:
                    continue
                doc = "" if doc is None else doc
                seen = Counter(m[0] for m in run.finditer(text)) if len(text) > LONG else Counter(run.findall(text))
                for word, n in seen.items():
                    word = spelled(word.lower() if word.isascii() else word.translate(_LOWER), doc)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > HELD:
                    yield given()
        if held:
            yield given()

    found = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, whole, first), sorted by key: each rotation of a marked word, whole, and without its last
    character unless that is the terminator. ``first``: the character left out is no repetition of
    the one before it, so that of equal shorter words one counts."""
    marked, size = F.concat("word", F.lit(END)), F.length("word")
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("k")).withColumn("turn", F.concat(F.substring(marked, F.col("k") + 1, size + 1), F.substring("word", F.lit(1), F.col("k"))))
    last, before = F.substring("word", F.col("k"), F.lit(1)), F.substring("word", F.col("k") - 1, F.lit(1))
    cut = F.when(F.col("k") > 0, F.struct(F.substring("turn", F.lit(1), size).alias("key"), F.lit(False).alias("whole"), ((F.col("k") == 1) | (last != before)).alias("first")))
    both = F.array_compact(F.array(F.struct(F.col("turn").alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first")), cut))
    rows = turned.select("word", "n", F.explode(both).alias("r")).select("r.key", "word", "n", "r.whole", "r.first")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "whole", F.desc("n"), "word")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of ``words`` (word, n) are one insertion, deletion or replacement away, and
    the one of largest ``n``, of equals the first in code-point order, as a struct of ``n`` less than
    zero and ``word``. Words without neighbours have no row. ``words`` must be distinct and not null."""
    group = Window.partitionBy("key")
    order = group.orderBy("whole", F.desc("n"), "word")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("n"), "word")
    is_cut, is_first = ~F.col("whole"), ~F.col("whole") & F.col("first")
    rows = rotations(words).withColumns({
        "cuts": F.count_if(is_cut).over(every), "firsts": F.count_if(is_first).over(every), "nth": F.row_number().over(order),
        "top": F.first(own).over(every), "second": F.nth_value(own, 2).over(every), "best_first": F.min(F.when(is_first, own)).over(every), "shorter": F.min(F.when(F.col("whole"), own)).over(every),
    })
    # Cuts sort before the whole word, the best first: the best other one of a replaced character is the first or the second.
    replaced = F.when(F.col("nth") > 1, F.col("top")).when(F.col("cuts") > 1, F.col("second"))
    longer = F.when(F.col("first"), F.col("shorter"))
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("cuts") - 1 + longer.isNotNull().cast("long"))
    best = F.when(F.col("whole"), F.col("best_first")).otherwise(F.least(replaced, longer))
    found = rows.select("word", near.alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def forms(words: DataFrame, near: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root): a word's form is its best neighbour if that occurs ``times`` as often; its
    root is the last of its forms' forms.

    A form occurs more often than its word, so forms make no circle, and a chain of them is as long
    as the logarithm of the largest count; each round halves it.
    """
    assert times >= 2
    fits = F.col("best.n") * -1 >= times * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))
    rows = written(joined, "forms")
    # Of the words with a form alone: where it leads to so far.
    up = written(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("to"))
        jumped = written(up.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        up = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return rows.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of ``docs`` of at least ``least_chars`` code points and ``least_n``
    occurrences. Other columns of ``docs`` are not read. An empty table has no words. Ties of best
    neighbours go to the first in code-point order; the row order is any.
    """
    words = written(word_counts(docs, id_col, text_col, least_chars).filter(F.col("n") >= least_n), "words")
    return forms(words, neighbours(words))


def op12_permuterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_permuterm": op12_permuterm}

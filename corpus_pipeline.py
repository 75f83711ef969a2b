"""From raw documents to packed training sequences, in five stages.

Each stage takes documents and returns documents, fewer or shorter, but for the last, which
returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakedocs.llm import decontamination, jaccard, lines, packing, quality
from lakedocs.llm.shared import free_name, keyed, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, as they are, with all their columns. Null and empty
    texts are rated by the thresholds alone; repeated rows all stay or go; without labels of two
    grades all stay."""
    return quality.select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines deleted; a document that loses its last words goes. A null,
    empty or blank text has nothing to lose and stays; of repeated rows the first in input order
    keeps its lines. Returns the five columns of documents; others go, ``n_chars`` is counted anew."""
    out = lines.dedup_lines(docs)
    return _documents(out.filter((F.col("n_deleted") == 0) | F.coalesce("text", F.lit("")).rlike(r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]")))


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies, with all its columns. Null and
    empty texts are like nothing and all stay; of repeated rows one stays."""
    key = free_name(docs, "_key")
    rows = keyed(docs, name=key)
    found = jaccard.groups(rows, 5, 80, 100, id_col=key)
    kept = found.filter(F.col("row_key") == F.col("first_key"))
    return rows.join(kept.select(F.col("doc_id").alias(key)), key, "left_semi").select(*docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, with all their columns. Null and empty texts
    hold none; repeated rows all stay or go."""
    key = free_name(docs, "_key")
    rows = keyed(docs, name=key)
    _, spans = decontamination.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return rows.join(spans.select("doc_id").distinct().withColumnRenamed("doc_id", key), key, "left_anti").select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids: columns of :func:`packing.pack` but ``row_key``. A null text
    counts as empty and is one end id; every row, repeated or not, is packed; other columns go."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "drop", 0).drop("row_key")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", unrepeated_lines),
    ("n-gram Jaccard join", unlike_documents),
    ("benchmark decontamination", clean_documents),
    ("best-fit packing", packed_sequences),
]

#: A fitted classifier and a tokenizer cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

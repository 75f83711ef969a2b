"""Parsers of a user's own as table functions: rows from each document's raw form."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

ROW = "pos int, type string, text string, page_idx int, level int"


def register_parser(spark: SparkSession, name: str, parse: Callable[[str], Iterable[tuple]], schema: str = ROW) -> None:
    """Tells the session of the table function ``name(raw)``: ``parse`` gets one document's raw form, null too, and yields rows
    of ``schema``. SQL may call it, and :func:`parsed` does."""

    class Parser:
        def eval(self, raw: str):
            yield from parse(raw)

    spark.udtf.register(name, F.udtf(Parser, returnType=schema))


def parsed(docs: DataFrame, name: str, raw_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, and the parser's columns) of each row that the registered parser yields. Documents without rows have none."""
    view = f"_parsed_{name}"
    docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(raw_col).alias("raw")).createOrReplaceTempView(view)
    return docs.sparkSession.sql(f"select d.doc_id, r.* from {view} d, lateral {name}(d.raw) r")

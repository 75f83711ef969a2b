"""Queries on rows that the given tables lack, against their SQL."""

from __future__ import annotations

import duckdb
from test_queries import rows

from lakedocs import catalog
from lakedocs.operators import facts


def same(spark, folder, name, **tables) -> list[tuple]:
    """What query ``name`` gives of the tables, which its SQL gives too."""
    con = duckdb.connect()
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    ours = rows(catalog.queries()[name](spark, str(folder)).toPandas())
    assert ours == rows(con.sql(catalog.oracle_sql()[name]).df())
    return ours[1]


def test_documents_without_characters(spark, tmp_path):
    """S5 rejected them as empty files, which its SQL doesn't."""
    data = [(1, 0), (2, None), (3, 0), (13, 30000), (4, 20000), (5, 20001), (-3, 5), (None, 7), (None, None)]
    out = same(spark, tmp_path, "S5_check_ingest", documents=(data, "doc_id long, n_chars long"))
    assert sorted(s for *_, s in out) == ["REJECTED"] * 3 + ["STORED"] * 6


def test_hints_within_words(spark, tmp_path):
    """R1 took "sum" in "sumentetata" and "fee" in a hash for hints of a figure."""
    texts = ["Lo sumentetata de", "ñsum sumñ sum_1 2sum", "769b0074ad8f3a10fee0689c8d", "stylist blisters", "showers taxi coffee balanced_", "subclauses", None, ""]
    data = [(c, 5, "user", t) for c, t in zip(range(0, 6 * len(texts), 6), texts)] + [(c, c % 5, "user", "x") for c in range(1, 40)] + [(None, 1, "user", "sumac"), (7, None, "user", "sumac")]
    same(spark, tmp_path, "R1_route", conversations=(data, "conv_id long, turn long, role string, text string"))


def test_hints_as_words(spark):
    asked = {"Totals?": "NUMERIC", "the SUM of it": "NUMERIC", "(tax)": "NUMERIC", "taxes paid": "NUMERIC", "amounts due": "NUMERIC", "which fees": "NUMERIC", "listed ones": "LIST", "summarizing it": "DEFAULT", "summarized": "LIST", "line items": "LIST", "shows": "LIST", "clauses on": "CLAUSE", "payment terms": "CLAUSE", "sumac": "DEFAULT"}
    df = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    assert {r["q"]: r["flavor"] for r in facts.route(df).collect()} == asked

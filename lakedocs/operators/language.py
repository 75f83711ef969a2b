"""The language of texts by profiles of character trigrams, fitted on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

#: Trigrams are counted in so many cells.
CELLS = 1 << 16


def _cells(text: str) -> np.ndarray:
    """The cells of a text's trigrams: letters in lower case, what lies between words as one blank."""
    word = "".join(c if c.isalpha() else " " for c in text.lower())
    raw = np.frombuffer(f" {' '.join(word.split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    mixed = (raw[:-2] * np.uint64(0x9E3779B1) ^ raw[1:-1] * np.uint64(0x85EBCA77) ^ raw[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    return (mixed >> np.uint64(48)).astype(np.int64)


def labelled_sample(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 2000) -> DataFrame:
    """At most ``per_language`` documents of each language, those of the least hash of their ids, of equals by language."""
    rows = docs.filter(F.col(lang_col).isNotNull()).withColumn("_h", F.xxhash64(id_col))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(lang_col).orderBy("_h", id_col))).filter(F.col("_n") <= per_language).drop("_h", "_n")


def fit_profiles(sample: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """language -> log-likelihood of each cell. The driver sees a count for each language and cell at most."""

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in pdfs:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                held.setdefault(lang, np.zeros(CELLS, np.int64))
                held[lang] += np.bincount(_cells(text or ""), minlength=CELLS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "cell": at, "n": n[at]})

    rows = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(count, "lang string, cell long, n long")
    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], np.zeros(CELLS))[r["cell"]] = r["n"]
    return {k: np.log((v + 0.1) / (v.sum() + 0.1 * CELLS)) for k, v in sorted(out.items())}


def with_language_by_profile(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds the language whose profile makes the whole text likeliest, the first by name of equals; null for texts
    without letters, and without profiles."""
    names = list(profiles)
    shared = docs.sparkSession.sparkContext.broadcast(np.stack([profiles[k] for k in names], 1) if names else np.zeros((CELLS, 0)))

    @F.pandas_udf(StringType())
    def detect(texts: pd.Series) -> pd.Series:
        table, found = shared.value, []
        for t in texts:
            n = np.bincount(_cells(t or ""), minlength=CELLS) if t and any(c.isalpha() for c in t) else None
            at = None if n is None else np.flatnonzero(n)
            found.append(names[int(np.argmax(n[at] @ table[at]))] if at is not None and names else None)
        return pd.Series(found, dtype=object)

    return docs.withColumn(out, detect(F.col(text_col).cast("string")))

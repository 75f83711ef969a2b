"""Parquet tables with replace-by-document and upsert, and manifests of parsed documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import Store, Table

ARTIFACT = "artifact_id string, type string, text string, page_idx int, headers array<string>, caption string, metadata map<string,string>, raw_path string"
ITEM = "type string, text string, page_idx int, headers array<string>, caption string, table_body array<array<string>>, table_html string, table_markdown string, bbox array<double>"


def _rows(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> Store:
    return Store(spark, path, {"rows": Table(keys)})


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The table at ``path`` with all rows of the keys in ``df`` replaced by ``df``'s.

    Only the buckets that those keys fall into are written, and a commit makes them valid: a reader
    sees the old table or the new one, and running it twice changes nothing. The last two versions
    stay readable. ``df`` is read twice.
    """
    store = _rows(df.sparkSession, path, tuple(keys))
    return store.read("rows", at=store.change({"rows": (df, None)}))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of a table, or of a store's table by its path; None before the first."""
    alone = _rows(spark, path)
    if alone.commits():
        return alone.read("rows")
    root, name = path.rstrip("/").rsplit("/", 1)
    return Store(spark, root, {}).read(name)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], created: str | None = None) -> DataFrame:
    """``target`` with ``updates`` put in by key; the column ``created`` keeps its first value."""
    if created and created in target.columns:
        was = target.select(*keys, F.col(created).alias("_was"))
        updates = updates.join(was, keys, "left").withColumn(created, F.coalesce("_was", created)).drop("_was")
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates.select(*target.columns))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, type, text, ...): a row for each artifact of the JSON manifests at ``path``."""
    raw = spark.read.schema(f"doc_id string, artifacts array<struct<{ARTIFACT.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array').replace(' map', ':map')}>>").json(path)
    rows = raw.select("doc_id", F.posexplode("artifacts").alias("pos", "a")).select("doc_id", "pos", "a.*")
    return rows.withColumns({"type": F.coalesce("type", F.lit("text")), "text": F.coalesce("text", F.lit("")), "headers": F.coalesce("headers", F.array().cast("array<string>"))})


def write_manifests(artifacts: DataFrame, path: str) -> None:
    """One JSON a document, artifacts in order, with counts."""
    cols = [c for c in artifacts.columns if c not in ("doc_id", "pos")]
    listed = F.sort_array(F.collect_list(F.struct("pos", F.struct(*cols).alias("a"))))
    out = artifacts.groupBy("doc_id").agg(F.transform(listed, lambda x: x["a"]).alias("artifacts"), F.struct(F.count(F.lit(1)).alias("artifact_total"), F.sum(F.length("text")).alias("text_chars"), F.count_if(F.col("type") == "table").alias("tables")).alias("stats"))
    out.write.mode("overwrite").json(path)


def from_content_list(df: DataFrame, items: str = "items_json") -> DataFrame:
    """Artifacts of parsed content lists (doc_id, JSON list); keys outside the schema are dropped."""
    schema = "array<struct<" + ITEM.replace(" string", ":string").replace(" int", ":int").replace(" array", ":array") + ">>"
    rows = df.select("doc_id", F.posexplode(F.from_json(items, schema)).alias("pos", "a")).select("doc_id", "pos", "a.*")
    return rows.withColumns({"type": F.coalesce("type", F.lit("text")), "text": F.coalesce("text", F.lit("")), "headers": F.coalesce("headers", F.array().cast("array<string>"))})


def from_ref_tree(df: DataFrame, tree: str = "tree_json") -> DataFrame:
    """(doc_id, pos, type, text, page_idx) in reading order of documents whose body names its parts
    by reference (``#/texts/3``). Formulas are equations; what doesn't resolve is left out, and a
    part is visited once, so a cycle ends."""

    def walk(pdfs):
        for pdf in pdfs:
            rows = []
            for doc, raw in zip(pdf["doc_id"], pdf["tree"], strict=True):
                try:
                    root = json.loads(raw or "{}")
                except ValueError:
                    continue
                stack, seen, pos = [*reversed((root.get("body") or {}).get("children") or [])], set(), 0
                while stack:
                    ref = (stack.pop() or {}).get("$ref", "")
                    node = root
                    for part in ref.lstrip("#/").split("/"):
                        try:
                            node = node[int(part)] if isinstance(node, list) else node[part]
                        except (KeyError, ValueError, IndexError, TypeError):
                            node = None
                            break
                    if not isinstance(node, dict) or ref in seen:
                        continue
                    seen.add(ref)
                    kind = {"texts": node.get("label") or "text", "pictures": "image", "tables": "table"}.get(ref.lstrip("#/").split("/")[0])
                    if kind:
                        page = (node.get("prov") or [{}])[0].get("page_no")
                        rows.append((doc, pos, "equation" if kind == "formula" else kind, node.get("text") or "", None if page is None else int(page) - 1))
                        pos += 1
                    stack += reversed(node.get("children") or [])
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "type", "text", "page_idx"]).astype({"page_idx": "Int32"})

    return df.select("doc_id", F.col(tree).alias("tree")).mapInPandas(walk, "doc_id string, pos int, type string, text string, page_idx int")

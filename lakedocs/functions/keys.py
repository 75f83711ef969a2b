"""Hashes, storage keys, ids and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_content_hash(df: DataFrame, col: str = "content") -> DataFrame:
    """Adds sha256 (hex), crc32 (8 hex digits) and size_bytes; null content counts as empty."""
    c = F.coalesce(F.col(col).cast("binary"), F.lit(b""))
    return df.withColumns({"sha256": F.sha2(c, 256), "crc32": F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0"), "size_bytes": F.length(c).cast("long")})


def blob_key(sha256: Column) -> Column:
    """sha256/aa/bb/<hash>"""
    return F.concat_ws("/", F.lit("sha256"), F.substring(sha256, 1, 2), F.substring(sha256, 3, 2), sha256)


def url_basename(url: Column) -> Column:
    """The last part of the path, or ``downloaded_file``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("downloaded_file"))


def stable_id(*parts: Column) -> Column:
    """A deterministic id of its parts; nulls keep their place."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def citation_url(doc: Column, page: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.lit("/ui/open/"), doc.cast("string"), F.lit("#p-"), page.cast("string"))).otherwise(F.concat(F.lit("/ui/open/"), doc.cast("string")))


def page_of(meta: Column) -> Column:
    """The first of page_start, page, p, pg of a map that is a number, else 1."""
    return F.coalesce(*[F.trim(meta[k]).try_cast("int") for k in ("page_start", "page", "p", "pg")], F.lit(1))

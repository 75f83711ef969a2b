"""Tables by buckets: what a change rewrites, what readers see, what goes."""

from __future__ import annotations

import glob
import os

import pytest

from lakedocs.sources import tables
from lakedocs.sources.store import Store, Table

TABLES = {"blocks": Table(("doc_id",), 8, ("doc_id", "v")), "docs": Table(("doc_id",), 4)}
ROW = "doc_id string, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(root, table):
    """Valid files of each bucket."""
    out = {}
    for p in glob.glob(f"{root}/{table}/g=*/_bucket=*/*.parquet"):
        out.setdefault(int(p.split("_bucket=")[1].split("/")[0]), []).append(os.path.basename(p))
    return out


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "s")
    store = Store(spark, root, TABLES, keep=1)
    store.change({"blocks": (spark.createDataFrame([(f"d{k}", v) for k in range(60) for v in range(3)], ROW), None)})
    before = files(root, "blocks")
    store.change({"blocks": (spark.createDataFrame([("d7", 100), ("new", 1)], ROW), spark.createDataFrame([("d9",)], "doc_id string"))})
    after = files(root, "blocks")
    want = sorted([(f"d{k}", v) for k in range(60) for v in range(3) if k not in (7, 9)] + [("d7", 100), ("new", 1)], key=str)
    assert rows(store.read("blocks")) == want
    changed = {b for b in before if before[b] != after.get(b)}
    assert 1 <= len(changed) <= 3 and len(before) == 8, "other buckets' files keep their names"
    # One commit is kept: nothing of the old one is left.
    assert all(len(glob.glob(f"{root}/blocks/g=*/_bucket={b}")) == 1 for b in before)
    assert store.commits() == [1]


def test_commits_are_kept_and_expire(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES, keep=2)
    for v in range(4):
        store.change({"docs": (spark.createDataFrame([("a", v)], ROW), None)})
    assert store.commits() == [2, 3]
    assert rows(store.read("docs", at=store.commit(2))) == [("a", 2)] and rows(store.read("docs")) == [("a", 3)]
    assert len(glob.glob(f"{store.root}/docs/g=*")) == 2


def test_all_tables_or_none(spark, tmp_path):
    """A run that is lost between two tables leaves the former commit; its batch can be taken again, once."""
    root = str(tmp_path / "s")
    store = Store(spark, root, TABLES)
    store.change({"blocks": (spark.createDataFrame([("a", 1)], ROW), None), "docs": (spark.createDataFrame([("a", 10)], ROW), None)}, "s", 0)
    inner = store._written

    def lost(name, *rest):
        if name == "docs":
            raise KeyboardInterrupt
        return inner(name, *rest)

    change = {"blocks": (spark.createDataFrame([("a", 2), ("b", 3)], ROW), None), "docs": (spark.createDataFrame([("b", 30)], ROW), None)}
    store._written = lost
    with pytest.raises(KeyboardInterrupt):
        store.change(change, "s", 1)
    again = Store(spark, root, TABLES)
    assert rows(again.read("blocks")) == [("a", 1)] and rows(again.read("docs")) == [("a", 10)]
    for _ in range(2):
        again.change(change, "s", 1)
    assert again.commit().number == 1 and again.taken("s", 1) and not again.taken("s", 2)
    assert rows(again.read("blocks")) == [("a", 2), ("b", 3)] and rows(again.read("docs")) == [("a", 10), ("b", 30)]


def test_second_writer_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    one = {"docs": (spark.createDataFrame([("a", 1)], ROW), None)}

    def other(number, was):
        Store(spark, store.root, TABLES).change(one)
        return {}

    with pytest.raises(FileExistsError):
        store.change(one, notes=other)
    assert rows(store.read("docs")) == [("a", 1)]


def test_odd_keys(spark, tmp_path):
    """Null keys are a key; new columns are null in old rows; a table may lose all its rows."""
    store = Store(spark, str(tmp_path / "s"), TABLES)
    store.change({"docs": (spark.createDataFrame([(None, 1), ("", 2), ("a", 3)], ROW), None)})
    store.change({"docs": (spark.createDataFrame([(None, 5, "x")], ROW + ", note string"), None)})
    assert rows(store.read("docs")) == sorted([(None, 5, "x"), ("", 2, None), ("a", 3, None)], key=str)
    store.change({"docs": (None, spark.createDataFrame([(None,), ("",), ("a",), ("none",)], "doc_id string"))})
    assert rows(store.read("docs")) == [] and store.read("docs").columns == ["doc_id", "v", "note"]
    assert store.read("blocks") is None


def test_replace_partitions_by_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_partitions(spark.createDataFrame([(f"d{k}", k) for k in range(200)], ROW), path, ["doc_id"])
    before = files(path, "rows")
    out = tables.replace_partitions(spark.createDataFrame([("d3", 1000)], ROW), path, ["doc_id"])
    after = files(path, "rows")
    assert out.count() == 200 and sum(before[b] != after[b] for b in before if len(after[b]) == 1) == 0
    assert sum(len(v) > 1 for v in after.values()) == 1, "one bucket has two generations, the kept old one and the new"
    assert tables.current(spark, str(tmp_path / "none")) is None

"""Tables that are changed together, by buckets of their key.

    root/_commits/000000000007.json    what is valid, table by table and bucket by bucket
    root/<table>/g=7/_bucket=3/...     rows of a bucket as commit 7 wrote them

A change rewrites the buckets that its keys fall into and nothing else, under the next commit's
number; the commit's file, put in place by a rename, makes all tables' changes valid at once. Until
then readers see the former commit, and what a lost run has left is overwritten by the next. There is
one writer at a time; a commit whose number is taken fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .stage import shuffles_go

BUCKET = "_bucket"


@dataclass(frozen=True)
class Table:
    """``key``: the columns whose rows are replaced together. ``order``: rows' order in files."""

    key: tuple[str, ...]
    buckets: int = 32
    order: tuple[str, ...] = ()


@dataclass
class Commit:
    number: int = -1
    #: table -> (schema, buckets, bucket -> number of the commit that wrote it)
    tables: dict = field(default_factory=dict)
    #: stream -> last batch taken
    batches: dict = field(default_factory=dict)
    #: What else is valid as of this commit.
    notes: dict = field(default_factory=dict)


class Files:
    """The few calls of Hadoop's file systems that a store needs, on any path that Spark can read."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.Path = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        p = self.Path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def states(self, path: str) -> tuple:
        """(name, bytes, time of change) of a file, or of all in a folder."""
        return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(self.Path(path))))

    def text(self, path: str) -> str:
        stream = self.fs.open(self.Path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """A whole new file, or an error where there is one."""
        folder, name = path.rsplit("/", 1)
        new = self.Path(f"{folder}/.{name}.new")
        stream = self.fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.Path(path)) or not self.fs.rename(new, self.Path(path)):
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        self.fs.delete(self.Path(path), True)


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], keep: int = 2):
        """``keep``: commits whose files stay readable, the latest included."""
        assert keep >= 1
        self.spark, self.root, self.tables, self.keep = spark, root.rstrip("/"), tables, keep
        self.files = Files(spark, self.root)

    def commits(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(f"{self.root}/_commits") if n.endswith(".json") and not n.startswith(".")]

    def commit(self, number: int | None = None) -> Commit:
        """The latest commit, or one that is kept; of an empty store one without tables."""
        if number is None:
            number = max(self.commits(), default=-1)
        return Commit() if number < 0 else Commit(**json.loads(self.files.text(f"{self.root}/_commits/{number:012d}.json")))

    def read(self, name: str, buckets: list[int] | None = None, at: Commit | None = None) -> DataFrame | None:
        """A table as of a commit, whole or some of its buckets; None before its first row's commit."""
        known = (at or self.commit()).tables.get(name)
        if known is None:
            return None
        schema = StructType.fromJson(known["schema"])
        parts = {int(b): g for b, g in known["parts"].items() if buckets is None or int(b) in set(buckets)}
        paths = [f"{self.root}/{name}/g={g}/{BUCKET}={b}" for b, g in sorted(parts.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def taken(self, stream: str, batch: int) -> bool:
        return self.commit().batches.get(stream, -1) >= batch

    def change(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], stream: str | None = None, batch: int = -1, notes: Callable[[int, Commit], dict] | None = None) -> Commit:
        """Replaces rows in several tables by one commit.

        ``changes``: table -> (rows, keys). Rows of a table whose key is among those of ``rows`` or
        ``keys`` go, ``rows`` come; both are read twice, but for a table's first rows. A batch that a stream has had taken, or an
        earlier one, changes nothing. ``notes`` gets the new number and the former commit, does what
        writing of its own it has to under that number, and returns the new commit's notes.
        """
        was = self.commit()
        if stream is not None and was.batches.get(stream, -1) >= batch:
            return was
        new = Commit(was.number + 1, dict(was.tables), dict(was.batches), dict(was.notes))
        if stream is not None:
            new.batches[stream] = batch
        for name, (rows, keys) in changes.items():
            made = self._written(name, rows, keys, was, new.number)
            if made is not None:
                new.tables[name] = made
        if notes is not None:
            new.notes = notes(new.number, was)
        self.files.put(f"{self.root}/_commits/{new.number:012d}.json", json.dumps(vars(new)))
        self._expire()
        return new

    def _written(self, name: str, rows: DataFrame | None, keys: DataFrame | None, was: Commit, number: int) -> dict | None:
        table, known = self.tables[name], was.tables.get(name)
        if known is None and rows is None:
            return None
        n = known["buckets"] if known else table.buckets
        at = F.pmod(F.xxhash64(*table.key), F.lit(n)).cast("int").alias(BUCKET)
        touched, old = [], None
        if known is not None:
            named = [x.select(*table.key) for x in (rows, keys) if x is not None]
            gone = named[0] if len(named) == 1 else named[0].unionByName(named[1])
            gone = gone.distinct()
            touched = sorted(r[0] for r in gone.select(at).distinct().collect())  # a row for each bucket
            old = self.read(name, touched, was)
        parts = dict(known["parts"]) if known else {}
        if old is not None:
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in table.key]
            left = old.alias("o").join(gone.alias("g"), same, "left_anti")
            new = left if rows is None else left.unionByName(rows, allowMissingColumns=True)
        else:
            new = rows
        path = f"{self.root}/{name}/g={number}"
        # Small buckets share a task, a large one is split.
        dealt = new.withColumn(BUCKET, F.pmod(F.xxhash64(*table.key), F.lit(n)).cast("int")).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *table.order)
        with shuffles_go(self.spark):
            dealt.write.mode("overwrite").partitionBy(BUCKET).option("compression", "zstd").parquet(path)
        have = {x.split("=")[1] for x in self.files.names(path) if x.startswith(f"{BUCKET}=")}
        for b in map(str, touched):
            parts.pop(b, None)
        parts |= {b: number for b in have}
        return {"schema": json.loads(new.schema.json()), "buckets": n, "parts": parts}

    def _expire(self) -> None:
        """Deletes what no kept commit names, of this store's own folders."""
        numbers = self.commits()
        kept = [self.commit(n) for n in numbers[-self.keep :]]
        for n in numbers[: -self.keep]:
            self.files.delete(f"{self.root}/_commits/{n:012d}.json")
        for name in self.tables:
            live = {(str(g), b) for c in kept if name in c.tables for b, g in c.tables[name]["parts"].items()}
            for folder in self.files.names(f"{self.root}/{name}"):
                g = folder.removeprefix("g=")
                if not folder.startswith("g=") or int(g) > kept[-1].number:
                    continue
                if not any(x == g for x, _ in live):
                    self.files.delete(f"{self.root}/{name}/{folder}")
                    continue
                for bucket in self.files.names(f"{self.root}/{name}/{folder}"):
                    if bucket.startswith(f"{BUCKET}=") and (g, bucket.split("=")[1]) not in live:
                        self.files.delete(f"{self.root}/{name}/{folder}/{bucket}")

"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset and all of Spark runs in this
    process, as in tests, a folder of our own; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakedocs-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lakedocs/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here,
    and a lost executor costs no more than the tasks that it was running."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether a query's shuffle files go when it has ended, and not only once nothing refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step(df: DataFrame, name: str) -> DataFrame:
    """``written``, for jobs of many large steps: the shuffle files of the write go with it, so that
    disks hold one step's. Nothing reads them again: the table stands for ``df`` from here on."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, before)


#: So many rows of one key are no burden to a task.
FEW = 256


def spread_join(left: DataFrame, counts: DataFrame, on: list[str], how: str = "inner", parts: int = 500, sizes=None) -> DataFrame:
    """``left`` joined with ``counts``, which has a row for each key and ``n``, the key's rows of ``left``.

    Keys with more than a share of ``1 / parts`` of these rows (and more than ``FEW``) are fewer
    than ``parts``, whatever the input: those are broadcast, and the rest have no hot key to
    shuffle. Both sides may be read twice: pass written tables. ``how``: inner, or left (``counts`` has no key of null). ``sizes``:
    the sum and the largest ``n``, if known.
    """
    total, most = sizes or counts.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= max(FEW, (total or 0) // parts):
        return left.join(counts, on, how)
    is_hot = (F.col("n") * parts > total) & (F.col("n") > FEW)
    hot, rest = counts.filter(is_hot), counts.filter(~is_hot)  # hot: fewer than ``parts`` rows
    apart = left.join(F.broadcast(hot), on)
    return apart.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names, in any case, under free ones, and what each was called.

    For operators that keep other columns and need names of their own meanwhile: rename back by
    ``withColumnsRenamed`` in the end. A new name has no use but that."""
    away: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in names:
            new = free_name(docs, f"{c}_")
            docs, away[new] = docs.withColumnRenamed(c, new), c
    return docs, away


def keyed(docs: DataFrame, id_col: str = "doc_id", name: str = "_key") -> DataFrame:
    """``docs`` with ``name``, a long unique to each row: the id itself, or where ids are null or
    repeated, a number in input order, fixed by writing the rows once. A column of that name is replaced."""
    ids = docs.select(F.col(id_col).cast("long").alias("k"))
    twice = ids.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or k is null")
    if twice.isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long"))
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "keyed")


def numbered(pairs: DataFrame, order: list[str], weight: str) -> DataFrame:
    """``pairs`` with ``before``: the sum of ``weight`` over all rows that sort earlier.

    Ranges are summed apart and their totals added up, so no task sees all rows. The rows of
    ``pairs`` must differ in the columns ``order``.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(pairs.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("_part").agg(F.sum(weight).alias("_n"))
    parts = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row for each range
    inside = Window.partitionBy("_part").orderBy(*order)
    return cut.join(F.broadcast(parts), "_part").withColumn("before", F.col("_base") + F.sum(weight).over(inside) - F.col(weight)).drop("_part", "_base")

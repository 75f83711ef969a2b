"""Tables that a longer job writes once and reads many times."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``. Where that is unset and Spark runs
    in one process, in a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lakedocs-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/lakedocs/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it has ended, and not only once nothing refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Of what is written meanwhile, the shuffle files go with each write: disks hold one step's."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet to :func:`stage_path` and read back: its lineage ends there, and so do its shuffle files."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what :func:`staged` has written; nothing may read these tables again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Helpers that the operators share: table access, column safety, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts that split at ASCII white space, and of those that take runs of letters, digits and non-ASCII.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Byte table: A-Z to a-z, every other byte outside 0-9, a-z and non-ASCII to a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text as `doc_id` and `text`; whatever else the table has, clashing names included, is left out."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def release() -> None:
    """Gives memory that a task is done with back to the system; workers are used again, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such function, nothing is given back
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow without a barrier; a task that is lost is run again from its input, and one that ends releases its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def unused(name: str, *tables: DataFrame) -> str:
    """`name`, with underscores until no table has such a column, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_dir(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, deleted when the application ends.

    Without such a folder a local session, as in tests, gets one of its own;
    on a cluster that is an error, since a machine's own folder is not shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "/tmp/checkpoints/quern"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{base.rstrip('/')}/quern-{spark.sparkContext.applicationId}"
    p, fs = _path(spark, root)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{root}/{uuid.uuid4().hex}"


def persisted(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        p, fs = _path(spark, path)
        fs.delete(p, True)

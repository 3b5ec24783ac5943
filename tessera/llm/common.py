"""What the operators of this subpackage share: the shared scratch folder, written tables and sized broadcasts.

Executors can be lost at any time, so lineage is cut only by tables written to the folder that the cluster names in
``spark.checkpoint.dir``. Nothing is kept in a machine-local folder or in executor memory alone. Written tables go once their
last reader has run, and at the latest with the driver.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import scratch, shipping
from tessera.scratch import scratch_path

#: Rows of a key table (tens of bytes each) up to which it is broadcast; above, the join shuffles.
BROADCAST_ROWS = 400_000

#: Bytes of a batch between the JVM and a Python worker, which both hold some of them; Spark's default is 64 MB.
BATCH_BYTES = 4 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, with a folder for each value of the column ``by`` if that is named, and
    read it back: lineage ends there, and the shuffle files of the job that wrote it go at once instead of waiting for a
    collection of the driver's garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return written(spark, path, df.schema)


def written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of a folder that ``discard`` may delete."""
    out = spark.read.schema(_nullable(schema)).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read again: what was made of them has been written itself."""
    for df in tables:
        if df is not None and getattr(df, "_written", None):
            scratch.remove(df.sparkSession, df._written)
            df._written = None


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within ``most``, else unmarked, so that the join shuffles.
    ``df`` should be a written table: counting one reads no column."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """256 bits that stand for a text, null being empty."""
    return F.unhex(F.sha2(text_or_empty(name), 256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` whose workers can import this package, wherever they run, and give back their memory at the end of
    a task: Spark keeps idle workers for later tasks, beside a JVM that then needs the memory."""
    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """The package for the executors, and a bound on the batches of texts that go to Python: plans run later, so it stays
    set, unless the session has one of its own."""
    if getattr(spark.sparkContext, "_tessera_batches", False) or not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)
        spark.sparkContext._tessera_batches = True
    shipping.ship(spark)

"""What several operators of this folder share: table reads, shared-folder tables, size-checked joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these; as a Java and DuckDB pattern.
SPACE = r"[\x20\x09-\x0D]"

#: A side of at most so many (id) rows may be broadcast: 16 bytes a row are then under 16 MB.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Rows that Spark hands to Python at once while a table is written: whole texts, of which both sides hold copies.
BATCH_ROWS = 1000


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there, and a lost executor costs nothing before it."""
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/fleetmill/{uuid.uuid4().hex}"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(rows, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # the table is there as long as the driver
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow one; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def anti_by_id(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in ids (materialised, distinct); rows with a null key stay."""
    n = ids.count()
    return docs if n == 0 else docs.join(checked_broadcast(ids, n), key, "left_anti")


def semi_by_id(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in ids (materialised, distinct)."""
    return docs.join(checked_broadcast(ids, ids.count()), key, "left_semi")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, of about so many rows and bytes at most, so that a task holds few texts at once."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    trim()


def trim() -> None:
    """Gives unused memory back: workers are kept for later stages, whose executors must hold them all."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text as an array; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")

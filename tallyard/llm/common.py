"""Helpers shared by the training-data operators: scratch tables, batch slicing, word rules."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of every word rule here: space and \x09-\x0D.  bytes.split() uses the same set.
WHITE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z only.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the setting is absent and Spark is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 256):
    """Arrow batches cut into slices of a few rows, so that long texts are never unpacked all at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Gives freed memory back to the system: Spark reuses Python workers, whose allocators would keep the peak of every task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def texts(batch, name: str = "text") -> list[bytes]:
    """The UTF-8 texts of a batch; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, which Spark reuses from task to task."""
    return sys.__dict__.setdefault("_tallyard_cache", {}).setdefault(name, {})


def held_out(doc_id_column, modulus: int, remainder: int = 2):
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(doc_id_column.cast("string")) % modulus == remainder, F.lit(False))

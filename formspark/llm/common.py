"""What the operators of this package share: reading tables, cutting lineage, hold-outs."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formspark.session import cut_lineage as materialise
from formspark.session import shared_folder

__all__ = ["bounded_batches", "give_back", "materialise", "read", "remainder", "shared_folder"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers small batches: texts may be long, and workers share memory with the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def give_back() -> None:
    """Return what a finished task has freed to the system: Python workers outlive their task, and the
    allocators of Arrow and of the C library keep freed memory for themselves."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key's text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts

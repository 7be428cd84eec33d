"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundleflow.session import scratch_dir

# The ASCII spaces that separate words in the query contracts.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


BATCH_BYTES = 4 << 20  # of rows handed to a Python worker at once


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python workers in batches of bounded size, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Hand memory that this Python worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _c_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_trim = _c_trim()


def tidy(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that releases memory when it has ended."""

    @functools.wraps(rows)
    def run(batches: Iterator) -> Iterator:
        yield from rows(batches)
        release()

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_of(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base

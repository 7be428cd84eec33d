"""The registry sheet: all columns read as text, and its sink."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import upsert_registry

DEFAULT_CHUNK = 1000


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def scan_registry(spark: SparkSession, path: str, fmt: str = "csv", order: str | None = None) -> DataFrame:
    """CSV or Parquet with a header, every column a string; types are never inferred.

    ``order`` names a column to add that sorts rows as the sheet does: file, part of the file, and
    place in it.  It lets a later row of a registration number replace an earlier one.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    if order is None:
        return as_text(raw)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns], place.alias(order))


class SinkResult(NamedTuple):
    table: DataFrame | None
    rows: int | None
    sample: Row | None


def registry_sink(
    target: DataFrame, changes: DataFrame, run_ts: datetime | Column, dry_run: bool = False, seq: str | None = None
) -> SinkResult:
    """Upsert by registration number.  A dry run reports a count and one row, and merges nothing."""
    if dry_run:
        return SinkResult(None, changes.count(), changes.first())
    return SinkResult(upsert_registry(target, changes, run_ts, seq), None, None)


def write_jdbc(df: DataFrame, url: str, table: str, chunk: int = DEFAULT_CHUNK, **options: str) -> None:
    """Append to a database table in batches of ``chunk`` rows, in parallel per partition."""
    flat = df.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() == "struct" else F.col(c) for c in df.columns])
    flat.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(chunk), **options).mode("append").save()

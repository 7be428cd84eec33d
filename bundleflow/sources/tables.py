"""Versioned Parquet tables, and keyed writes.

Plain Parquet has no MERGE, so a merge writes a whole new version next to the old one.  A
version counts once its job has committed (``_SUCCESS``); readers take the newest such one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, ascending."""
    fs, path, make = _fs(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(make(f"{root}/{name}/_SUCCESS")):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def read_latest(spark: SparkSession, root: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Newest version (older than ``before``), or an empty table."""
    usable = [v for v in versions(spark, root) if before is None or v < before]
    if not usable:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/version={usable[-1]}")


def publish(df: DataFrame, root: str, version: int, max_records_per_file: int | None = None) -> str:
    """Write one version.  Writing a version again replaces it, so a repeated batch is harmless."""
    path = f"{root}/version={version}"
    writer = df.write.mode("overwrite")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def finish(spark: SparkSession, path: str) -> None:
    """Mark a folder of several written parts as committed."""
    fs, _, make = _fs(spark, path)
    fs.create(make(f"{path}/_SUCCESS"), True).close()


def blob_exists(keys: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys with a flag: already stored or not."""
    stored = existing.select(key).distinct().withColumn("_there", F.lit(True))
    return keys.join(stored, key, "left").select(*keys.columns, F.col("_there").isNotNull().alias("exists"))


def put_if_absent(new: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table after, outcome): only keys not stored are added; ``uploaded`` tells which.

    Of several rows with one new key one is stored, the smallest, and the others are no-ops.
    """
    rest = [c for c in new.columns if c != key]
    row = F.min(F.struct(*rest)) if rest else F.lit(True)
    calls = new.groupBy(key).agg(row.alias("_row"), F.count("*").cast("int").alias("_calls"))
    flagged = blob_exists(calls, existing, key)
    stored = flagged.filter(~F.col("exists")).select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in existing.columns])
    outcome = flagged.select(key, "exists", F.explode(F.sequence(F.lit(1), F.col("_calls"))).alias("_call"))
    return existing.unionByName(stored), outcome.select(key, (~F.col("exists") & (F.col("_call") == 1)).alias("uploaded"))

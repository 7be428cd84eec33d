"""Streaming forms: the batch operators per micro-batch, and de-duplication with its state in tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import WINDOW_SECONDS, dedup_within
from ..operators.match import match_registry_exact
from ..operators.merge import DOCUMENT_RANKS, PAGE_RANKS, page_changes
from ..operators.validate import enforce, manifest_checks, quarantine
from ..plans.ingest import ingest_changes
from ..schemas import DOCUMENTS, PAGES
from ..sources.changelog import ChangeLog, committed
from ..sources.queue import page_work_queue
from ..sources.tables import drop, finish

LATENESS = "1 hour"  # how far behind the newest message a straggler may be


def document_log(root: str) -> ChangeLog:
    return ChangeLog(f"{root}/documents", DOCUMENTS, ("document_id",), ranks=DOCUMENT_RANKS)


def page_log(root: str) -> ChangeLog:
    return ChangeLog(f"{root}/pages", PAGES, ("page_id",), ranks=PAGE_RANKS)


def stream_ingest(
    manifests: DataFrame,
    cover_texts: DataFrame,
    root: str,
    run_ts: datetime,
    strict: bool = False,
    fallback: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Ingest arriving manifests into the change logs of documents and pages under ``root``.

    A micro-batch appends its own rows; readers merge (``document_log(root).read``), and a separate
    job compacts.  Messages of a batch are written before its changes: if that write fails, no page
    becomes queued.  A repeated batch reads the tables before it and overwrites its own output, so
    re-delivery changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        accepted = batch
        if strict:
            accepted, refused = quarantine(batch, manifest_checks())
            refused.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch_id}")

        def store(part: str) -> Callable[[DataFrame], DataFrame]:
            def stored(rows: DataFrame) -> DataFrame:
                path = f"{root}/{part}/batch={batch_id}"
                rows.write.mode("overwrite").parquet(path)
                return spark.read.schema(rows.schema).parquet(path)

            return stored

        pages = page_log(root).read(spark, before=batch_id)
        found = ingest_changes(accepted, cover_texts, pages, fallback=fallback, materialize=store("classified"), store_batch=store("latest"))
        page_work_queue(found.messages).write.mode("overwrite").parquet(f"{root}/messages/batch={batch_id}")
        document_log(root).append(enforce(found.documents, partial=True), batch_id, run_ts)
        page_log(root).append(page_changes(found.pages), batch_id, run_ts)
        drop(spark, f"{root}/latest/batch={batch_id}")

    writer = manifests.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/_checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_dedup(
    messages: DataFrame, root: str, ids: list[str], ts: str = "ts", window_seconds: int = WINDOW_SECONDS, lateness: str = LATENESS,
    available_now: bool = True,
) -> StreamingQuery:
    """Write the messages that count to ``root/data``: per id the first, then each one at least a window after the last that counted.

    A message is decided once it lies ``lateness`` behind the newest one seen, when no earlier one
    can still arrive, so neither the order of arrival nor the cut into micro-batches changes the
    outcome.  Until then it waits, as a row, in ``root/state``; of an id only the time that last
    counted is kept, and that for a window.  The state of a batch replaces that of the batch before, so it is
    never larger than ``lateness`` and a window worth of messages, and a repeated batch begins where
    it began the first time.  Waiting messages are decided by ``dedup_within``, which spreads a busy
    id over tasks by time; no task holds the messages of an id.

    Messages that come later than that count as new, unless within a window of the last that counted
    as far as the state still knows it; late ones of one micro-batch are weighed among each other.
    Of messages with one id and time one stays, the smallest.  A message without a time or id
    cannot repeat anything and stays.  The last messages of a stream wait for a later one, of any id.
    """
    schema = T.StructType([T.StructField(f.name, T.TimestampType(), f.nullable) if f.name == ts else f for f in messages.schema.fields])
    key, at = "_id", "_us"
    last_schema = f"{key} string, _last bigint"
    allowed = int(pd.Timedelta(lateness).total_seconds() * 1_000_000)
    window = window_seconds * 1_000_000

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in committed(spark, f"{root}/state", "batch") if b < batch_id]
        held = f"{root}/state/batch={before[-1]}" if before else None
        mark = spark.read.schema("mark bigint").parquet(f"{held}/mark").first().mark if held else None
        lasts = spark.read.schema(last_schema).parquet(f"{held}/last") if held else spark.createDataFrame([], last_schema)
        typed = batch.withColumn(ts, F.col(ts).cast("timestamp")).select(*schema.names)
        named = typed.withColumn(key, F.to_json(F.struct(*ids), {"ignoreNullFields": "false"})).withColumn(at, F.unix_micros(ts))
        known = F.col(at).isNotNull() & F.concat(*[F.col(c).cast("string") for c in ids]).isNotNull()
        fresh = named.filter(known)
        late = fresh.filter(F.col(at) <= mark) if mark is not None else fresh.limit(0)
        waiting = spark.read.schema(named.schema).parquet(f"{held}/waiting") if held else named.limit(0)
        open_ = waiting.unionByName(fresh if mark is None else fresh.filter(F.col(at) > mark))
        newest = fresh.agg(F.max(at).alias("m")).first().m
        moved = max([m for m in (mark, None if newest is None else newest - allowed) if m is not None], default=None)
        # What is read back below is written first: the batch is then computed once.
        now = f"{root}/state/batch={batch_id}"
        open_.withColumn("_ready", F.col(at) <= F.lit(moved)).write.mode("overwrite").parquet(f"{now}/open")
        stored = spark.read.schema(T.StructType([*named.schema.fields, T.StructField("_ready", T.BooleanType())])).parquet(f"{now}/open")
        ready, rest = stored.filter("_ready").drop("_ready"), stored.filter("_ready IS NOT TRUE").drop("_ready")

        def counted(rows: DataFrame, seeds: DataFrame) -> DataFrame:
            """Of rows those that count after the seeds, one per id and time."""
            times = rows.select(key, F.timestamp_micros(at).alias("_t")).unionByName(seeds.select(key, F.timestamp_micros("_last").alias("_t")))
            kept = dedup_within(times, key, "_t", window_seconds).select(key, F.unix_micros("_t").alias(at))
            kept = kept.join(seeds.select(key, F.col("_last").alias(at)), [key, at], "left_anti")
            content = [c for c in rows.columns if c not in (key, at)]
            once = rows.groupBy(key, at).agg(F.min_by(F.struct(*content), F.xxhash64(*content)).alias("_row"))
            return once.join(kept, [key, at], "left_semi").select("_row.*", key, at)

        out = counted(ready, lasts).unionByName(named.filter(~F.coalesce(known, F.lit(False))))
        if mark is not None:
            near = F.abs(F.col(at) - F.col("_last")) < window
            far = late.join(lasts, key, "left").filter(~F.coalesce(near, F.lit(False))).drop("_last")
            out = out.unionByName(counted(far, lasts.limit(0)))
        out.select(*schema.names, key, at).write.mode("overwrite").parquet(f"{root}/decided/batch={batch_id}")
        decided = spark.read.schema(T.StructType([*schema.fields, *named.schema.fields[-2:]])).parquet(f"{root}/decided/batch={batch_id}")
        decided.select(*schema.names).write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")
        latest = decided.filter(F.col(at).isNotNull()).select(key, F.col(at).alias("_last")).unionByName(lasts).groupBy(key).agg(F.max("_last").alias("_last"))
        if moved is not None:
            latest = latest.filter(F.col("_last") + window > moved)
        latest.write.mode("overwrite").parquet(f"{now}/last")
        rest.write.mode("overwrite").parquet(f"{now}/waiting")
        spark.createDataFrame([(moved,)], "mark bigint").write.mode("overwrite").parquet(f"{now}/mark")
        finish(spark, now)
        for old in before[:-1]:
            drop(spark, f"{root}/state/batch={old}")
        drop(spark, f"{now}/open")

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/_checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_registry_match(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Arriving documents against the static registry."""
    return match_registry_exact(documents, registry)


def stream_idempotent_sink(
    pages: DataFrame, root: str, run_ts: datetime, available_now: bool = True
) -> StreamingQuery:
    """Append arriving page rows to a change log, tolerating repeats within and across batches."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != "page_id"]
        once = batch.groupBy("page_id").agg(F.max(F.struct(*rest)).alias("_r")).select(
            "page_id", *[F.col(f"_r.{c}").alias(c) for c in rest]
        )
        page_log(root).append(page_changes(once), batch_id, run_ts)

    writer = pages.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/_checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain a stream of what is there now into Parquet."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 10_000) -> DataFrame:
    """A Parquet folder, or a glob of files, as a stream with the schema of what is there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

"""Registered queries: Structured Streaming jobs, drained once over data written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import page_id
from ..session import scratch_dir
from ..sources.manifests import stream_manifests, write_manifests
from ..streaming import jobs as J
from .q_classify import INGESTED, table_summary
from .q_joins import EXACT, registry
from .q_sources import RUN_TS, manifests
from .registry import case


@case("stream_ingest", f"WITH {INGESTED}", "bundles")
def _(t):
    """Two arrivals of the same manifests, with a compaction between them: the second changes nothing."""
    root = scratch_dir(t.spark, "stream_ingest")
    texts = t("bundles").select("document_id", "cover_text")
    for _ in range(2):
        write_manifests(manifests(t), f"{root}/inbox")
        J.stream_ingest(stream_manifests(t.spark, f"{root}/inbox", multi_line=False), texts, f"{root}/tables", RUN_TS).awaitTermination()
        J.document_log(f"{root}/tables").compact(t.spark)
        J.page_log(f"{root}/tables").compact(t.spark, keep_last=0)
    return table_summary(J.document_log(f"{root}/tables").read(t.spark), J.page_log(f"{root}/tables").read(t.spark))


# Events arrive in lots of ten days, up to 39 minutes after their time.  One in 50 comes twelve days late, one
# of ten of those as the only message of its id, and one in 50 has no time.
_ARRIVING = """SELECT CASE WHEN event_id % 500 = 7 THEN -event_id ELSE user_id END AS user_id, event_type,
      CASE WHEN event_id % 50 = 8 THEN NULL ELSE ts END AS ts, coalesce(event_id % 50 = 7 AND ts < last - INTERVAL 2 DAYS, false) AS late,
      floor((unix_timestamp(ts) + CASE WHEN event_id % 50 = 7 AND ts < last - INTERVAL 2 DAYS THEN 1036800 ELSE event_id % 40 * 60 END) / 864000) AS lot
    FROM (SELECT event_id, user_id, event_type, cast(ts AS timestamp) AS ts, (SELECT cast(max(ts) AS timestamp) FROM {events}) AS last FROM {events})"""


@case("stream_dedup", f"""WITH RECURSIVE arriving AS ({_ARRIVING.replace("{events}", "events").replace("unix_timestamp", "epoch").replace("DAYS", "DAY")}),
    seen AS (SELECT DISTINCT user_id AS u, event_type AS k, CASE WHEN late THEN lot ELSE -1 END AS lot, ts FROM arriving WHERE ts IS NOT NULL),
    kept AS (SELECT u, k, lot, min(ts) AS ts FROM seen GROUP BY u, k, lot
      UNION ALL SELECT s.u, s.k, s.lot, min(s.ts) FROM kept q JOIN seen s ON s.u = q.u AND s.k = q.k AND s.lot = q.lot AND s.ts >= q.ts + INTERVAL 5 MINUTE GROUP BY s.u, s.k, s.lot)
    SELECT u AS user_id, k AS event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM kept
    UNION ALL SELECT user_id, event_type, NULL FROM arriving WHERE ts IS NULL""")
def _(t):
    """Lot after lot with the default lateness, then one message from the future to close the stream."""
    root = scratch_dir(t.spark, "stream_dedup")
    arriving = t.spark.sql(_ARRIVING, events=t("events"))
    ends = arriving.agg(F.min("lot").alias("a"), F.max("lot").alias("b"), F.max("ts").alias("end")).first()
    columns = ["user_id", "event_type", "ts"]
    far = t.spark.sql("SELECT cast(-1 AS bigint) AS user_id, 'close' AS event_type, :end + INTERVAL 2000 DAYS AS ts", args={"end": ends.end})
    for lot in [*range(int(ends.a), int(ends.b) + 1), None]:
        (far if lot is None else arriving.filter(F.col("lot") == lot).select(*columns)).write.mode("append").parquet(f"{root}/inbox")
        J.stream_dedup(J.stream_files(t.spark, f"{root}/inbox"), f"{root}/out", ["user_id", "event_type"]).awaitTermination()
    kept = t.spark.read.schema(arriving.select(*columns).schema).parquet(f"{root}/out/data").select(*columns).filter("event_type <> 'close'")
    return kept.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@case("stream_registry_match", f"WITH {EXACT} SELECT document_id, reference_data_id, match_status FROM exact", ("applicants", "person"))
def _(t):
    root = scratch_dir(t.spark, "stream_match")
    t("applicants").write.parquet(f"{root}/inbox")
    out = J.stream_registry_match(J.stream_files(t.spark, f"{root}/inbox"), registry(t))
    J.run_to_table(out.select("document_id", "reference_data_id", "match_status"), f"{root}/data", f"{root}/ck")
    return t.spark.read.parquet(f"{root}/data")


@case("stream_idempotent_sink", """SELECT document_id || ':' || cast(page_num AS string) AS page_id, 'queued' AS ocr_status, count(*) > 0 AS stored FROM bundle_pages_raw GROUP BY 1, 2""",
      "bundle_pages_raw")
def _(t):
    """Page rows with repeated keys, delivered twice."""
    root = scratch_dir(t.spark, "stream_sink")
    raw = t("bundle_pages_raw").select(
        page_id(F.col("document_id"), F.col("page_num")).alias("page_id"), "document_id",
        F.col("page_num").cast("int").alias("page_num"), F.lit("queued").alias("ocr_status"),
    )
    for _ in range(2):
        raw.write.mode("append").parquet(f"{root}/inbox")
        J.stream_idempotent_sink(J.stream_files(t.spark, f"{root}/inbox"), f"{root}/tables", RUN_TS).awaitTermination()
    table = J.page_log(f"{root}/tables").read(t.spark)
    return table.select("page_id", "ocr_status", F.col("page_num").isNotNull().alias("stored"))

"""Page-work messages for a queue, topic or table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import page_id

MESSAGE_FIELDS = ("document_id", "page_num", "s3_key", "document_category", "page_type")


def page_work_queue(messages: DataFrame) -> DataFrame:
    """(key, value): one JSON message per page, keyed by document so its pages stay in order."""
    return messages.select(F.col("document_id").alias("key"), F.to_json(F.struct(*MESSAGE_FIELDS)).alias("value"))


def queue_envelope(messages: DataFrame, fifo: bool = True) -> DataFrame:
    """Message body plus, for an ordered queue, its group and de-duplication id."""
    body = messages.select(
        "document_id", "page_num", F.to_json(F.struct(*MESSAGE_FIELDS)).alias("body")
    )
    if not fifo:
        return body.select("body")
    return body.select(
        "body", F.col("document_id").alias("group_id"),
        page_id(F.col("document_id"), F.col("page_num")).alias("dedup_id"),
    )


def write_messages(messages: DataFrame, target: str, fmt: str = "parquet", **options: str) -> None:
    """Send (key, value) rows to Kafka (``fmt='kafka'``, topic in ``target``) or append to files."""
    queue = page_work_queue(messages)
    if fmt == "kafka":
        queue.write.format("kafka").option("topic", target).options(**options).save()
    else:
        queue.write.mode("append").format(fmt).options(**options).save(target)

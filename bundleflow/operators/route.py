"""Manifest pages, routing decisions, page-work messages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import default_fill
from ..functions.keys import filename_from_key, page_id
from .validate import non_blank


def last_pages(pages: Column) -> Column:
    """The page list without entries that a later one of the same number replaces."""
    return F.filter(pages, lambda p, i: ~F.exists(F.slice(pages, i + 2, F.size(pages)), lambda q: q["page_num"].eqNullSafe(p["page_num"])))


def explode_pages(manifests: DataFrame) -> DataFrame:
    """One row per page of each manifest, in the page table's vocabulary; of a repeated page the last entry."""
    pages = manifests.select("document_id", F.explode(last_pages(F.col("pages"))).alias("p"))
    return pages.select(
        page_id(F.col("document_id"), F.col("p.page_num")).alias("page_id"),
        "document_id",
        F.col("p.page_num").alias("page_num"),
        F.col("p.s3_key").alias("s3_key_image"),
        F.col("p.page_type").alias("page_type"),
        F.col("p.language_hint").alias("language_detected"),
    )


def original_key(manifests: DataFrame) -> DataFrame:
    """Both manifest forms name the original object; either will do."""
    return manifests.withColumn("original_key", F.coalesce("original_s3_key", "s3_key_original"))


def document_rows(manifests: DataFrame) -> DataFrame:
    """First state of each document: category as received, page count from the page list."""
    keyed = original_key(manifests)
    return keyed.select(
        "document_id",
        default_fill(F.col("document_category"), "other").alias("document_category"),
        filename_from_key(F.col("original_key")).alias("original_filename"),
        "qr_content",
        F.col("original_key").alias("s3_key_pdf"),
        F.coalesce(F.size("pages"), F.lit(0)).alias("page_count"),
        F.lit("received").alias("status"),
        F.lit("{}").alias("metadata"),
    )


def document_states(classified: DataFrame, category: str = "document_category") -> DataFrame:
    """(document_id, document_category, match_status) after classification."""
    c = F.col(category)
    return classified.select(
        "document_id", c.alias("document_category"),
        F.when(c == "other", "manual_review").otherwise("pending").alias("match_status"),
    )


class Routing(NamedTuple):
    pages: DataFrame  # every page with its decision
    messages: DataFrame  # page-work rows
    states: DataFrame  # (document_id, page_num, ocr_status)


def route_pages(pages: DataFrame, classified: DataFrame, key: str = "s3_key_image") -> Routing:
    """'other' skips every page; otherwise blank pages are skipped and the rest queued."""
    c = classified.select("document_id", F.col("document_category").alias("_category"))
    joined = pages.join(c, "document_id")
    queued = (F.col("_category") != "other") & non_blank(F.col("page_type"))
    decided = joined.withColumn("ocr_status", F.when(queued, "queued").otherwise("skipped"))
    messages = decided.filter(F.col("ocr_status") == "queued").select(
        "document_id", "page_num", F.col(key).alias("s3_key"),
        F.col("_category").alias("document_category"),
        default_fill(F.col("page_type"), "other").alias("page_type"),
    )
    return Routing(decided.drop("_category"), messages, decided.select("document_id", "page_num", "ocr_status"))


def ingest_counts(routed: DataFrame) -> DataFrame:
    """Pages queued and skipped per document."""
    return routed.groupBy("document_id").agg(
        F.count_if(F.col("ocr_status") == "queued").alias("queued"),
        F.count_if((F.col("ocr_status") == "skipped") & F.col("page_type").eqNullSafe(F.lit("blank"))).alias("skipped_blank"),
        F.count("*").alias("pages"),
    )


def pages_per_document(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count("*").alias("page_count"))


def list_pages(pages: DataFrame, document_id: str) -> DataFrame:
    return pages.filter(F.col("document_id") == document_id).orderBy("page_num")


def pages_any(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages named by a (document_id, page_num) table."""
    return pages.join(wanted.select("document_id", "page_num"), ["document_id", "page_num"], "left_semi")

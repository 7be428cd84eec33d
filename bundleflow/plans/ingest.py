"""Manifests to tables and messages: one batch of bundles, one lineage."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.classify import classify_documents, flatten_result, with_qr
from ..operators.merge import upsert_documents, upsert_pages
from ..session import cut_lineage
from ..operators.route import document_rows, document_states, explode_pages, route_pages


class Changes(NamedTuple):
    documents: DataFrame  # changes of a batch, by document_id
    pages: DataFrame  # by document_id and page_num
    messages: DataFrame
    classified: DataFrame


class Ingest(NamedTuple):
    documents: DataFrame  # documents table after the batch
    pages: DataFrame  # pages table after the batch
    messages: DataFrame  # page work to send
    classified: DataFrame  # one classification row per bundle


# What tables and messages take from a manifest and its pages; digests and sizes are not shuffled.
_TAKEN = ("document_category", "qr_content", "original_s3_key", "s3_key_original", "pages")
_TAKEN_PAGE = ("page_num", "s3_key", "page_type", "language_hint")


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """One manifest per document, cut to what is ingested: a re-delivered one counts once, the newest wins."""
    rest = [c for c in manifests.columns if c != "document_id"]
    # A hash of the whole row settles equal times; rows with equal hashes are the same manifest.
    order = F.struct(F.coalesce(F.col("preprocessed_at"), F.lit("1970-01-01").cast("timestamp")), F.xxhash64(*rest))
    pages = F.transform("pages", lambda p: F.struct(*[p[c].alias(c) for c in _TAKEN_PAGE])).alias("pages")
    taken = F.struct(*[pages if c == "pages" else F.col(c) for c in _TAKEN])
    picked = manifests.select("document_id", taken.alias("_m"), order.alias("_o")).groupBy("document_id").agg(F.max_by("_m", "_o").alias("_m"))
    return picked.select("document_id", *[F.col(f"_m.{c}").alias(c) for c in _TAKEN])


def ingest_changes(
    manifests: DataFrame,
    cover_texts: DataFrame,
    pages: DataFrame,
    mode: str = "forward_only",
    fallback: Callable[[DataFrame], DataFrame] | None = None,
    materialize: Callable[[DataFrame], DataFrame] | None = cut_lineage,
    store_batch: Callable[[DataFrame], DataFrame] | None = None,
) -> Changes:
    """Classify and route a batch: what it changes in the tables, and the messages it sends.

    ``cover_texts``: (document_id, cover_text), the extracted text per bundle.  In ``forward_only``
    mode a page that ``pages`` has queued or done already is not sent again.  All outputs read the
    classification; ``materialize`` stores it and hands back the stored table, so it is computed
    once, and None leaves it in the plan.  ``store_batch`` does the same for the batch itself, of which
    each output would else read and shuffle the manifests again.
    """
    batch = latest_manifests(manifests)
    if store_batch is not None:
        batch = store_batch(batch)
    bundles = batch.select(
        "document_id", F.coalesce("document_category", F.lit("other")).alias("document_category"), "qr_content"
    )
    texts = bundles.join(cover_texts.select("document_id", "cover_text"), "document_id", "left").withColumn(
        "cover_text", with_qr(F.col("cover_text"), F.col("qr_content"))
    )
    classified = flatten_result(classify_documents(texts, fallback=fallback))
    if materialize is not None:
        classified = materialize(classified)

    states = document_states(classified)
    doc_changes = document_rows(batch).drop("document_category").join(states, "document_id")
    routing = route_pages(explode_pages(batch), classified)

    messages = routing.messages
    if mode == "forward_only":
        advanced = pages.filter(F.col("ocr_status") != "pending").select("document_id", "page_num")
        messages = messages.join(advanced, ["document_id", "page_num"], "left_anti")
    return Changes(doc_changes, routing.pages, messages, classified)


def ingest_manifests(
    manifests: DataFrame,
    cover_texts: DataFrame,
    documents: DataFrame,
    pages: DataFrame,
    run_ts: datetime | Column,
    mode: str = "forward_only",
    fallback: Callable[[DataFrame], DataFrame] | None = None,
    materialize: Callable[[DataFrame], DataFrame] | None = cut_lineage,
) -> Ingest:
    """Upsert, classify, route and final states for a batch; see ``ingest_changes``.

    First and final state of a row reach its table in one merge, so each table is shuffled once per
    batch.  In ``forward_only`` mode a re-run of the same batch changes nothing.
    """
    found = ingest_changes(manifests, cover_texts, pages, mode, fallback, materialize)
    return Ingest(
        upsert_documents(documents, found.documents, run_ts, mode),
        upsert_pages(pages, found.pages, run_ts, mode),
        found.messages,
        found.classified,
    )

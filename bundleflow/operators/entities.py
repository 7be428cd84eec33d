"""OCR tokens and page text to trusted tokens, entities and page structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import devanagari_digits
from ..functions.rulepacks import PAGE_RULES, Rule
from .classify import classify_text
from .joins import left_join_spread_nulls
from .match import best_edit_match

# --- Fixed values --------------------------------------------------------------------
TOKEN_THRESHOLD = 70.0
DATE_PATTERN = r"\b(\d{2}/\d{2}/\d{4})\b"
# a registration number stands alone: the tail of an application number is not one
ID_PATTERNS = {"registration_no": r"(?<![\w-])([A-Z]-\d{5,})\b", "application_no": r"\b(AMR-MCH-26-A-\d{5})\b"}
# -------------------------------------------------------------------------------------
PHONE_PATTERN = r"(?<![\w-])(\d{10})(?![\w-])"  # ours: ten digits standing alone


def flag_tokens(tokens: DataFrame, threshold: float = TOKEN_THRESHOLD) -> DataFrame:
    return tokens.withColumn("low_confidence", F.col("conf") < threshold)


def low_confidence_tokens(tokens: DataFrame, threshold: float = TOKEN_THRESHOLD) -> DataFrame:
    """Low tokens per page: count, total and ratio."""
    low = F.count_if(F.col("conf") < threshold)
    return tokens.groupBy("document_id", "page_num").agg(
        low.alias("low_tokens"), F.count("*").alias("tokens"), (low / F.count("*")).alias("low_ratio")
    )


def page_mean_confidence(tokens: DataFrame, threshold: float = TOKEN_THRESHOLD) -> DataFrame:
    """Mean token confidence per page and the text route it implies."""
    mean = tokens.groupBy("document_id", "page_num").agg(F.avg("conf").alias("mean_conf"))
    return mean.withColumn("route", F.when(F.col("mean_conf") >= threshold, "tier1").otherwise("fallback"))


def confidence_route(tokens: DataFrame, threshold: float = TOKEN_THRESHOLD) -> DataFrame:
    """Per document: pages on fallback, and manual_review as soon as one page is low."""
    pages = page_mean_confidence(tokens, threshold)
    fallback = F.count_if(F.col("route") == "fallback")
    return pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), fallback.alias("fallback_pages"),
        F.when(fallback > 0, "manual_review").otherwise("tier1").alias("route"),
    )


def augment_tokens(
    tokens: DataFrame, lexicon: DataFrame, value: str, threshold: float = TOKEN_THRESHOLD,
    score: float = 85.0,
) -> DataFrame:
    """Replace low-confidence tokens by the nearest registry value, or flag them.

    Adds ``final_text`` and ``source``: 'ocr' for trusted tokens, 'augmented' where a value
    scored at least ``score``, 'manual_review' otherwise.  Only distinct low spellings are
    looked up, so a spelling repeated on every page is matched once.
    """
    low = F.col("conf") < threshold
    spellings = tokens.filter(low).select(F.lower("text").alias("_spelling")).distinct()
    words = lexicon.select(F.lower(F.col(value)).alias("_word")).distinct()
    found = best_edit_match(
        spellings.select(F.lit("").alias("block"), F.col("_spelling").alias("text")),
        words.select(F.lit("").alias("block"), F.col("_word").alias("text"), F.col("_word").alias("payload")),
        score,
    ).select(F.col("text").alias("_spelling"), F.col("payload").alias("_found"))
    keyed = tokens.withColumn("_spelling", F.when(low, F.lower("text")))
    joined = left_join_spread_nulls(keyed, found, ["_spelling"], "document_id")
    return joined.select(
        *tokens.columns,
        F.when(low, F.coalesce(F.col("_found"), F.col("text"))).otherwise(F.col("text")).alias("final_text"),
        F.when(~low, "ocr").when(F.col("_found").isNotNull(), "augmented").otherwise("manual_review").alias("source"),
    )


def iso_dates(text: Column) -> Column:
    """ISO dates of all DD/MM/YYYY in the text, Devanagari digits included; impossible ones dropped."""
    found = F.regexp_extract_all(devanagari_digits(text), F.lit(DATE_PATTERN), F.lit(1))
    parsed = F.transform(found, lambda d: F.date_format(F.try_to_timestamp(d, F.lit("dd/MM/yyyy")), "yyyy-MM-dd"))
    return F.filter(parsed, lambda d: d.isNotNull())


def phones(text: Column) -> Column:
    return F.regexp_extract_all(devanagari_digits(text), F.lit(PHONE_PATTERN), F.lit(1))


def ids(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(ID_PATTERNS[kind]), F.lit(1))


def entity_array(text: Column, confidence: Column | None = None) -> Column:
    """Array of (type, value, confidence, source), distinct on (type, value), in type order."""
    conf = confidence if confidence is not None else F.lit(1.0)

    def typed(kind: str, values: Column) -> Column:
        return F.transform(
            F.array_distinct(values),
            lambda v: F.struct(
                F.lit(kind).alias("type"), v.alias("value"), conf.cast("double").alias("confidence"),
                F.lit("ocr").alias("source"),
            ),
        )

    return F.concat(
        typed("date", iso_dates(text)),
        typed("phone", phones(text)),
        *[typed(kind, ids(text, kind)) for kind in ID_PATTERNS],
    )


def entity_table(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per page entity: (document_id, page_num, type, value, confidence, source)."""
    return pages.select("document_id", "page_num", F.explode(entity_array(F.col(text))).alias("e")).select(
        "document_id", "page_num", "e.type", "e.value", "e.confidence", "e.source"
    )


def structured_json(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Pages with the nested record as JSON; built row by row, nothing is collected."""
    record = F.struct(
        "document_id", "page_num",
        F.col("page_type") if "page_type" in pages.columns else F.lit(None).cast("string").alias("page_type"),
        entity_array(F.col(text)).alias("entities"), F.col(text).alias("raw_text"),
    )
    return pages.select("document_id", "page_num", F.to_json(record).alias("structured_json"))


def entity_types_payload(entities: DataFrame) -> DataFrame:
    """Distinct entity types per page, sorted; the set is bounded by the number of types."""
    return entities.groupBy("document_id", "page_num").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("entity_types")
    )


def page_type_rules(pages: DataFrame, text: str, rules: Sequence[Rule] = PAGE_RULES) -> DataFrame:
    """Page type by keyword; 'other' when no keyword fires."""
    ruled = classify_text(pages, text, rules, (), floor=1.0, out="_page")
    return ruled.select(*pages.columns, F.coalesce(F.col("_page.category"), F.lit("other")).alias("detected_type"))


def layout_blocks(pages: DataFrame, text: str) -> DataFrame:
    """Lines with a block type: table, key_value, header (the first text line) or body."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda s: F.trim(s) != "")
    rows = pages.select("document_id", "page_num", F.posexplode(lines).alias("pos", "line"))
    kind = (
        F.when(F.col("line").rlike(r"\t|\S {2,}\S+ {2,}\S"), "table")
        .when(F.col("line").rlike(r"^[^:]{1,40}:\s"), "key_value")
        .when(F.col("pos") == 0, "header")
        .otherwise("body")
    )
    return rows.select("document_id", "page_num", F.col("pos").cast("bigint").alias("line_no"), "line", kind.alias("block"))

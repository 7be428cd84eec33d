"""Bundle classification: scores, winner, subtype, signals, decision order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from ..functions.plan import fence
from ..functions.rulepacks import (
    BUNDLE_RULES,
    BUNDLE_TYPE_RULES,
    MIN_SCORE,
    Rule,
    TypeRule,
    categories_of,
    first_type,
    fold,
    score_columns,
    signal_array,
)

# --- Fixed values --------------------------------------------------------------------
FALLBACK_BELOW = 0.55
HINT_CONFIDENCE = 0.85
COVER_PAGES = 3
MIN_TEXT_LAYER = 30
# -------------------------------------------------------------------------------------

RESULT_FIELDS = (
    "document_category", "document_type", "confidence", "method", "signals",
    "match_reference_data", "skip_ocr",
)
RESULT_DDL = (
    "document_category string, document_type string, confidence double, method string, "
    "signals array<string>, match_reference_data boolean, skip_ocr boolean"
)


def _score_name(category: str) -> str:
    return f"_score_{category}"


def score_text(df: DataFrame, text: str, rules: Sequence[Rule] = BUNDLE_RULES, prefix: str = "score_") -> DataFrame:
    """One score column per category; 0.0 where nothing fires."""
    lowered = fold(F.coalesce(F.col(text), F.lit("")))
    staged = df.withColumn("_lowered", lowered)
    return staged.select(
        *df.columns, *[c.alias(prefix + name) for name, c in score_columns("_lowered", rules).items()]
    )


def with_winner(df: DataFrame, scores: Mapping[str, str], floor: float = MIN_SCORE, out: str = "_win") -> DataFrame:
    """Adds struct (category, confidence) from the score columns (category -> column).

    Best score wins, ties go to the first category, and the struct is null below ``floor``.
    Best and runner-up are columns of their own: inside a condition they would be sorted out
    again at every mention.
    """
    ranked = F.sort_array(F.array(*scores.values()), asc=False) if len(scores) > 1 else F.array(*scores.values(), F.lit(0.0))
    staged = df.withColumn("_ranked", ranked)
    best, runner_up = F.col("_ranked")[0], F.col("_ranked")[1]
    name = F.coalesce(*[F.when(F.col(c) == best, F.lit(n)) for n, c in scores.items()])
    confidence = F.least(best / (best + runner_up + F.lit(1.0)), F.lit(1.0))
    found = F.when(best >= floor, F.struct(name.alias("category"), confidence.alias("confidence")))
    return staged.select(*df.columns, found.alias(out))


def classify_text(
    df: DataFrame,
    text: str,
    rules: Sequence[Rule] = BUNDLE_RULES,
    type_rules: Sequence[TypeRule] = BUNDLE_TYPE_RULES,
    floor: float = MIN_SCORE,
    out: str = "rules_result",
) -> DataFrame:
    """Adds struct (category, document_type, confidence, signals); null when no rule set wins.

    Four narrow projections: text folding, scores, winner, then subtype and signals of the
    winner only.  Keeping them apart bounds the size of each generated method.
    """
    names = categories_of(rules)
    lowered = df.withColumn("_lowered", fold(F.col(text)))
    scored = lowered.select(
        "*", *[c.alias(_score_name(n)) for n, c in score_columns("_lowered", rules).items()]
    )
    won = with_winner(scored, {n: _score_name(n) for n in names}, floor)
    category = F.col("_win.category")
    detail = F.struct(
        category.alias("category"),
        (first_type("_lowered", "_win.category", type_rules) if type_rules else F.lit(None).cast("string")).alias(
            "document_type"
        ),
        F.col("_win.confidence").alias("confidence"),
        signal_array("_lowered", "_win.category", rules).alias("signals"),
    )
    fenced = fence(won, **{out: F.when(F.col("_win").isNotNull(), detail)})
    return fenced.select(*df.columns, out)


def _result(
    category: Column, document_type: Column, confidence: Column, method: str, signals: Column
) -> Column:
    return F.struct(
        category.alias("document_category"),
        document_type.alias("document_type"),
        confidence.alias("confidence"),
        F.lit(method).alias("method"),
        signals.alias("signals"),
        (category == "practitioner").alias("match_reference_data"),
        F.lit(False).alias("skip_ocr"),
    )


def default_other() -> Column:
    return _result(
        F.lit("other"), F.lit(None).cast("string"), F.lit(0.0), "rules", F.array(F.lit("no_signals_matched"))
    )


def manifest_hint(category: Column) -> Column:
    """Result struct for a trusted category set upstream; null for 'other' or no category."""
    label = F.concat(F.lit("manifest.document_category='"), category, F.lit("'"))
    hint = _result(category, F.lit(None).cast("string"), F.lit(HINT_CONFIDENCE), "manifest_hint", F.array(label))
    return F.when(category.isNotNull() & (category != "other"), hint)


def with_qr(text: Column, qr: Column) -> Column:
    """Text followed by the decoded sticker on a line of its own."""
    suffix = F.when(F.coalesce(qr, F.lit("")) != "", F.concat(F.lit("\nQR:"), strip(qr))).otherwise(F.lit(""))
    return F.concat(F.coalesce(text, F.lit("")), suffix)


def text_layer_too_short(text: Column, minimum: int = MIN_TEXT_LAYER) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < minimum


def cover_text_first_n(pages: DataFrame, n: int = COVER_PAGES, text: str = "layer_text") -> DataFrame:
    """(document_id, cover_text): text of the first ``n`` pages joined by newline.

    ``rank <= n`` lets Spark keep only n rows per document before the shuffle, so a document
    with very many pages costs no more than a short one.
    """
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("page_num"))
    first = pages.select("document_id", "page_num", text).withColumn("_rank", rank).filter(F.col("_rank") <= n)
    slots = [F.max(F.when(F.col("_rank") == i, F.coalesce(F.col(text), F.lit("")))) for i in range(1, n + 1)]
    return first.groupBy("document_id").agg(F.concat_ws("\n", *slots).alias("cover_text"))


def cover_page(pages: DataFrame, *extra: str) -> DataFrame:
    """First non-blank page of each document; the first page when all are blank.

    An aggregate, not a window: each task reduces a document to one row before the shuffle.
    """
    is_blank = F.col("page_type").eqNullSafe(F.lit("blank"))
    picked = F.min_by(F.struct("page_num", "s3_key", *extra), F.struct(is_blank, F.col("page_num")))
    return pages.groupBy("document_id").agg(picked.alias("_p")).select(
        "document_id", F.col("_p.page_num").alias("page_num"), F.col("_p.s3_key").alias("s3_key"),
        *[F.col(f"_p.{c}").alias(c) for c in extra],
    )


def cover_text(pages: DataFrame, bundles: DataFrame) -> DataFrame:
    """Bundles (document_id, qr_content, …) with ``cover_text``.

    The text layer of the first pages is used; when it is too short it is replaced by the
    OCR text of the cover page.  Both inputs are keyed by document, so the joins reuse the
    partitioning of the two aggregates.
    """
    layer = cover_text_first_n(pages)
    ocr = cover_page(pages, "ocr_text").select("document_id", "ocr_text")
    joined = bundles.join(layer, "document_id", "left").join(ocr, "document_id", "left")
    base = F.when(
        text_layer_too_short(F.col("cover_text")), F.coalesce(F.col("ocr_text"), F.lit(""))
    ).otherwise(F.col("cover_text"))
    return joined.select(*bundles.columns, with_qr(base, F.col("qr_content")).alias("cover_text"))


def classify_documents(
    df: DataFrame,
    text: str = "cover_text",
    hint: str = "document_category",
    rules: Sequence[Rule] = BUNDLE_RULES,
    type_rules: Sequence[TypeRule] = BUNDLE_TYPE_RULES,
    fallback: Callable[[DataFrame], DataFrame] | None = None,
    out: str = "result",
) -> DataFrame:
    """Adds the result struct.  Order: hint, empty text, confident rules, fallback, weak rules.

    ``fallback`` is an optional second classifier.  It receives only rows the rules were not
    confident about and returns them with a nullable struct column ``fallback_result``
    (document_category, document_type, confidence); null means it had no answer.
    """
    hinted = df.withColumn("_hint", manifest_hint(F.col(hint)))
    # Rows decided by the hint get null text, so their rules are not evaluated.
    staged = hinted.withColumn("_text", F.when(F.col("_hint").isNull(), F.coalesce(F.col(text), F.lit(""))))
    ruled = classify_text(staged, "_text", rules, type_rules, out="_rules")
    r = F.col("_rules")
    confident = _result(r["category"], r["document_type"], r["confidence"], "rules", r["signals"])
    weak = _result(
        r["category"], r["document_type"], r["confidence"], "rules",
        F.concat(r["signals"], F.array(F.lit("[llm_skipped]"))),
    )
    empty = F.col("_hint").isNull() & (strip(F.col("_text")) == "")
    sure = F.coalesce(
        F.col("_hint"),
        F.when(empty, default_other()),
        F.when(r.isNotNull() & (r["confidence"] >= FALLBACK_BELOW), confident),
    )
    unsure = F.coalesce(F.when(r.isNotNull(), weak), default_other())
    if fallback is None:
        return fence(ruled, **{out: F.coalesce(sure, unsure)}).select(*df.columns, out)

    staged = fence(ruled, _sure=sure, _unsure=unsure).select(*df.columns, "_sure", "_unsure")
    settled = staged.filter(F.col("_sure").isNotNull()).select(*df.columns, F.col("_sure").alias(out))
    # A Python UDF inside coalesce would run on every row: split first, then union.
    asked = fallback(staged.filter(F.col("_sure").isNull()).drop("_sure"))
    f = F.col("fallback_result")
    answer = _result(
        f["document_category"], f["document_type"], f["confidence"], "llm", F.array(F.lit("llm_fallback"))
    )
    decided = asked.select(*df.columns, F.coalesce(F.when(f.isNotNull(), answer), F.col("_unsure")).alias(out))
    return settled.unionByName(decided)


def flatten_result(df: DataFrame, keys: Sequence[str] = ("document_id",), result: str = "result") -> DataFrame:
    return df.select(*keys, *[F.col(f"{result}.{f}").alias(f) for f in RESULT_FIELDS])

"""Lookups, predicates and checks.  A check returns the violating rows, or flag columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import page_id
from ..schemas import (
    CATEGORIES,
    DOCUMENT_PATCHABLE,
    DOCUMENT_STATUSES,
    MANIFEST_VERSIONS,
    MATCH_STATUSES,
    OCR_STATUSES,
)

ENUMS: dict[str, tuple[Sequence[str], bool]] = {  # column -> (allowed values, null allowed)
    "document_category": (CATEGORIES, False),
    "status": (DOCUMENT_STATUSES, False),
    "match_status": (MATCH_STATUSES, True),
    "ocr_status": (OCR_STATUSES, False),
}


def get_document(documents: DataFrame, document_id: str) -> DataFrame:
    return documents.filter(F.col("document_id") == document_id)


def get_page(pages: DataFrame, document_id: str, page_num: int) -> DataFrame:
    """Both parts of the id are tested as well, so file statistics on either can prune."""
    return pages.filter(
        (F.col("document_id") == document_id)
        & (F.col("page_num") == page_num)
        & (F.col("page_id") == page_id(F.lit(document_id), F.lit(page_num)))
    )


def non_blank(page_type: Column) -> Column:
    return ~page_type.eqNullSafe(F.lit("blank"))


def enum_violation(column: str) -> Column:
    allowed, nullable = ENUMS[column]
    c = F.col(column)
    bad = ~c.isin(*allowed)
    return F.coalesce(bad, F.lit(not nullable))


def range_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Violation predicate per known numeric column."""
    rules = {
        "page_count": lambda c: c < 0,
        "page_num": lambda c: c < 1,
        "confidence_score": lambda c: (c < 0) | (c > 100),
        "confidence": lambda c: (c < 0) | (c > 1),
        "script_conf": lambda c: (c < 0) | (c > 1),
        "content_type_conf": lambda c: (c < 0) | (c > 1),
    }
    return {n: F.coalesce(rules[n](F.col(n)), F.lit(False)) for n in columns if n in rules}


def violations(df: DataFrame, checks: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys…, violation): one row per failed check, in one pass over the rows."""
    failed = F.filter(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull()
    )
    return df.select(*keys, F.explode(failed).alias("violation"))


def check_enums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return violations(df, {n: enum_violation(n) for n in ENUMS if n in df.columns}, keys)


def check_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return violations(df, range_rules(df.columns), keys)


def enforce(df: DataFrame, partial: bool = False) -> DataFrame:
    """Raise mode: the job fails on the first row that breaks an enum or a range.

    ``partial`` rows are changes, where null means "not supplied" and passes.
    """
    checks = {n: enum_violation(n) for n in ENUMS if n in df.columns} | range_rules(df.columns)

    def guarded(name: str) -> Column:
        value, bad = F.col(name), checks[name]
        if partial:
            bad = value.isNotNull() & bad
        message = F.concat(F.lit(f"invalid {name}: "), F.coalesce(value.cast("string"), F.lit("null")))
        return F.when(bad, F.raise_error(message).cast(df.schema[name].dataType)).otherwise(value).alias(name)

    return df.select(*[guarded(c) if c in checks else F.col(c) for c in df.columns])


def manifest_checks() -> dict[str, Column]:
    """Strict manifest contract, violation predicates."""
    def is64(c: Column) -> Column:
        return F.coalesce(F.length(c) == 64, F.lit(False))

    pages = F.col("pages")
    return {
        "document_id": ~is64(F.col("document_id")),
        "original_sha256": ~is64(F.col("original_sha256")),
        "page_count": ~F.coalesce(F.col("page_count") > 0, F.lit(False)),
        "schema_version": ~F.coalesce(F.col("schema_version").isin(*MANIFEST_VERSIONS), F.lit(False)),
        "page_num": F.coalesce(F.exists(pages, lambda p: ~F.coalesce(p["page_num"] >= 1, F.lit(False))), F.lit(True)),
        "page_repeated": F.coalesce(F.size(F.array_distinct(F.transform(pages, lambda p: p["page_num"]))) < F.size(pages), F.lit(False)),
        "page_size": F.coalesce(
            F.exists(pages, lambda p: ~F.coalesce((p["width"] > 0) & (p["height"] > 0), F.lit(False))), F.lit(True)
        ),
        "page_sha256": F.coalesce(F.exists(pages, lambda p: ~is64(p["sha256"])), F.lit(True)),
    }


def check_manifest(df: DataFrame, keys: Sequence[str] = ("document_id",)) -> DataFrame:
    return violations(df, manifest_checks(), keys)


def quarantine(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused); refused rows carry the list of failed checks."""
    failed = F.filter(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull()
    )
    flagged = df.withColumn("violations", failed)
    return flagged.filter(F.size("violations") == 0).drop("violations"), flagged.filter(F.size("violations") > 0)


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the count; counted map-side first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The job fails if a key repeats, as a database does for one multi-row upsert."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.first(F.struct(*rest) if rest else F.lit(True)).alias("_row"), F.count("*").alias("_n"))
    message = F.concat(F.lit("duplicate key in one batch: "), F.to_json(F.struct(*keys)))

    def guarded(c: str) -> Column:
        value = F.col(c) if c in keys else F.col(f"_row.{c}")
        return F.when(F.col("_n") > 1, F.raise_error(message).cast(df.schema[c].dataType)).otherwise(value).alias(c)

    return counted.select(*[guarded(c) for c in df.columns])


def check_foreign_key(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def missing_columns(columns: Sequence[str], expected: Sequence[str]) -> list[str]:
    return sorted(set(expected) - set(columns))


def check_schema(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(column_name, present, filled_rows) per expected column; extra columns are allowed."""
    counts = [
        (F.count(F.col(c)) if c in df.columns else F.lit(0).cast("bigint")).alias(c) for c in expected
    ]
    one = df.agg(*counts)
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), F.col(c).alias("filled_rows"))
            for c in expected
        ]
    )
    return one.select(F.inline(entries))


def partial_predicate(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def by_values(df: DataFrame, **allowed: str | Sequence[str]) -> DataFrame:
    """Equality filters, e.g. ``by_values(docs, status='received', document_category=['letter'])``."""
    for column, value in allowed.items():
        values = [value] if isinstance(value, str) else list(value)
        df = df.filter(F.col(column).isin(*values))
    return df


def json_contains(json: Column, path: str, value: str) -> Column:
    """Top-level containment test on a JSON text column; false when absent."""
    return F.coalesce(F.get_json_object(json, path) == value, F.lit(False))


def json_array_contains(json: Column, path: str, value: str) -> Column:
    items = F.from_json(F.get_json_object(json, path), "array<string>")
    return F.coalesce(F.array_contains(items, value), F.lit(False))


def update_whitelist(columns: Sequence[str]) -> None:
    bad = sorted(set(columns) - set(DOCUMENT_PATCHABLE))
    if bad:
        raise ValueError(f"columns not open to targeted update: {bad}")


def vector_dim_check(df: DataFrame, vector: str, dim: int) -> Column:
    return F.coalesce(F.size(F.col(vector)) == dim, F.lit(False))


def missing_names(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct expected values that are not present."""
    return expected.distinct().exceptAll(actual.distinct())


def contains_all(df: DataFrame, group: str, value: str, required: Sequence[str]) -> DataFrame:
    """Per group: are all required values present?  One boolean per value, so no set is collected."""
    seen = [F.coalesce(F.bool_or(F.col(value) == r), F.lit(False)) for r in required]
    complete = seen[0]
    for s in seen[1:]:
        complete = complete & s
    return df.groupBy(group).agg(complete.alias("complete"))

"""Idempotent table mutation: (target, changes) -> new target.

Every function is a pure DataFrame transformation on unique keys; ``sources.tables`` swaps
the result in.  One full outer join per merge, on the table's key, which is also how the
tables are best laid out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import page_id, surrogate_id
from ..schemas import (
    DOCUMENT_STATUS_RANK,
    DOCUMENT_STATUSES,
    DOCUMENTS,
    MATCH_STATUS_RANK,
    OCR_STATUS_RANK,
    OCR_STATUSES,
    PAGES,
    REGISTRY,
)
from .joins import left_join_spread_nulls
from .validate import enforce, require_unique, update_whitelist

AUDIT = ("created_at", "updated_at")
MODES = ("overwrite", "forward_only")


def _ts(run_ts: datetime | Column) -> Column:
    return run_ts if isinstance(run_ts, Column) else F.lit(run_ts).cast("timestamp")


def touch_updated_at(changed: Column, updated_at: Column, run_ts: datetime | Column) -> Column:
    """The run's timestamp on a changed row, else the old one; passed in, so re-runs agree."""
    return F.when(changed, _ts(run_ts)).otherwise(updated_at)


def last_write_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last row per key by ``seq``.

    ``max_by`` reduces every key to one row inside each task, so a key with very many rows
    is never gathered anywhere; a row_number window would sort it in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def one_row_per_key(changes: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """Changes reduced to one row per key, so that no merge can multiply rows.

    With ``seq`` the last row wins and the column is dropped.  Without it a row given twice
    counts once, and two different rows of one key fail the job: their order is not known.
    """
    if seq is not None:
        return last_write_wins(changes, keys, seq).drop(seq)
    rest = [c for c in changes.columns if c not in keys]
    if not rest:
        return changes.distinct()
    content = F.xxhash64(*rest)
    picked = changes.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row"), F.min(content).alias("_low"), F.max(content).alias("_high"))
    message = F.concat(F.lit("duplicate key in one batch: "), F.to_json(F.struct(*keys)))
    clash = F.col("_low") != F.col("_high")
    row = F.when(clash, F.raise_error(message).cast(picked.schema["_row"].dataType)).otherwise(F.col("_row"))
    picked = picked.withColumn("_row", row)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in changes.columns])


def rank_of(status: Column, ranks: Mapping[str, int]) -> Column:
    expr = F.lit(-1)
    for name, rank in ranks.items():
        expr = F.when(status == name, F.lit(rank)).otherwise(expr)
    return expr


def forward(new: Column, old: Column, ranks: Mapping[str, int]) -> Column:
    """The new state unless it would step back or leave a final one."""
    n, o = rank_of(new, ranks), rank_of(old, ranks)
    moves = old.isNull() | (n > o) | ((n == o) & (o < max(ranks.values())))
    return F.when(moves & new.isNotNull(), new).otherwise(old)


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    run_ts: datetime | Column,
    mode: str = "overwrite",
    ranks: Mapping[str, Mapping[str, int]] | None = None,
    keep: Sequence[str] = (),
    seq: str | None = None,
    created: Column | None = None,
    unique: bool = False,
) -> DataFrame:
    """Insert or update by unique key; ``seq`` orders changes of one key (see ``one_row_per_key``).

    ``overwrite``: every incoming non-key column replaces the old value, null included.
    ``forward_only``: null keeps the old value and columns in ``ranks`` never step back.
    ``created_at`` and columns in ``keep`` survive; ``updated_at`` moves on touched rows.
    Columns the changes lack: kept on update, null on insert.  ``created`` is the creation time of
    new rows if it is not the run's.  ``unique``: the changes are known to have one row per key.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    changes = changes.drop(*AUDIT) if unique else one_row_per_key(changes.drop(*AUDIT), keys, seq)
    incoming = changes.columns
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    c = changes.select(*incoming, F.lit(True).alias("_in_c")).alias("c")
    joined = t.join(c, [F.col(f"t.{k}") == F.col(f"c.{k}") for k in keys], "full_outer")
    touched, existed = F.col("_in_c").isNotNull(), F.col("_in_t").isNotNull()

    def value(name: str) -> Column:
        old, new = F.col(f"t.{name}"), F.col(f"c.{name}") if name in incoming else None
        if name in keys:
            return F.coalesce(old, new)
        if name == "created_at":
            return F.coalesce(old, F.when(touched, _ts(run_ts) if created is None else created))
        if name == "updated_at":
            return touch_updated_at(touched, old, run_ts)
        if new is None:
            return old
        if name in keep:
            return F.when(existed, old).otherwise(new)
        if mode == "forward_only":
            if ranks and name in ranks:
                return F.when(touched, forward(new, old, ranks[name])).otherwise(old)
            return F.coalesce(new, old)
        return F.when(touched, new).otherwise(old)

    return joined.select(
        *[value(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    )


DOCUMENT_RANKS = {"status": DOCUMENT_STATUS_RANK, "match_status": MATCH_STATUS_RANK}
PAGE_RANKS = {"ocr_status": OCR_STATUS_RANK}


def page_changes(changes: DataFrame) -> DataFrame:
    """Checked page changes with their key."""
    keyed = changes if "page_id" in changes.columns else changes.withColumn("page_id", page_id(F.col("document_id"), F.col("page_num")))
    return enforce(keyed, partial=True)


def upsert_documents(
    target: DataFrame, changes: DataFrame, run_ts: datetime | Column, mode: str = "forward_only", seq: str | None = None
) -> DataFrame:
    return upsert(target, enforce(changes, partial=True), ["document_id"], run_ts, mode, DOCUMENT_RANKS, seq=seq)


def upsert_pages(
    target: DataFrame, changes: DataFrame, run_ts: datetime | Column, mode: str = "forward_only", seq: str | None = None
) -> DataFrame:
    return upsert(target, page_changes(changes), ["page_id"], run_ts, mode, PAGE_RANKS, seq=seq)


def bulk_upsert_pages(target: DataFrame, changes: DataFrame, run_ts: datetime | Column, mode: str = "overwrite") -> DataFrame:
    """One statement for many pages; a page twice in the batch is an error."""
    return upsert_pages(target, require_unique(changes, ["document_id", "page_num"]), run_ts, mode)


def insert_if_absent(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], run_ts: datetime | Column, seq: str | None = None
) -> DataFrame:
    fresh = one_row_per_key(changes, keys, seq).join(target.select(*keys), list(keys), "left_anti")
    audited = fresh.withColumn("created_at", _ts(run_ts)).withColumn("updated_at", _ts(run_ts))
    return target.unionByName(audited.select(*[c for c in target.columns if c in audited.columns]), allowMissingColumns=True)


def upsert_registry(target: DataFrame, changes: DataFrame, run_ts: datetime | Column, seq: str | None = None) -> DataFrame:
    """Full overwrite by registration number; ``id`` and ``created_at`` survive.

    ``seq`` orders repeated keys in the batch: the last one wins.
    """
    with_id = changes.withColumn("id", surrogate_id(F.col("registration_no")))
    return upsert(target, with_id, ["registration_no"], run_ts, "overwrite", keep=("id",), seq=seq)


def _against(target: DataFrame, changes: DataFrame, keys: Sequence[str], strict: bool, seq: str | None = None) -> DataFrame:
    """Target rows with their change; a change without a row stays only under ``strict``, to fail the job in ``_replace``."""
    rows = target.withColumn("_in_t", F.lit(True))
    return rows.join(one_row_per_key(changes, keys, seq), list(keys), "full_outer" if strict else "left")


def update_status(
    target: DataFrame, changes: DataFrame, run_ts: datetime | Column, strict: bool = True, seq: str | None = None
) -> DataFrame:
    """changes: (document_id, status).  Unknown document is an error, an equal status a no-op."""
    c = changes.select("document_id", F.col("status").alias("_new"), *_order(seq))
    joined = _against(target, c, ["document_id"], strict, seq)
    bad = F.col("_new").isNotNull() & ~F.col("_new").isin(*DOCUMENT_STATUSES)
    new = F.when(bad, F.raise_error(F.concat(F.lit("invalid status: "), F.col("_new"))).cast("string")).otherwise(F.col("_new"))
    moves = F.col("_new").isNotNull() & (F.col("_new") != F.col("status"))
    return _replace(joined, target, {"status": F.when(moves, new).otherwise(F.col("status"))}, moves, run_ts, ["document_id"])


def _order(seq: str | None) -> list[str]:
    return [] if seq is None else [seq]


def update_fields(target: DataFrame, changes: DataFrame, run_ts: datetime | Column, seq: str | None = None) -> DataFrame:
    """Patch the columns named in ``changes`` (null is written); only whitelisted ones."""
    patched = [c for c in changes.columns if c not in ("document_id", seq)]
    update_whitelist(patched)
    if not patched:
        return target
    c = changes.select("document_id", F.lit(True).alias("_hit"), *[F.col(p).alias(f"_new_{p}") for p in patched], *_order(seq))
    joined = _against(target, c, ["document_id"], False, seq)
    hit = F.col("_hit").isNotNull()
    return _replace(joined, target, {p: F.when(hit, F.col(f"_new_{p}")).otherwise(F.col(p)) for p in patched}, hit, run_ts)


def bulk_update_ocr_status(target: DataFrame, changes: DataFrame, run_ts: datetime | Column, seq: str | None = None) -> DataFrame:
    """changes: (document_id, page_num, ocr_status); pages not named are untouched."""
    c = changes.select("document_id", "page_num", F.col("ocr_status").alias("_new"), *_order(seq))
    joined = _against(target, c, ["document_id", "page_num"], False, seq)
    hit = F.col("_new").isNotNull()
    bad = hit & ~F.col("_new").isin(*OCR_STATUSES)
    new = F.when(bad, F.raise_error(F.concat(F.lit("invalid ocr_status: "), F.col("_new"))).cast("string")).otherwise(F.col("_new"))
    return _replace(joined, target, {"ocr_status": F.when(hit, new).otherwise(F.col("ocr_status"))}, hit, run_ts)


def _keep_on_null(
    target: DataFrame, results: DataFrame, columns: Sequence[str], run_ts: datetime | Column, strict: bool,
    always: Mapping[str, str], seq: str | None = None,
) -> DataFrame:
    names = [c for c in (*columns, *always) if c in results.columns]
    c = enforce(results, partial=True).select("document_id", "page_num", F.lit(True).alias("_hit"), *[F.col(n).alias(f"_new_{n}") for n in names], *_order(seq))
    joined = _against(target, c, ["document_id", "page_num"], strict, seq)
    hit = F.col("_hit").isNotNull()
    values = {n: F.coalesce(F.col(f"_new_{n}"), F.col(n)) for n in columns if n in names}
    for name, default in always.items():
        new = F.coalesce(F.col(f"_new_{name}"), F.lit(default)) if name in names else F.lit(default)
        values[name] = F.when(hit, new).otherwise(F.col(name))
    return _replace(joined, target, values, hit, run_ts, ["document_id", "page_num"])


def update_ocr(
    target: DataFrame, results: DataFrame, run_ts: datetime | Column, strict: bool = True, seq: str | None = None
) -> DataFrame:
    """OCR results: null keeps the old value, the status is always set (default done)."""
    return _keep_on_null(
        target, results, ["raw_text", "confidence_score", "language_detected"], run_ts, strict, {"ocr_status": "done"}, seq
    )


def update_structured(
    target: DataFrame, results: DataFrame, run_ts: datetime | Column, strict: bool = True, seq: str | None = None
) -> DataFrame:
    return _keep_on_null(target, results, ["page_type", "structured_json"], run_ts, strict, {}, seq)


def _replace(
    joined: DataFrame, target: DataFrame, values: Mapping[str, Column], touched: Column, run_ts: datetime | Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Target columns with new values.  ``keys``: a change without a target row fails the job, whichever columns are read."""
    def value(field) -> Column:
        new = touch_updated_at(touched, F.col(field.name), run_ts) if field.name == "updated_at" else values.get(field.name, F.col(field.name))
        new = new.cast(field.dataType)
        if keys:
            lost = F.concat(F.lit("row not found: "), F.to_json(F.struct(*keys)))
            new = F.when(F.col("_in_t").isNull(), F.raise_error(lost).cast(field.dataType)).otherwise(new)
        return new.alias(field.name)

    return joined.select(*[value(f) for f in target.schema.fields])


def cascade_delete(documents: DataFrame, pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove documents and, with them, their pages."""
    gone = ids.select("document_id").distinct()
    return documents.join(gone, "document_id", "left_anti"), pages.join(gone, "document_id", "left_anti")


def set_null_delete(documents: DataFrame, registry: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove registry rows; documents that pointed at them lose the reference."""
    gone = ids.select("id").distinct()
    mark = gone.select(F.col("id").alias("reference_data_id"), F.lit(True).alias("_gone"))
    cleared = left_join_spread_nulls(documents, mark, ["reference_data_id"], "document_id").withColumn(
        "reference_data_id", F.when(F.col("_gone").isNull(), F.col("reference_data_id"))
    )
    return cleared.select(*documents.columns), registry.join(gone, "id", "left_anti")


def merge_nodes(keys: Sequence[str], *candidates: DataFrame) -> DataFrame:
    """Union of candidates, one per natural key: the smallest attribute record wins."""
    union = candidates[0]
    for c in candidates[1:]:
        union = union.unionByName(c, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in keys]
    if not rest:
        return union.distinct()
    picked = union.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def union_categories(*parts: DataFrame) -> DataFrame:
    """Documents of several categories as one table; a column that a category lacks is null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def empty_tables(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Empty registry, documents and pages tables."""
    return (
        spark.createDataFrame([], REGISTRY), spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], PAGES)
    )

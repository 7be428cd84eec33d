"""Registry sheet to registry table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..operators.registry import clean_registry
from ..schemas import REGISTRY
from ..sources.registry import SinkResult, registry_sink, scan_registry
from ..sources.tables import publish, read_latest, versions


SHEET_ORDER = "_sheet_order"


def load_registry(
    sheet: DataFrame, target: DataFrame, run_ts: datetime | Column, dry_run: bool = False, observe: Observation | None = None,
    order: str | None = None,
) -> SinkResult:
    """Sheet to merged registry: clean, then upsert by registration number.

    ``order`` names the column that sorts the sheet: of a repeated number the last row wins.
    """
    return registry_sink(target, clean_registry(sheet, observe, order), run_ts, dry_run, order)


def load_registry_file(spark: SparkSession, path: str, root: str, run_ts: datetime, fmt: str = "csv") -> dict[str, int]:
    """Load one sheet into the versioned table under ``root``; returns loaded and skipped counts.

    The counts are observed while the new version is written, not by a second pass.
    """
    seen = Observation("registry_load")
    sheet = scan_registry(spark, path, fmt, order=SHEET_ORDER)
    merged = load_registry(sheet, read_latest(spark, root, REGISTRY), run_ts, observe=seen, order=SHEET_ORDER)
    publish(merged.table, root, max(versions(spark, root), default=-1) + 1)
    return dict(seen.get)

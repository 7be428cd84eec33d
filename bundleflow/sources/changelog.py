"""Keyed tables that are merged when read: a base and the changes since, one folder per batch.

A batch of changes is appended as it is, so writing costs what the batch is worth.  Reading takes
the newest committed base, reduces the later changes to one row per key and merges the two.
Compaction writes what a reader would see as a new base, then drops what the base covers.  Writing
a batch again replaces it, and a folder counts once its job has committed, so a repeated batch, a
crash before compaction and one in the middle of it all leave the same table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import AUDIT, MODES, one_row_per_key, rank_of, upsert
from .tables import _fs, drop, publish, read_latest, versions

SEQ, AT, SINCE = "_batch", "_at", "_since"


def committed(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the folders `prefix=number` under root whose job has committed, ascending."""
    fs, path, make = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(path))
    return sorted(int(n.removeprefix(f"{prefix}=")) for n in names if n.startswith(f"{prefix}=") and fs.exists(make(f"{root}/{n}/_SUCCESS")))


def folded(changes: DataFrame, columns: Sequence[str], keys: Sequence[str], mode: str, ranks: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Changes of several batches as one change per key, which merges to the same row.

    ``forward_only``: of each column the last value that is not null; of a ranked one the highest,
    the first to get there if it is final, else the last.  ``overwrite``: the last row.
    """
    rest = [c for c in columns if c not in keys]

    def last(name: str) -> Column:
        value = F.col(name)
        order: Column = F.col(SEQ)
        if name in ranks:
            rank = rank_of(value, ranks[name])
            order = F.struct(rank, F.when(rank == max(ranks[name].values()), -F.col(SEQ)).otherwise(F.col(SEQ)))
        return F.max_by(value, F.when(value.isNotNull(), order)).alias(name)

    if mode == "overwrite":
        picked = [F.max_by(F.struct(*rest), SEQ).alias("_row")] if rest else []
        out = [F.col(f"_row.{c}").alias(c) for c in rest]
    else:
        picked, out = [last(c) for c in rest], [F.col(c) for c in rest]
    reduced = changes.groupBy(*keys).agg(*picked, F.min_by(AT, SEQ).alias(SINCE), F.max_by(AT, SEQ).alias(AT))
    return reduced.select(*keys, *out, SINCE, AT)


class ChangeLog(NamedTuple):
    """A table under ``root``: ``root/version=n`` is a base up to batch n, ``root/changes/batch=n`` a batch.

    ``overwrite`` changes must carry every column but the audit columns.
    """

    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    mode: str = "forward_only"
    ranks: Mapping[str, Mapping[str, int]] = {}

    @property
    def _columns(self) -> list[str]:
        return [c for c in self.schema.names if c not in AUDIT]

    @property
    def _log(self) -> T.StructType:
        return T.StructType([*[self.schema[c] for c in self._columns], T.StructField(SEQ, T.LongType()), T.StructField(AT, T.TimestampType())])

    def append(self, changes: DataFrame, batch_id: int, run_ts: datetime, seq: str | None = None) -> None:
        """Store a batch; keys twice in it follow ``one_row_per_key``."""
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        missing = set(self._columns) - set(changes.columns)
        if self.mode == "overwrite" and missing:
            raise ValueError(f"changes lack {sorted(missing)}")
        once = one_row_per_key(changes.drop(*AUDIT), list(self.keys), seq)
        row = [(F.col(c) if c in once.columns else F.lit(None)).cast(self.schema[c].dataType).alias(c) for c in self._columns]
        stamped = once.select(*row, F.lit(batch_id).cast("long").alias(SEQ), F.lit(run_ts).cast("timestamp").alias(AT))
        stamped.write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The table after all batches, or after those before one."""
        usable = [v for v in versions(spark, self.root) if before is None or v < before]
        base = read_latest(spark, self.root, self.schema, before)
        later = [b for b in committed(spark, f"{self.root}/changes", "batch") if b > (usable[-1] if usable else -1) and (before is None or b < before)]
        if not later:
            return base
        changes = spark.read.schema(self._log).parquet(*[f"{self.root}/changes/batch={b}" for b in later])
        once = folded(changes, self._columns, self.keys, self.mode, self.ranks)
        return upsert(base, once, list(self.keys), F.col(f"c.{AT}"), self.mode, self.ranks, created=F.col(f"c.{SINCE}"), unique=True)

    def compact(self, spark: SparkSession, upto: int | None = None, keep_last: int = 1) -> int | None:
        """Write the table up to batch ``upto`` as a base and drop older bases and the changes it covers.

        The newest ``keep_last`` batches stay in the log, so that a batch delivered again still finds
        the table before it.  Returns the number of the newest base.  One compaction runs at a time;
        readers that began on an older base have to begin again.
        """
        stored = versions(spark, self.root)
        batches = committed(spark, f"{self.root}/changes", "batch")
        closed = [b for b in (batches[:-keep_last] if keep_last else batches) if upto is None or b <= upto]
        if closed and closed[-1] > (stored[-1] if stored else -1):
            publish(self.read(spark, before=closed[-1] + 1), self.root, closed[-1])
            stored.append(closed[-1])
        if stored:
            for v in stored[:-1]:
                drop(spark, f"{self.root}/version={v}")
            for b in batches:
                if b <= stored[-1]:
                    drop(spark, f"{self.root}/changes/batch={b}")
        return stored[-1] if stored else None

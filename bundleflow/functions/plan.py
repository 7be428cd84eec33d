"""Plan shaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on an ordinary computed column is pushed below the projection that computes it,
    which repeats the expression; for a result built from dozens of patterns over several
    stages that repetition explodes.  Output of a generator is not pushed through, so the
    columns go through a one-element ``inline``.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times, computed once per row.

    Branches of a condition are kept out of common subexpressions, so each mention there would be
    computed again.
    """
    return F.transform(F.array(value), use)[0]


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy row work on a few-file table as many tasks as the session has slots.

    Call it on a plain scan.  A large table already arrives in more pieces than that and is
    returned unchanged, so no shuffle is added where one would cost.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= slots else scan.repartition(slots)


def before_fan_out(df: DataFrame) -> DataFrame:
    """Spread rows evenly ahead of an explode that multiplies them by a hundred or more.

    Adaptive execution sizes partitions by the bytes before the explode; a fixed partition
    count keeps the work after it parallel.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

"""Join helpers for skewed inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_SPREAD = 1024


def left_join_spread_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str) -> DataFrame:
    """Left join on ``keys`` where the first key may be null in many left rows.

    A null key matches nothing but would still hash to one partition.  An extra join key is 0
    for real keys and a hash of ``spread_by`` for null ones, so null rows spread out.  Real hot
    keys are left to AQE, which splits the left side of a left join.
    """
    spread = F.pmod(F.xxhash64(F.col(spread_by)), F.lit(NULL_SPREAD)) + 1
    salt = F.when(F.col(keys[0]).isNull(), spread).otherwise(F.lit(0))
    salted = left.withColumn("_salt", salt.cast("int"))
    return salted.join(right.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left").drop("_salt")

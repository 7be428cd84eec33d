"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source with target / size = r is taken floor(r) times; the fractional part
is an inclusion probability.  The cube method rounds those probabilities to 0 or 1 while two
totals per source, tokens and documents, keep their expected values: three undecided units always
have a direction in which both totals stand still, and a step along it decides at least one of
them.  Units are balanced in bounded blocks; what a block leaves open (two units at most) meets
the rest of its source in the next round, so the number of open units falls by the block size
each round.  The last round holds a dozen units back, spread over all sizes; with the one or two
that stay open they form the landing problem, small enough to try every way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

BLOCK = 4096
RESERVE = 12  # undecided units that the last round holds back for the landing
MOST = 3  # a source is repeated so many times at most
# Weights dealt to the sources in code point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
UNIT = "source string, doc_id long, size long, source_size long, target double, ratio double, pi double"
EDGE = 1e-9


def word_count(text: str):
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also target.  One row per source comes in.

    target = min(most * source_size, level * weight), where level spends the whole total: that is
    where repeated resharing of the excess ends.  Sorted by cap / weight, the sources below the
    level form a prefix, so running sums give the level without a loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - filled) / left
    open_level = F.when(level * F.col("weight") <= F.col("cap"), level)
    return (
        ranked.withColumn("_level", open_level)
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def _step(pi: list[float], size: list[float], draw: float) -> None:
    """Move three undecided probabilities along the direction that keeps count and tokens."""
    u = (size[2] - size[1], size[0] - size[2], size[1] - size[0])
    if u == (0, 0, 0):
        u = (1.0, -1.0, 0.0)
    up = down = math.inf
    for p, d in zip(pi, u):
        if d > 0:
            up, down = min(up, (1 - p) / d), min(down, p / d)
        elif d < 0:
            up, down = min(up, p / -d), min(down, (1 - p) / -d)
    move = up if draw * (up + down) < down else -down
    for i, d in enumerate(u):
        pi[i] += move * d
        pi[i] = 0.0 if pi[i] < EDGE else 1.0 if pi[i] > 1 - EDGE else pi[i]


def flight(pi: np.ndarray, size: np.ndarray, draws: np.random.Generator, reserve: int = 0) -> np.ndarray:
    """Probabilities after the flight phase: two of them undecided at most, and the reserve.

    The reserve is spread evenly over the order of the units and keeps its probabilities.
    """
    pi = pi.astype(float).copy()
    undecided = np.flatnonzero((pi > EDGE) & (pi < 1 - EDGE)).tolist()
    pi[pi <= EDGE], pi[pi >= 1 - EDGE] = 0.0, 1.0
    if reserve:
        apart = set(np.linspace(0, len(undecided) - 1, min(reserve, len(undecided))).astype(int).tolist()) if undecided else set()
        undecided = [at for i, at in enumerate(undecided) if i not in apart]
    held: list[int] = []
    uniform = iter(draws.random(len(undecided) + 3).tolist())
    sizes = size.astype(float)
    for at in undecided:
        held.append(at)
        if len(held) == 3:
            three = [pi[i] for i in held]
            _step(three, [sizes[i] for i in held], next(uniform))
            for i, p in zip(held, three):
                pi[i] = p
            held = [i for i in held if 0 < pi[i] < 1]
    return pi


def landing(pi: np.ndarray, size: np.ndarray, tokens: float) -> np.ndarray:
    """Decide the last RESERVE + 2 units at most: of all ways, the one nearest to both totals.

    tokens is what these units should bring; documents should bring the sum of pi and count less.
    """
    pi, at = pi.copy(), np.flatnonzero((pi > 0) & (pi < 1))
    if len(at):
        ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        off = np.abs(ways @ size[at] - tokens) + 1e-3 * size[at].mean() * np.abs(ways.sum(axis=1) - pi[at].sum())
        pi[at] = ways[np.argmin(off)]
    return pi


def _fly(seed: int, reserve: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        mixed = pd.util.hash_pandas_object(rows[["doc_id", "size"]].astype("float64"), index=False).to_numpy()
        # The longest go first, so that what stays open for the landing is short.
        rows = rows.iloc[np.lexsort((mixed, -rows["size"].to_numpy()))]
        first = int(mixed.min()) ^ (seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        rows["pi"] = flight(rows["pi"].to_numpy(), rows["size"].to_numpy(), np.random.default_rng(first), reserve)
        return rows.drop(columns="_b")

    return block


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    Null text or source-less rows count: size 0, and the null source is a source of its own, last
    in order.  Rows that share an id are separate units.  An empty table gives an empty table.
    Documents of size 0 are taken 0 times.  Ties are broken by hashed ids, so reruns agree.
    """
    units = docs.select(F.col(source).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), word_count(text).alias("size"))
    units = cut(units, "mix-sizes")
    totals = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(totals.select("source", "source_size"))
    keyed = units.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    sized = targets.join(totals.select(F.col("source").alias("_source"), "n"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sized = sized.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    undecided = (
        keyed.join(sized, "_s")
        .withColumn("ratio", ratio)
        .withColumn("pi", F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0))
    )
    parts = []
    biggest = totals.agg(F.max("n")).first()[0] or 0
    round_no = 0
    columns = [c.split()[0] for c in UNIT.split(", ")]
    while True:
        blocks = max(1, math.ceil(biggest / block))
        salt = F.pmod(F.xxhash64("doc_id", "size", F.lit(round_no)), F.lit(blocks))
        flown = undecided.select(*columns, salt.alias("_b")).groupBy("source", "_b").applyInPandas(
            _fly(seed + round_no, RESERVE if blocks == 1 else 0), UNIT
        )
        flown = cut(flown, "mix-round")
        is_open = (F.col("pi") > 0) & (F.col("pi") < 1)
        parts.append(flown.filter(~is_open))
        undecided, round_no = flown.filter(is_open), round_no + 1
        if blocks == 1:
            break
        biggest = blocks * 2
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part)
    so_far = decided.groupBy("source").agg(F.sum(F.col("size") * (F.floor("ratio") + F.col("pi"))).alias("_so_far"))
    last = undecided.join(so_far.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    def land(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "size"], kind="stable").reset_index(drop=True)
        sure = float((rows["size"] * np.floor(rows["ratio"])).sum())
        tokens = float(rows["target"].iloc[0]) - float(rows["_so_far"].fillna(0).iloc[0]) - sure
        rows["pi"] = landing(rows["pi"].to_numpy(), rows["size"].to_numpy(), tokens)
        return rows[columns]

    landed = last.groupBy("source").applyInPandas(land, UNIT)
    taken = F.col("size") * (F.floor("ratio") + F.col("pi")).cast("long")
    return decided.unionByName(landed).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))

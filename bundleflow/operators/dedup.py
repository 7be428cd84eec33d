"""Content duplicates, and repeats of a message id within a time window."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_id

# --- Fixed values --------------------------------------------------------------------
WINDOW_SECONDS = 300
# -------------------------------------------------------------------------------------
CHUNK_SECONDS = 3600
GROUP = 1024  # chunks whose maps are composed in one task
FRAME = 10_000  # rows a task hands on at a time
BEGIN_OF_TIME, END_OF_TIME, NOTHING_KEPT = -(2**62), 2**62, -(2**61)


def content_dedup(df: DataFrame, content: str, id_col: str) -> DataFrame:
    """(content_id, id, copies): one row per distinct content, the smallest id stays.

    Only the 64-character digest is shuffled, counted map-side first.
    """
    return df.groupBy(content_id(F.col(content)).alias("content_id")).agg(
        F.min(id_col).alias(id_col), F.count("*").alias("copies")
    )


def _entry_maps(window: int, length: int):
    """Task helper over rows sorted by (k, chunk, us): per chunk, where each entry leaves it.

    Open paths wait in a queue by the time they last kept.  A row is kept by every path that
    has waited a window; those paths then coincide, so each row costs amortised constant work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opening, closed, paths = None, 0, False, deque()

        def flush() -> list[tuple]:
            exits = sorted((upto, last) for last, entries in paths for upto in entries)
            # Of neighbouring entries with one exit the latest stands for them all.
            rows = [(*current, *e) for e, after in zip(exits, [*exits[1:], (None, None)]) if e[1] != after[1]]
            if not closed:  # entered late enough, this chunk keeps nothing
                rows.append((*current, END_OF_TIME, NOTHING_KEPT))
            return rows

        for batch in batches:
            out: list[tuple] = []
            for k, chunk, t in zip(batch["k"].tolist(), batch["chunk"].tolist(), batch["us"].tolist()):
                if (k, chunk) != current:
                    if current is not None:
                        out.extend(flush())
                    current, opening, closed, paths = (k, chunk), chunk * length, False, deque()
                entries: list[int] = []
                while paths and paths[0][0] + window <= t:
                    entries.extend(paths.popleft()[1])
                if not closed:
                    entries.append(t)
                    closed = t >= opening + window
                if entries:
                    paths.append((t, entries))
            yield pd.DataFrame(out, columns=["k", "chunk", "upto", "leaves"])
        if current is not None:
            yield pd.DataFrame(flush(), columns=["k", "chunk", "upto", "leaves"])

    return run


def _after(row: list[tuple], start: int, window: int) -> int:
    """Earliest allowed time behind a chunk, or group of chunks, entered with this one."""
    place = bisect_left(row, (start,))
    if place == len(row) or row[place][1] == NOTHING_KEPT:
        return start
    return row[place][1] + window


def _composed(first: list[tuple], then: list[tuple], window: int) -> list[tuple]:
    """The entry map of two neighbours, ``first`` before ``then``; composition is associative."""
    out: list[tuple] = []
    low = BEGIN_OF_TIME - 1
    for upto, leaves in first if first[-1][0] == END_OF_TIME else [*first, (END_OF_TIME, NOTHING_KEPT)]:
        if leaves != NOTHING_KEPT:
            pieces = [(upto, _after(then, leaves + window, window) - window)]
        else:  # entries up to here reach the second neighbour as they are
            last = next((left for u, left in then if u >= upto), NOTHING_KEPT)
            pieces = [*[(u, left) for u, left in then if low < u < upto], (upto, last)]
        for piece in pieces:
            if out and out[-1][1] == piece[1]:
                out.pop()
            out.append(piece)
        low = upto
    return out


def _maps(batches: Iterator[pd.DataFrame], keys: list[str], more: Sequence[str] = ()) -> Iterator[tuple]:
    """(key values, other values of the first row, [(upto, leaves), ...]) of rows sorted by key and upto."""
    key, rest, row = None, None, []
    for batch in batches:
        for values in batch[[*keys, *more, "upto", "leaves"]].itertuples(index=False, name=None):
            if values[: len(keys)] != key:
                if key is not None:
                    yield key, rest, row
                key, rest, row = values[: len(keys)], values[len(keys) : -2], []
            row.append(values[-2:])
    if key is not None:
        yield key, rest, row


def _group(window: int):
    """Task helper over maps sorted by (k, node, chunk, upto): one entry map per (k, node)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["k", "chunk", "upto", "leaves"]
        current, composed, out = None, [], []
        for (k, node, _), _, row in _maps(batches, ["k", "node", "chunk"]):
            if (k, node) == current:
                composed = _composed(composed, row, window)
                continue
            out.extend((*current, *piece) for piece in composed)
            if len(out) >= FRAME:  # a frame for each key would cost more than its rows
                yield pd.DataFrame(out, columns=columns)
                out = []
            current = (k, node)
            composed = _composed([(END_OF_TIME, NOTHING_KEPT)], row, window)
        out.extend((*current, *piece) for piece in composed)
        yield pd.DataFrame(out, columns=columns)

    return run


def _chain(window: int, keys: list[str], known: bool):
    """Task helper over maps sorted by (keys, chunk, upto): the earliest allowed time per chunk.

    known: rows carry in ``start`` the time with which their key is entered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, out = None, BEGIN_OF_TIME, []
        for values, rest, row in _maps(batches, [*keys, "chunk"], ["start"] if known else []):
            if values[:-1] != key:
                key, start = values[:-1], rest[0] if known else BEGIN_OF_TIME
            out.append((values[0], values[-1], start))
            start = _after(row, start, window)
            if len(out) == FRAME:
                yield pd.DataFrame(out, columns=["k", "chunk", "start"])
                out = []
        yield pd.DataFrame(out, columns=["k", "chunk", "start"])

    return run


def _keep(window: int):
    """Task helper over rows sorted by (k, chunk, us) that know their chunk's entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, allowed = None, BEGIN_OF_TIME
        for batch in batches:
            out: list[tuple] = []
            for k, chunk, t, start in batch[["k", "chunk", "us", "start"]].itertuples(index=False):
                if (k, chunk) != current:
                    current, allowed = (k, chunk), start
                if t >= allowed:
                    out.append((k, t))
                    allowed = t + window
            yield pd.DataFrame(out, columns=["k", "us"])

    return run


def dedup_within(
    df: DataFrame, key: str, ts: str, window_seconds: int = WINDOW_SECONDS, chunk_seconds: int = CHUNK_SECONDS, group: int = GROUP
) -> DataFrame:
    """(key, ts) that count: the first sighting, then each one at least a window after the last
    that counted.

    The rule is sequential per key, so a busy key is cut into time chunks.  (1) Each chunk
    reports, for every way it can be entered, the time of the last message it keeps; the entry
    depends only on one window before the chunk, so these maps are small.  (2) The maps of
    ``group`` neighbouring chunks are composed to one, the groups of a key are chained in time
    order, and each group hands its entry down to its chunks; no task sees all chunks of a key.
    (3) Each chunk is walked once with its now known entry.  Exact for any chunk length and group;
    tasks stream sorted rows and hold one window of one key, and one group's map, at most.
    Identical (key, ts) rows collapse before anything else.
    """
    if chunk_seconds < window_seconds:
        raise ValueError("a chunk must be at least one window long")
    window, length = window_seconds * 1_000_000, chunk_seconds * 1_000_000
    key_type = df.schema[key].dataType.simpleString()
    times = df.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).filter(
        F.col("k").isNotNull() & F.col("us").isNotNull()
    ).distinct()
    chunked = times.withColumn("chunk", F.floor(F.col("us") / F.lit(length)).cast("bigint"))

    maps = (
        chunked.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "us")
        .mapInPandas(_entry_maps(window, length), f"k {key_type}, chunk bigint, upto bigint, leaves bigint")
    )
    noded = maps.withColumn("node", F.floor(F.col("chunk") / F.lit(group)).cast("bigint")).repartition("k", "node").sortWithinPartitions("k", "node", "chunk", "upto")
    tops = noded.mapInPandas(_group(window), f"k {key_type}, chunk bigint, upto bigint, leaves bigint")
    entered = (
        tops.repartition("k").sortWithinPartitions("k", "chunk", "upto")
        .mapInPandas(_chain(window, ["k"], False), f"k {key_type}, chunk bigint, start bigint").withColumnRenamed("chunk", "node")
    )
    starts = (
        noded.join(entered, ["k", "node"]).sortWithinPartitions("k", "node", "chunk", "upto")
        .mapInPandas(_chain(window, ["k", "node"], True), f"k {key_type}, chunk bigint, start bigint")
    )
    kept = (
        chunked.join(starts, ["k", "chunk"]).repartition("k", "chunk").sortWithinPartitions("k", "chunk", "us")
        .mapInPandas(_keep(window), f"k {key_type}, us bigint")
    )
    return kept.select(F.col("k").alias(key), F.timestamp_micros("us").alias(ts))


def dedup_messages(
    df: DataFrame, key: str, ts: str, order: str, window_seconds: int = WINDOW_SECONDS, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """The messages that count, with all their columns.

    Of messages with one key and time the one with the smallest ``order`` stays.  A message without
    a key or a time cannot repeat anything and stays.
    """
    usable = F.col(key).isNotNull() & F.col(ts).isNotNull()
    kept = dedup_within(df, key, ts, window_seconds, chunk_seconds)
    rest = [c for c in df.columns if c not in (key, ts)]
    timed = df.filter(usable).withColumn(ts, F.col(ts).cast("timestamp"))
    once = timed.groupBy(key, ts).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    counted = once.join(kept, [key, ts], "left_semi").select(*[F.col(c) if c in (key, ts) else F.col(f"_row.{c}").alias(c) for c in df.columns])
    return counted.unionByName(df.filter(~usable).withColumn(ts, F.col(ts).cast("timestamp")))

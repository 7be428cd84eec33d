"""Periodic runs: stretches of words that repeat a root at least four times.

Periods are taken octave by octave.  For periods from P to 2P a document is cut into tiles of 8P
words around boundaries 2P apart, so that a run of four roots always has a boundary with its root
behind it.  At a boundary b the Z-function of the words from b on gives, for every period q, how far
the text agrees with itself q words later; the Z-function of the reversed words gives how far that
agreement reaches back.  Tiles are solved independently, in slices of a long document.  Their
interval fragments are shuffled by document and period and stitched where they share a root.
A tile is solved only if the P-gram at its boundary recurs at a distance of its octave, which
rolling hashes tell; hashes rule tiles out, words alone decide.  Below period 8 a tile would be a few
words, so the text is compared with itself directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from .common import cut, free_name, text_of

ROOTS, SHORTEST = 4, 6  # a run holds at least four roots and six words
DIRECT = 8  # periods below are found by direct comparison
SLICE = 1 << 15  # words of a slice for the octaves up to SLICE / 16
FRAGMENT = "array<struct<period:int,start:int,end:int>>"
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def z_values(s: list) -> list[int]:
    """For every place, how long the list from there agrees with the list from its beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_factors(q: int) -> list[int]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return found + ([q] if q > 1 else [])


def is_primitive(words: np.ndarray, start: int, q: int) -> bool:
    """The q words from start are not a shorter root repeated."""
    root = words[start : start + q]
    return not any(np.array_equal(root[: q - q // d], root[q // d :]) for d in _prime_factors(q))


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(period, start, end): fragments of one period that share a root become one."""
    out: list[tuple[int, int, int]] = []
    for q, a, b in sorted(found):
        if out and out[-1][0] == q and a <= out[-1][2] - q:
            out[-1] = (q, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((q, a, b))
    return out


def _direct(x: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, min(DIRECT, len(x))):
        same = np.zeros(len(x) - q + 2, np.int8)
        same[1:-1] = x[:-q] == x[q:]
        edge = np.flatnonzero(np.diff(same))
        a, b = edge[::2], edge[1::2] + q
        long = b - a >= max(SHORTEST, ROOTS * q)
        found += [(q, s, e) for s, e in zip(a[long].tolist(), b[long].tolist()) if is_primitive(x, s, q)]
    return found


def _tile(words: list, b: int, octave: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """Maximal agreements over the boundary b, inside the tile, for some periods of the octave."""
    low, high, top = max(0, b - 2 * octave), min(len(words), b + 6 * octave), min(len(words), b + 2 * octave)
    after = z_values(words[b:high])
    before = z_values(words[low:b][::-1] + [-1] + words[low:top][::-1])
    for q in periods:
        a, e = b - before[b - low + 1 + top - b - q], b + q + after[q]
        whole = (a > low or low == 0) and (e < high or high == len(words))
        if e - a >= (ROOTS if whole else 2) * q:
            yield q, a, e


def _octave(x: np.ndarray, words: list, grams: np.ndarray, octave: int, smaller: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of periods octave .. 2 octave - 1.  grams: hashes of octave words from each place."""
    step = 2 * octave
    rows = len(grams) // step  # boundaries with a whole octave of grams behind them
    table = grams[: rows * step].reshape(rows, step)
    hit = table[:, octave:] == table[:, :1]
    place = np.flatnonzero(hit.any(axis=1))
    tail = grams[rows * step :]
    last = np.flatnonzero(tail[octave:] == tail[0]) if len(tail) > octave else np.zeros(0, np.int64)
    todo = [(int(r) * step, np.flatnonzero(hit[r])) for r in place] + ([(rows * step, last)] if len(last) else [])
    if smaller:  # inside a run of a smaller period every longer one is a multiple of it
        order = sorted((a, e) for _, a, e in smaller)
        begin = np.array([a for a, _ in order])
        reach = np.maximum.accumulate([e for _, e in order])
        at = np.searchsorted(begin, [b for b, _ in todo], side="right") - 1
        todo = [t for t, k in zip(todo, at.tolist()) if k < 0 or reach[k] < t[0] + 3 * octave]
    found = []
    for b, offsets in todo:
        found += [f for f in _tile(words, b, octave, (offsets + octave).tolist()) if is_primitive(x, f[1], f[0])]
    return merged(found)


def _solved(x: np.ndarray, octaves: list[int]) -> list[tuple[int, int, int]]:
    """Fragments of one slice for neighbouring octaves."""
    found = _direct(x) if octaves[0] == 1 else []
    grams, width, words = repeats.mixed(x.astype(np.uint64) + np.uint64(1)), 1, None
    for octave in octaves:
        while width < octave and len(grams) > width:
            grams = repeats.mixed(grams[:-width] * np.uint64(0xD1342543DE82EF95) + grams[width:])
            width *= 2
        if octave < DIRECT or len(x) < ROOTS * octave:
            continue
        words = x.tolist() if words is None else words
        found += _octave(x, words, grams, octave, found)
    return found


def _slices(n: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    low = 0
    while True:
        yield low, min(n, low + size)
        if low + size >= n:
            return
        low += size - overlap


def fragments(x: np.ndarray, longest: int, size: int = SLICE) -> list[tuple[int, int, int]]:
    """(period, start, end) over a sequence of word numbers, in which no text is longer than `longest`."""
    together = size // 16
    octaves = [1 << k for k in range(max(1, (longest // ROOTS).bit_length()))]
    tasks = [(size, 8 * together, [p for p in octaves if p <= together])] + [(16 * p, 8 * p, [p]) for p in octaves if p > together]
    found = []
    for length, overlap, group in tasks:
        for low, high in _slices(len(x), length, overlap):
            found += [(q, a + low, b + low) for q, a, b in _solved(x[low:high], group)]
    return found


def of_texts(texts: list[bytes], size: int = SLICE) -> list[np.ndarray]:
    """For each text the fragments as one flat array of period, start, end."""
    numbers: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    begin = np.cumsum(count + 1) - (count + 1)
    x = np.empty(int(count.sum()) + len(split), np.int64)
    for words, b, n in zip(split, begin.tolist(), count.tolist()):
        x[b : b + n] = [numbers.setdefault(w, len(numbers)) for w in words]
    x[begin + count] = len(numbers) + np.arange(len(split))  # equal to no word
    found = fragments(x, int(count.max(initial=0)), size)
    out = [np.zeros(0, np.int32)] * len(split)
    if found:
        rows = np.array(found, np.int64)
        owner = np.searchsorted(begin, rows[:, 1], side="right") - 1
        rows[:, 1:] -= begin[owner][:, None]
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for part in np.split(order, cuts):
            out[owner[part[0]]] = rows[part].astype(np.int32).ravel()
    return out


def stitched(found: DataFrame, row: str) -> DataFrame:
    """Runs (row, start, length, period) from fragments (row, period, start, end)."""
    before = Window.partitionBy(row, "period").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("end").over(before) - F.col("period"), F.lit(True)).cast("int")
    upto = Window.partitionBy(row, "period").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = found.withColumn("_apart", apart).withColumn("_island", F.sum("_apart").over(upto))
    runs = islands.groupBy(row, "period", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    size = F.col("end") - F.col("start")
    return runs.filter(size >= F.greatest(F.lit(SHORTEST), ROOTS * F.col("period"))).select(row, "start", size.alias("length"), "period")


def find(docs: DataFrame, text: str = "text", size: int = SLICE) -> DataFrame:
    """The documents, with all their columns, and a struct column `periods` more.

    periods: n_words; runs (start, length, period, by start then period), start being a word number
    from 0; collapsed, the words that no run holds behind its first root, joined by one space.
    Words are what ASCII spaces separate.  Null and empty texts have no words and no runs.  Rows with
    equal ids, or none, are judged one by one; an empty table stays empty.
    """

    @F.pandas_udf("array<int>")
    def tiles(texts: pd.Series) -> pd.Series:
        out = [a for _, group in repeats.chunks([0] * len(texts), texts.tolist()) for a in of_texts(group, size)]
        return pd.Series(out, dtype=object)

    row, flat, name = free_name(docs, "_row"), free_name(docs, "_fragments"), free_name(docs, "periods")
    # Written once: the row number then stays what it is, and the texts without fragments need no shuffle.
    marked = cut(docs.withColumn(flat, tiles(text_of(text))).withColumn(row, F.monotonically_increasing_id()), "period-fragments")
    places = F.transform(F.sequence(F.lit(0), F.size(flat) - 3, F.lit(3)), lambda i: F.struct(F.get(flat, i).alias("period"), F.get(flat, i + 1).alias("start"), F.get(flat, i + 2).alias("end")))
    some = F.size(flat) > 0
    found = marked.filter(some).select(row, F.inline(places))
    run = F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("period").cast("long").alias("period"))
    runs, listed = stitched(found, row), free_name(docs, "_runs")
    listed_runs = runs.groupBy(row).agg(F.sort_array(F.collect_list(run)).alias(listed))
    held = marked.filter(some).join(listed_runs, row, "left")
    bare = marked.filter(~some).withColumn(listed, F.lit(None).cast(RUN))
    both = held.unionByName(bare).withColumn(listed, F.coalesce(F.col(listed), F.array().cast(RUN)))

    @F.pandas_udf("n_words bigint, collapsed string")
    def collapse(texts: pd.Series, starts: pd.Series, lengths: pd.Series, periods: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, n, q in zip(texts, starts, lengths, periods):
            words = text.encode("utf-8", "surrogatepass").split()
            kept = words
            if len(a):
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, a + q, 1)
                np.add.at(change, a + n, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            rows.append((len(words), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_words", "collapsed"])

    left = free_name(docs, "_left")
    done = both.withColumn(left, collapse(text_of(text), *[F.col(listed)[f] for f in ("start", "length", "period")]))
    return done.select(*docs.columns, F.struct(F.col(left)["n_words"].alias("n_words"), F.col(listed).alias("runs"), F.col(left)["collapsed"].alias("collapsed")).alias(name))

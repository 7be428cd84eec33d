"""Screening for long exact repeats, shared by the two substring deduplicators.

A window (so many consecutive words, or bytes, of one text) is named by the smallest hash of the
grams in it.  Equal windows have equal names, and neighbouring windows mostly share one, so a
text becomes a short list of runs of windows with one name.  Names that occur once cannot repeat
and are dropped; the others are cut out with the text around them, and all windows of a name meet
in one place.  The screen of repeated names is a bit field of fixed size: a false hit costs work,
never a result.  Names with very many runs are split into single windows, which are spread by
their content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, tidy

CHUNK = 1 << 17  # bytes of text handled at once, or one longer text
RUN = 128  # windows of one run at most
SCREEN_BITS = 27  # the broadcast screen has 2^27 bits, 16 MB, at any input size
HOT_BITS = 20
HOT = 20_000  # runs of one name beyond which its windows are dealt out one by one
NO_ID = (1 << 63) - 1
CONTEXT = "name long, context binary, doc long, starts array<int>, loop boolean"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Units(NamedTuple):
    """The units (bytes or words) of several texts in a row."""

    grams: np.ndarray  # hash of the gram that begins at each unit
    begin: np.ndarray  # first unit of each text
    count: np.ndarray  # units of each text


class Kind(NamedTuple):
    units: Callable[[list[bytes]], Units]
    cut_out: Callable[[bytes], Callable[[int, int], bytes]]  # text -> units [a, b) as bytes
    gram: int
    window: int

    @property
    def spread(self) -> int:
        return self.window - self.gram + 1


def byte_units(texts: list[bytes]) -> Units:
    """Grams of 32 bytes, read as four words of eight."""
    count = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(count.sum())
    joined = np.frombuffer(b"".join(texts) + bytes(64), dtype=np.uint8)
    at = [np.ndarray(n, dtype="<u8", buffer=joined, offset=o, strides=(1,)) for o in (0, 8, 16, 24)]
    grams = at[0] * _MIX
    for x in at[1:]:
        grams ^= grams >> np.uint64(29)
        grams += x
        grams *= _MIX
    grams ^= grams >> np.uint64(32)
    return Units(grams, np.cumsum(count) - count, count)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        base = 0x5851F42D4C957F2D
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 18), b, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of every word of a text."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside))
    first, end = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * up[: len(raw)], out=total[1:])
    return first, end, mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def rolling(words: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram that begins at each word; the last gram - 1 are not whole."""
    n = len(words)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    whole = max(0, n - gram + 1)
    out = np.zeros(n, np.uint64)
    out[:whole] = mixed((total[gram : gram + whole] - total[:whole]) * down[:whole])
    return out


WORD_GRAM = 12


def word_units(texts: list[bytes]) -> Units:
    joined = b"\n".join(texts)
    first, _, hashes = word_hashes(joined)
    length = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.searchsorted(first, np.cumsum(length) - length)
    return Units(rolling(hashes, WORD_GRAM), begin, np.diff(np.append(begin, len(first))))


def _words(text: bytes) -> Callable[[int, int], bytes]:
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


BYTES = Kind(byte_units, lambda text: lambda a, b: text[a:b], 32, 100)
WORDS = Kind(word_units, _words, WORD_GRAM, 50)


def window_names(grams: np.ndarray, spread: int) -> np.ndarray:
    """Smallest of the next `spread` grams; the last entries see fewer."""
    low, width = grams.copy(), 1
    while width * 2 <= spread:
        np.minimum(low[:-width], low[width:], out=low[:-width])
        width *= 2
    if width < spread and len(low) > spread - width:
        np.minimum(low[: -(spread - width)], low[spread - width :], out=low[: -(spread - width)])
    return low


class Runs(NamedTuple):
    names: np.ndarray  # of every unit
    text: np.ndarray  # number of the text of each run
    at: np.ndarray  # first unit of each run, in the units of all texts
    length: np.ndarray


def runs(units: Units, kind: Kind) -> Runs:
    names = window_names(units.grams, kind.spread)
    n = len(names)
    whole = np.maximum(units.count - kind.window + 1, 0)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, units.begin, (whole > 0).astype(np.int32))
    np.add.at(change, units.begin + whole, -(whole > 0).astype(np.int32))
    valid = np.cumsum(change[:n]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (names[1:] != names[:-1])
    at = np.flatnonzero(new)
    ends = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
    stop = np.minimum(np.append(at[1:], n), ends[np.searchsorted(ends, at, side="right")] if len(ends) else n)
    length = stop - at
    if len(length) and length.max() > RUN:
        parts = -(-length // RUN)
        of = np.repeat(np.arange(len(at)), parts)
        step = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        at, length = at[of] + step, np.minimum(RUN, length[of] - step)
    text = np.searchsorted(units.begin, at, side="right") - 1
    return Runs(names, text, at, length)


def chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[bytes]]]:
    """Texts in groups of about CHUNK bytes."""
    held, size = ([], []), 0
    for i, text in zip(ids, texts):
        raw = text.encode("utf-8", "surrogatepass")
        held[0].append(i)
        held[1].append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield held
            held, size = ([], []), 0
    if held[0]:
        yield held


def occurrences(grams: np.ndarray, names: np.ndarray) -> np.ndarray:
    """All grams, with repeats, that are one of the names."""
    mask = np.uint64((1 << 18) - 1)
    some = np.zeros(1 << 18, bool)
    some[names & mask] = True
    found = grams[some[grams & mask]]
    return found[np.isin(found, names)]


def _probe(names: np.ndarray, bits: int, shift: int) -> np.ndarray:
    return (names >> np.uint64(shift)) & np.uint64((1 << bits) - 1)


SHIFTS = (0, 18, 37)


def in_field(field: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    names, found = mixed(names), np.ones(len(names), bool)  # smallest hashes have few high bits: mix before probing
    for shift in SHIFTS:
        place = _probe(names, bits, shift)
        found &= (field[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


PART_BITS = 19


def bit_field(names: DataFrame, bits: int) -> np.ndarray:
    """Bits set for all names, put together in parts by Spark; 2^bits bits reach the driver."""
    width = 1 << PART_BITS

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = mixed(batch["name"].to_numpy().view(np.uint64))
            place = np.unique(np.concatenate([_probe(some, bits, shift) for shift in SHIFTS]))
            part, inside = place >> np.uint64(PART_BITS), (place & np.uint64(width - 1)).astype(np.uint32)
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            yield pd.DataFrame({"part": part[begin].astype(np.int32), "places": [x.tobytes() for x in np.split(inside, begin[1:])] if len(begin) else []})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"].tolist(), batch["places"]):
                place = np.frombuffer(raw, np.uint32).astype(np.uint64)
                field = parts.setdefault(part, np.zeros(width >> 6, np.uint64))
                np.bitwise_or.at(field, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        yield pd.DataFrame({"part": list(parts), "bits": [f.tobytes() for f in parts.values()]})

    field = np.zeros(max(1 << bits, width) >> 6, np.uint64)
    dealt = names.select("name").mapInPandas(places, "part int, places binary").repartition("part")
    for row in dealt.mapInPandas(build, "part int, bits binary").collect():
        low = row.part * (width >> 6)
        field[low : low + (width >> 6)] |= np.frombuffer(row.bits, np.uint64)
    return field


class Screen(NamedTuple):
    repeated: object  # broadcast bit fields
    hot: object

    def candidates(self, names: np.ndarray) -> np.ndarray:
        return in_field(self.repeated.value, names, SCREEN_BITS)

    def is_hot(self, names: np.ndarray) -> np.ndarray:
        return in_field(self.hot.value, names, HOT_BITS)


def screen(texts: DataFrame, kind: Kind, hot: int = HOT) -> Screen:
    """texts: (doc, text).  Names whose gram occurs twice or more, and those with more than `hot`.

    Occurrences are counted, not runs: a text of short period is one run, and repeats in itself.
    """

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, group in chunks(batch["doc"].tolist(), batch["text"].tolist()):
                units = kind.units(group)
                found = runs(units, kind)
                yield pd.DataFrame({"name": occurrences(units.grams, found.names[found.at]).view(np.int64)})

    counted = texts.mapInPandas(tidy(names), "name long").groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    counted = cut(counted, "repeat-names")
    share = texts.sparkSession.sparkContext.broadcast
    return Screen(share(bit_field(counted, SCREEN_BITS)), share(bit_field(counted.filter(F.col("n") > hot), HOT_BITS)))


UNNAMED = 1 << 40  # so many of the largest numbers stand for rows without an id


def numbered(text: str, id_col: str) -> Column:
    """The id; a row without one is numbered by its text, above all ids."""
    unnamed = F.lit(NO_ID) - F.pmod(F.xxhash64(text_of(text)), F.lit(UNNAMED))
    return F.coalesce(F.col(id_col).cast("long"), unnamed)


def contexts(texts: DataFrame, kind: Kind, seen: Screen) -> DataFrame:
    """Rows of a name and a context: the smallest doc of a batch that has it, with its starts there.

    A context is a run's windows as text.  loop: the name's gram occurs in it more than once, so
    one context may hold a window twice.  whole_groups merges the batches.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple, tuple[int, list[int]]] = {}
            for ids, group in chunks(batch["doc"].tolist(), batch["text"].tolist()):
                units = kind.units(group)
                found = runs(units, kind)
                name = found.names[found.at]
                keep = seen.candidates(name)
                at, length, text, name = found.at[keep], found.length[keep], found.text[keep], name[keep]
                if not len(at):
                    continue
                span = length + kind.spread - 1
                place = np.repeat(at - (np.cumsum(span) - span), span) + np.arange(span.sum())
                loop = np.add.reduceat((units.grams[place] == np.repeat(name, span)).astype(np.int32), np.cumsum(span) - span) > 1
                split = seen.is_hot(name)
                if split.any():  # one row per window, named by its content
                    times = np.where(split, length, 1)
                    of = np.repeat(np.arange(len(at)), times)
                    step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                    at, text, loop, split = at[of] + step, text[of], loop[of] & ~split[of], split[of]
                    length = np.where(split, 1, length[of])
                    grams = units.grams
                    middle, last = at + kind.spread // 2, at + kind.spread - 1
                    name = np.where(split, mixed(mixed(grams[at]) + mixed(grams[middle] + _MIX) * np.uint64(3) + grams[last]), name[of])
                starts = (at - units.begin[text]).tolist()
                last_text, take = -1, None
                for t, s, n, key, twice in zip(text.tolist(), starts, length.tolist(), name.view(np.int64).tolist(), loop.tolist()):
                    if t != last_text:
                        last_text, take, doc = t, kind.cut_out(group[t]), ids[t]
                    key = (key, take(s, s + n + kind.window - 1), twice)
                    known = out.get(key)
                    if known is None or doc < known[0]:
                        out[key] = (doc, [s])
                    elif doc == known[0]:
                        known[1].append(s)
            yield pd.DataFrame([(k, c, d, v, w) for (k, c, w), (d, v) in out.items()], columns=["name", "context", "doc", "starts", "loop"])

    return texts.mapInPandas(tidy(rows), CONTEXT)


def by_name(df: DataFrame) -> DataFrame:
    return df.repartition("name").sortWithinPartitions("name")


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by name, regrouped so that no name is cut."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        inside = held["name"].to_numpy() != held["name"].iloc[-1] if len(held) else np.zeros(0, bool)
        if inside.any():
            yield held[inside].reset_index(drop=True)
            held = held[~inside].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def distinct_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole names, and of each context only the smallest doc."""
    for rows in whole_groups(batches):
        rows = rows.sort_values(["name", "doc"], kind="stable")
        yield rows[~rows.duplicated(["name", "context"])].reset_index(drop=True)


def alone(rows: pd.DataFrame) -> np.ndarray:
    """Rows that are the only context of their name."""
    name = rows["name"].to_numpy()
    same = name[1:] == name[:-1]
    return ~(np.append(False, same) | np.append(same, False))


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as half-open intervals."""
    if not len(starts):
        return starts, starts
    edge = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)] + 1


def candidate_starts(units: Units, kind: Kind, seen: Screen) -> np.ndarray:
    """For every unit: does a window that may repeat begin here?"""
    found = runs(units, kind)
    good = seen.candidates(found.names[found.at])
    change = np.zeros(len(found.names) + 1, np.int32)
    np.add.at(change, found.at[good], 1)
    np.add.at(change, found.at[good] + found.length[good], -1)
    return np.cumsum(change[:-1]) > 0


def covered(starts: np.ndarray, window: int) -> np.ndarray:
    """Units covered by a window that begins where starts is set."""
    total = np.cumsum(np.append(0, starts))
    low = np.maximum(np.arange(len(starts)) - window + 1, 0)
    return total[1:] - total[low] > 0

"""Suffix-array deduplication: removes repeats of 100 bytes and more, keeping first occurrences.

Contexts of one name (see repeats) are joined to one text with a separator of its own behind each.
Its suffix array is built by prefix doubling, and its Burrows-Wheeler transform is stored as one
bit vector per bit of the alphabet.  Starting from the intervals of single letters, every interval
of suffixes with a common word is extended backward by every letter before it; the first extension
to end at a place fixes the common prefix there, and lengths come out in ascending order.  The
expansion stops at the minimum length: places still open then have longer common prefixes, and the
suffixes between two fixed places begin with the same 100 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import free_name, text_of, tidy

KEPT = "doc long, a int, b int"


def suffix_array(symbols: np.ndarray, text_no: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order.  symbols: 0 ends a text, and ends are ordered by text; left: symbols before it."""
    n, step = len(symbols), 7
    padded = np.append(symbols.astype(np.int64), np.zeros(step, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << 9) | np.where(k < left, padded[k : k + n], 0)
    key[left == 0] = text_no[left == 0] - n  # before all others
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    sorted_key = key[order]
    while True:
        fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
        head = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rank[order[slots]] = head
        tied = ~(fresh & np.append(fresh[1:], True))
        slots = slots[tied]
        if not len(slots):
            return order
        at = order[slots]
        follow = np.where(left[at] >= step, rank[np.minimum(at + step, n - 1)], text_no[at])
        mixed = rank[at] * (n + 1) + follow
        by = np.argsort(mixed, kind="stable")
        order[slots] = at[by]
        sorted_key = mixed[by]
        step *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the suffix array the common prefix with the place before; -1: least or more."""
    n = len(symbols)
    values, codes = np.unique(symbols, return_inverse=True)
    bits = max(1, int(len(values) - 1).bit_length())
    last = codes[order - 1].astype(np.int32)  # the transform: the letter before each suffix
    zeros, ones = [], []
    for b in range(bits):  # least bit first: the last partition is the order of the first letters
        bit = (last >> b) & 1
        zeros.append(np.append(0, np.cumsum(1 - bit, dtype=np.int32)).astype(np.int32))
        ones.append(int(zeros[-1][-1]))
        last = np.concatenate([last[bit == 0], last[bit == 1]])
    ends = np.cumsum(np.bincount(codes, minlength=len(values)))
    texts = int(ends[0])
    common = np.full(n + 1, -1, np.int16)
    common[: texts + 1] = 0
    common[n] = 0
    common[ends] = 0
    low = np.concatenate([np.arange(texts), ends[:-1]]).astype(np.int32)
    high = np.concatenate([np.arange(1, texts + 1), ends[1:]]).astype(np.int32)
    for length in range(1, least):
        letter = np.zeros(len(low), np.int32)
        for b in range(bits):
            low0, high0 = zeros[b][low], zeros[b][high]
            low1, high1 = low - low0 + ones[b], high - high0 + ones[b]
            has0, has1 = high0 > low0, high1 > low1
            low = np.concatenate([low0[has0], low1[has1]])
            high = np.concatenate([high0[has0], high1[has1]])
            letter = np.concatenate([letter[has0], letter[has1] | (1 << b)])
        new = (letter > 0) & (common[high] < 0)
        low, high = low[new], high[new]
        if not len(low):
            break
        common[high] = length
    return common[:n]


def first_windows(contexts: list[bytes], window: int) -> list[np.ndarray]:
    """For each context, in order of precedence, the offsets of windows that occur there first."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    text_no = np.repeat(np.arange(len(contexts)), sizes + 1)
    left = ends[text_no] - np.arange(len(joined))
    symbols = joined.astype(np.int16) + 1
    symbols[ends] = 0
    order = suffix_array(symbols, text_no, left)
    bounds = np.flatnonzero(common_prefixes(symbols, order, window) >= 0)
    first = np.minimum.reduceat(order, bounds)
    first = np.sort(first[left[first] >= window])
    part = np.searchsorted(first, begins)
    return [first[a:b] - s for a, b, s in zip(part.tolist(), np.append(part[1:], len(first)).tolist(), begins.tolist())]


def _keep(window: int):
    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in repeats.distinct_contexts(batches):
            plain = repeats.alone(rows) & ~rows["loop"].to_numpy()
            rows["start"] = [s[0] for s in rows["starts"]]
            size = rows["context"].str.len().to_numpy()
            single = rows[plain]
            yield pd.DataFrame({"doc": single["doc"], "a": single["start"], "b": single["start"] + size[plain] - window + 1})
            group = rows[~plain].sort_values(["name", "doc", "start"], kind="stable")
            if not len(group):
                continue
            doc, a, b = [], [], []
            for d, s, offsets in zip(group["doc"].tolist(), group["start"].tolist(), first_windows(group["context"].tolist(), window)):
                low, high = repeats.spans(offsets)
                doc += [d] * len(low)
                a += (low + s).tolist()
                b += (high + s).tolist()
            yield pd.DataFrame({"doc": doc, "a": a, "b": b})

    return tidy(kept)


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 100, hot: int = repeats.HOT) -> DataFrame:
    """The documents, with all their columns, and one struct column `repeats` more.

    repeats: n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).  A byte goes when it
    is covered by `window` bytes that also start earlier: in a smaller id, or before in the same
    text.  Null text counts as empty and loses nothing; texts shorter than the window keep all
    bytes.  Rows without an id come last in the order, each distinct text as a document of its own;
    rows that share an id, or have none and one text, count as one place, so equal rows both keep what they hold first.  Empty tables stay empty.
    """
    kind = repeats.BYTES._replace(window=window)
    texts = docs.select(repeats.numbered(text, id_col).alias("doc"), text_of(text).alias("text"))
    seen = repeats.screen(texts, kind, hot)
    kept = repeats.by_name(repeats.contexts(texts, kind, seen)).mapInPandas(_keep(window), KEPT)
    return apply_kept(docs, kept, kind, seen, text, id_col, _remove)


def _remove(raw: bytes, gone: np.ndarray) -> dict:
    low, _ = repeats.spans(np.flatnonzero(gone))
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(low) else raw
    return {"n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": len(low), "kept": kept}


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def apply_kept(docs: DataFrame, kept: DataFrame, kind: repeats.Kind, seen: repeats.Screen, text: str, id_col: str, remove, result: str = RESULT) -> DataFrame:
    """Windows that may repeat and were not kept go, with all they cover."""
    spans = kept.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    spans = spans.select("doc", F.transform("spans", lambda s: s["a"]).alias("_a"), F.transform("spans", lambda s: s["b"]).alias("_b"))
    name, out = free_name(docs, "doc"), free_name(docs, "repeats")
    keyed = docs.withColumn(name, repeats.numbered(text, id_col))
    joined = keyed.join(spans.withColumnRenamed("doc", name), name, "left")

    @F.pandas_udf(result)
    def decide(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows, place = [], 0
        for _, group in repeats.chunks([0] * len(texts), texts.tolist()):
            units = kind.units(group)
            maybe = repeats.candidate_starts(units, kind, seen)
            for raw, begin, count in zip(group, units.begin.tolist(), units.count.tolist()):
                starts = maybe[begin : begin + count].astype(np.int64)
                if a.iloc[place] is not None and starts.any():
                    for x, y in zip(a.iloc[place], b.iloc[place]):
                        starts[x:y] = 0
                rows.append(remove(raw, repeats.covered(starts, kind.window)))
                place += 1
        return pd.DataFrame(rows, columns=[c.split()[0] for c in result.split(", ")])

    return joined.withColumn(out, decide(text_of(text), "_a", "_b")).drop("_a", "_b", name)



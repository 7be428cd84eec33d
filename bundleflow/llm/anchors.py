"""Substring deduplication with fixed-block anchors, over words.

Contexts of one name (see repeats) meet in one place.  There every non-overlapping block of 25
words of a context is an anchor in the index; each rolling window of 25 words probes it; a hit
whose anchor belongs to a smaller document is extended to 50 words and more, by the block that
follows each probe, up to maximal exact repeats.  A window of 50 words always holds a whole
anchor, so nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .bwt import KEPT, apply_kept
from .common import text_of, tidy

RESULT = "n_words long, n_removed long, kept string"


def _smallest(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the smallest doc of each."""
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    first = np.append(True, keys[1:] != keys[:-1])
    return keys[first], doc[first]


def _lookup(keys: np.ndarray, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The smallest doc of each wanted key; NO_ID where it is not indexed."""
    if not len(keys):
        return np.full(len(wanted), repeats.NO_ID)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, docs[at], repeats.NO_ID)


def repeated_windows(contexts: list[bytes], names: np.ndarray, docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each context a flag per window: does it also stand in a smaller document of its name?"""
    block = window // 2
    _, _, words = repeats.word_hashes(b"\n".join(contexts))
    count = np.fromiter((c.count(b" ") + 1 for c in contexts), np.int64, len(contexts))
    begin = np.cumsum(count) - count
    of = np.repeat(np.arange(len(contexts)), count)
    place = np.arange(len(words)) - begin[of]
    grams = repeats.mixed(repeats.rolling(words, block) + repeats.mixed(names.view(np.uint64))[of])
    whole = place <= count[of] - block
    doc = docs[of]
    # index: non-overlapping blocks; probe: every gram
    anchor = whole & (place % block == 0)
    hit = whole & (_lookup(*_smallest(grams[anchor], doc[anchor]), grams) < doc)
    # extend: windows around a hit whose two halves both agree with a smaller document
    starts = place <= count[of] - window
    near = np.cumsum(np.append(0, hit))
    reach = np.minimum(np.arange(len(words)) + window - block + 1, len(words))
    maybe = starts & (near[reach] > near[:-1])
    at = np.flatnonzero(starts)
    key = repeats.mixed(grams[at]) * np.uint64(3) + grams[np.minimum(at + window - block, len(words) - 1)]
    gone = np.zeros(len(words), bool)
    gone[at] = maybe[at] & (_lookup(*_smallest(key, doc[at]), key) < doc[at])
    return [gone[b : b + c - window + 1] for b, c in zip(begin.tolist(), count.tolist())]


def _keep(window: int):
    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in repeats.distinct_contexts(batches):
            plain = repeats.alone(rows)
            doc, a, b = [], [], []
            single = rows[plain]
            for d, starts, context in zip(single["doc"].tolist(), single["starts"].tolist(), single["context"].tolist()):
                size = context.count(b" ") + 2 - window
                doc += [d] * len(starts)
                a += starts.tolist()
                b += (starts + size).tolist()
            group = rows[~plain]
            if len(group):
                found = repeated_windows(group["context"].tolist(), group["name"].to_numpy(), group["doc"].to_numpy(), window)
                for d, starts, gone in zip(group["doc"].tolist(), group["starts"].tolist(), found):
                    low, high = repeats.spans(np.flatnonzero(~gone))
                    for s in starts.tolist():
                        doc += [d] * len(low)
                        a += (low + s).tolist()
                        b += (high + s).tolist()
            yield pd.DataFrame({"doc": doc, "a": a, "b": b})

    return tidy(kept)


def _remove(raw: bytes, gone: np.ndarray) -> dict:
    words = raw.split()
    left = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
    return {"n_words": len(words), "n_removed": len(words) - len(left), "kept": b" ".join(left).decode("utf-8", "surrogatepass")}


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 50, hot: int = repeats.HOT) -> DataFrame:
    """The documents, with all their columns, and one struct column `repeats` more.

    repeats: n_words, n_removed, kept (the words that stay, joined by one space).  Words are runs
    of non-space characters, unchanged.  A word goes when it is covered by `window` words that
    also start in a document with a smaller id; repeats inside one document stay.  Null text has
    no words; texts shorter than the window lose none.  Rows without an id come last, each
    distinct text as a document of its own; rows that share an id, or have none and one text, count as
    one document.  Empty tables stay empty.
    """
    kind = repeats.WORDS._replace(window=window)
    texts = docs.select(repeats.numbered(text, id_col).alias("doc"), text_of(text).alias("text"))
    seen = repeats.screen(texts, kind, hot)
    kept = repeats.by_name(repeats.contexts(texts, kind, seen)).mapInPandas(_keep(window), KEPT)
    return apply_kept(docs, kept, kind, seen, text, id_col, _remove, RESULT)

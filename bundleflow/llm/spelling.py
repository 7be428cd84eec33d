"""Spelling variants: words of a corpus one edit apart, found with a bit-sliced position index.

The index of a set of words holds, for every position and letter, a bit set of the words with that
letter there.  A query word walks its letters once and keeps two bit sets, the words that agree so
far without an error and with one; a deleted or inserted letter reads the index one position
earlier or later.  One step handles 64 words.

So that not all words meet all words, the index is cut into classes.  Of a word of length l, one edit
leaves the first l // 2 letters or the last l - l // 2 as they were, so a near word shares one of the
two; the class is the length, the side and the shared letters.  A word is indexed in its own two
classes and looked up in those of its length and of one letter less and more; a pair that meets on
both sides counts on the first.  Classes with very many words are dealt out: their queries are
spread, and every part has the whole index of the class.  Bits are in order of preference, so a
query's best near word is its first bit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .winnow import _sized

SHORTEST = 7  # code points of a word
LEAST = 2  # occurrences of a word
TIMES = 10  # a form is at least so many times as frequent as its variant
HOT = 1 << 14  # queries of one class in one part
ELEMENTS = 1 << 18  # query and index words compared at once
TABLE = 1 << 22  # entries of a position index kept as a table; larger ones are searched
PIECE = 1 << 20  # characters of text searched at once
# Fixed value: the letters of the query contract.
LETTERS = "A-Za-zÀ-ÿ"
_WORD, _OTHER = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
_LOWER = {c: c + 32 for c in range(65, 91)}
FOUND = "word string, n long, n_near long, best_n long, best string"


def pieces(text: str) -> Iterator[str]:
    """A text cut between words."""
    low = 0
    while len(text) - low > PIECE:
        edge = _OTHER.search(text, low + PIECE)
        if not edge:
            break
        yield text[low : edge.start()]
        low = edge.start()
    yield text[low:]


def count_words(docs: DataFrame, change: Callable[[object, str], str] | None = None, text: str = "text", id_col: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with their number in all texts.

    change(id, word) may replace a word of a document by one that is no longer.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for i, body in zip(batch["id"], batch["text"]):
                if body is None:
                    continue
                for piece in pieces(body):
                    for raw, n in Counter(_WORD.findall(piece)).items():
                        if len(raw) < shortest:
                            continue
                        word = raw.translate(_LOWER)
                        word = change(i, word) if change else word
                        if len(word) >= shortest:
                            total[word] += n
            yield pd.DataFrame({"word": pd.Series(list(total.keys()), dtype=object), "n": list(total.values())})

    # Ids travel as text, so that a null stays a null.
    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def misspelt(every: int) -> Callable[[object, str], str]:
    """Leaves out a letter of one word in `every`, chosen by a checksum of document and word."""

    def change(i: object, word: str) -> str:
        h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
        if h % every:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def _class(length, side: str, letters) -> F.Column:
    return F.concat(length.cast("string"), F.lit(side), letters)


def class_rows(words: DataFrame) -> DataFrame:
    """(class, shift, word, n, shared): shift 0 rows are indexed too; shift is query length less class length.

    shared: how many letters of the word the class fixes, at its beginning, or, if negative, at its end.
    """
    rows = []
    for shift in (0, 1, -1):
        length = F.length("word") - shift
        half = F.floor(length / 2).cast("int")
        rows.append(F.struct(_class(length, "<", F.substring(F.col("word"), F.lit(1), half)).alias("class"), F.lit(shift).alias("shift"), half.alias("shared")))
        rows.append(F.struct(_class(length, ">", F.substring(F.col("word"), half + shift + 1, length - half)).alias("class"), F.lit(shift).alias("shift"), (half - length).alias("shared")))
    whole = F.filter(F.array(*rows), lambda r: F.length("word") > r["shift"])  # no class of empty words
    return words.select("word", "n", F.explode(whole).alias("r")).select("r.*", "word", "n")


class _Letters:
    """Code points of several words in a row."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


class PositionIndex:
    """Bit sets of the indexed words, 64 to a slot, by slot, position and letter."""

    def __init__(self, letters: _Letters, members: np.ndarray, slot: np.ndarray, bit: np.ndarray):
        size = letters.size[members]
        owner = np.repeat(np.arange(len(members)), size)
        position = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        codes = letters.codes[letters.begin[members][owner] + position]
        self.alphabet = np.unique(codes)
        self.width = len(self.alphabet) + 1  # the last letter stands for all others: no word has it
        self.places = int(size.max(initial=0)) + 3
        key = self._key(slot[owner], position, np.searchsorted(self.alphabet, codes))
        bits = np.uint64(1) << bit[owner].astype(np.uint64)
        total = (int(slot.max(initial=0)) + 1) * self.places * self.width
        if total <= TABLE:
            self.keys, self.bits = None, np.zeros(total, np.uint64)
            np.bitwise_or.at(self.bits, key, bits)
        else:
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            self.keys, self.bits = key[order][first], np.bitwise_or.reduceat(bits[order], first)

    def _key(self, slot, position, letter):
        return (slot * self.places + position + 1) * self.width + letter

    def letter(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, self.width - 1)

    def words(self, slot: np.ndarray, position: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = self._key(slot, np.minimum(position, self.places - 2), letter)
        if self.keys is None:
            return self.bits[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.bits[at], np.uint64(0))


def one_error(index: PositionIndex, letters: _Letters, query: np.ndarray, slot: np.ndarray, full: np.ndarray, shared: np.ndarray, shift: int) -> np.ndarray:
    """Bits of the words of a slot with exactly one error to the query.  full: all bits of the slot.

    The letters that the class shares are not walked.  On the second side, words that share the
    first letters as well are left out.
    """
    front = shared >= 0
    begin = np.where(front, shared, 0)
    stop = np.where(front, letters.size[query], letters.size[query] + shared)
    order = np.argsort(begin - stop, kind="stable")  # longest walks first, so that those still walking lead
    query, slot, front, begin, steps = query[order], slot[order], front[order], begin[order], (stop - begin)[order]
    none, one = full[order].copy(), np.zeros(len(order), np.uint64)
    if shift < 0:
        one |= none
    half = (letters.size[query] - shift) // 2
    same_front = np.zeros(len(order), np.uint64)
    base = letters.begin[query] + begin
    for i in range(int(steps.max(initial=0)) + 1):
        m = int(np.searchsorted(-steps, -i, side="right"))  # those with i steps or more
        ready = np.flatnonzero(~front[:m] & (i == np.where(shift < 0, steps[:m], half[:m])))
        if shift and len(ready):  # half letters seen; the query of a longer class needs one more
            z = none[ready]
            if shift < 0:
                z = z & index.words(slot[ready], half[ready] - 1, index.letter(letters.codes[base[ready] + i]))
            same_front[ready] = z
        m = int(np.searchsorted(-steps, -(i + 1), side="right"))
        if not m:
            continue
        at, s = begin[:m] + i, slot[:m]
        letter = index.letter(letters.codes[base[:m] + i])
        here, z = index.words(s, at, letter), none[:m]
        left = z & here
        if shift == 0:
            one[:m] = (one[:m] & here) | (z & ~here)
        elif shift > 0:
            one[:m] = (one[:m] & index.words(s, at - 1, letter)) | z
        else:
            one[:m] = (one[:m] & index.words(s, at + 1, letter)) | left
        none[:m] = left
    found = np.empty(len(order), np.uint64)
    found[order] = one & ~same_front
    return found


def near_in_classes(rows: pd.DataFrame) -> pd.DataFrame:
    """Per query row: how many words of its class are near, and the first of them in order of preference.

    rows: whole classes, each in order of preference.
    """
    words = rows["word"].tolist()
    letters = _Letters(words)
    shift, n = rows["shift"].to_numpy(), rows["n"].to_numpy()
    group = rows["part"].to_numpy()
    member = np.flatnonzero(rows["indexed"].to_numpy())
    inside = group[member]
    place = np.arange(len(member)) - np.searchsorted(inside, inside)  # of a word in its class
    count = np.bincount(inside, minlength=group.max(initial=-1) + 1)
    slots = -(-count // 64)
    first_slot = np.cumsum(slots) - slots
    slot = first_slot[inside] + place // 64
    index = PositionIndex(letters, member, slot, place % 64)
    full = np.zeros(int(slots.sum()), np.uint64)
    np.bitwise_or.at(full, slot, np.uint64(1) << (place % 64).astype(np.uint64))
    member_of = np.full(len(full) * 64, -1, np.int64)
    member_of[slot * 64 + place % 64] = member
    n_near, best = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
    asked = rows["asked"].to_numpy()
    for kind in (0, 1, -1):
        query = np.flatnonzero((shift == kind) & asked & (slots[group] > 0))
        for part in _blocks(query, slots[group[query]]):
            times = slots[group[part]]
            of = np.repeat(np.arange(len(part)), times)
            step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            at = first_slot[group[part]][of] + step
            bits = one_error(index, letters, part[of], at, full[at], rows["shared"].to_numpy()[part[of]], kind)
            hit = np.flatnonzero(bits)
            np.add.at(n_near, part[of[hit]], np.bitwise_count(bits[hit]).astype(np.int64))
            lead = hit[np.append(True, of[hit][1:] != of[hit][:-1])] if len(hit) else hit
            low = bits[lead] & (~bits[lead] + np.uint64(1))
            best[part[of[lead]]] = member_of[at[lead] * 64 + np.log2(low.astype(np.float64)).astype(np.int64)]
    # A word's own first class reports it even without near words.
    keep = np.flatnonzero(asked & ((n_near > 0) | ((shift == 0) & (rows["shared"].to_numpy() >= 0))))
    chosen = best[keep]
    name = [words[b] if b >= 0 else None for b in chosen.tolist()]
    return pd.DataFrame({"word": pd.Series([words[k] for k in keep.tolist()], dtype=object), "n": n[keep], "n_near": n_near[keep], "best_n": np.where(chosen >= 0, n[chosen], 0), "best": pd.Series(name, dtype=object)})


def _blocks(query: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
    """Queries in groups of about ELEMENTS comparisons."""
    if len(query):
        number = (np.cumsum(weight) - 1) // ELEMENTS
        yield from np.split(query, np.flatnonzero(np.diff(number)) + 1)


def _whole(batches: Iterator[pd.DataFrame], rows: int = 1 << 15) -> Iterator[pd.DataFrame]:
    """Sorted batches regrouped so that no class is cut, many small classes together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        both = pd.concat(held, ignore_index=True)
        key = (both["class"] + both["salt"].astype(str)).to_numpy()
        inside = key != key[-1]
        if inside.any():
            yield both[inside].reset_index(drop=True)
        held = [both[~inside].reset_index(drop=True)]
        size = len(held[0])
    if size:
        yield pd.concat(held, ignore_index=True)


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, best_n, best) for every word: its near words and the most frequent of them."""
    rows = class_rows(cut(words, "spelling-words"))
    queries = rows.groupBy("class").agg(F.count("*").alias("_size"), F.count(F.when(F.col("shift") == 0, 1)).alias("_indexed"))
    crowded = queries.filter((F.col("_size") > hot) & (F.col("_indexed") > 0)).select("class", F.ceil(F.col("_size") / hot).cast("int").alias("_parts"))
    dealt = rows.join(_sized(cut(crowded, "crowded-classes")), "class", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    indexed = F.col("shift") == 0
    salts = F.when(indexed, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(own))
    dealt = dealt.select("class", "shift", "shared", "word", "n", indexed.alias("indexed"), own.alias("_own"), F.explode(salts).alias("salt"))
    dealt = dealt.withColumn("asked", F.col("salt") == F.col("_own")).drop("_own")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _whole(batches):
            key = group["class"] + group["salt"].astype(str)
            group["part"] = (key != key.shift()).cumsum() - 1
            yield near_in_classes(group)

    ordered = dealt.repartition("class", "salt").sortWithinPartitions("class", "salt", F.desc("n"), "word")
    found = ordered.mapInPandas(solve, FOUND)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.word").alias("best"))


def group_variants(words: DataFrame, times: int = TIMES, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of distinct words and their numbers n.

    form: the most frequent near word if it is `times` as frequent, the smallest at a tie; root:
    where following forms ends.  Numbers grow by `times` along a chain, so it ends, and its length is
    bounded by the digits of a number.  Empty words and rows without a word or number are left out; an empty table gives none.
    """
    words = words.filter((F.col("word") != "") & F.col("n").isNotNull()).select("word", "n")
    near = near_words(words, hot)
    good = F.col("best_n") >= times * F.col("n")
    named = near.select("word", F.when(good, F.col("best")).alias("form"), "n", "n_near", F.when(good, F.col("best_n")).alias("form_n"))
    named = cut(named, "spelling-forms")
    step = cut(named.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # doubling: after k rounds a root is 2^k forms away
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(step.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        step = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            break
    return named.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The frequent words of a corpus are compiled into an automaton that shares prefixes and suffixes.
Its transitions carry numbers whose sum along a word is the word's rank in order, and the rank leads
to the word's ids.  Transitions are laid out in one displaced table, so a step is two look-ups.
Vocabulary, table and ids form one file that Spark hands to every executor and workers map into
memory.  All words of a piece of text walk the automaton together, a byte a step; words that it
does not hold are merged exactly, by rank.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from bundleflow.session import scratch_dir

from .common import cut, free_name, text_of

WORDS = 1 << 17  # words compiled at most, the most frequent ones
LONGEST = 64  # bytes of a compiled word
SHORT = 256  # bytes of a word merged together with others; longer ones are merged rank by rank
KNOWN = 1 << 18  # merged words that a worker remembers
PIECE = 1 << 18  # characters of text handled at once
# Fixed value: how byte-level vocabularies split text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = re.compile(  # for ASCII; see kinds
    SPLIT.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII
)
_CUT = regex.compile(r"(?<=\S)\s")  # a word never goes on behind such a place


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary(NamedTuple):
    pairs: np.ndarray  # left id << 32 | right id, ascending
    rank: np.ndarray  # of each pair
    joined: np.ndarray  # id of each pair merged
    byte_id: np.ndarray
    start: np.ndarray  # of each id's bytes in blob
    size: np.ndarray
    blob: np.ndarray
    special: tuple[tuple[str, int], ...]


def read_vocabulary(path: str) -> Vocabulary:
    """From a tokenizer file of the byte-level BPE kind, read on the driver."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
    wanted = model["type"] == "BPE" and split["type"] == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"] and not spec["normalizer"] and not model["ignore_merges"]
    if not wanted or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    letters, ids = _byte_letters(), model["vocab"]
    content = {i: bytes(letters[c] for c in token) for token, i in ids.items()} | {t["id"]: t["content"].encode() for t in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    rows = np.array([(ids[a] << 32 | ids[b], r, ids[a + b]) for r, (a, b) in enumerate(merges)], np.int64).reshape(-1, 3)
    if len(np.unique(rows[:, 2])) != len(rows):
        raise ValueError(f"{path}: two merges make one token")
    rows = rows[np.argsort(rows[:, 0])]
    tokens = [content.get(i, b"") for i in range(max(content) + 1)]
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    at = {b: i for i, b in content.items() if len(b) == 1}
    return Vocabulary(
        rows[:, 0], rows[:, 1].astype(np.int32), rows[:, 2].astype(np.int32), np.array([at[bytes([b])] for b in range(256)], np.int32),
        np.cumsum(size) - size, size, np.frombuffer(b"".join(tokens), np.uint8), tuple((t["content"], t["id"]) for t in added),
    )


NO_MERGE = np.int32((1 << 31) - 1)


class Merger:
    """Exact merges of words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.by_rank = np.argsort(v.rank)

    def many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word.  Short words are merged together: in every round each makes its merge of lowest rank."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= SHORT]
        for k, w in enumerate(words):
            if not 0 < len(w) <= SHORT:
                out[k] = self._long(w)
        size = np.fromiter((len(words[k]) for k in short), np.int64, len(short))
        ids = self.v.byte_id[np.frombuffer(b"".join(words[k] for k in short), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(short)), size)
        rank, joined = np.full(len(ids), NO_MERGE), np.zeros(len(ids), np.int32)
        self._look(ids, word, np.arange(len(ids)), rank, joined)
        ready = []
        while len(ids):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(begin, len(word)))
            best = np.minimum.reduceat(rank, begin)
            going = np.repeat(best < NO_MERGE, length)
            ready.append((word[~going], ids[~going]))
            hit = (rank == np.repeat(best, length)) & going
            ids, word, rank, joined, hit = (x[going] for x in (ids, word, rank, joined, hit))
            at = np.flatnonzero(hit)
            if not len(at):
                break
            fresh = np.append(True, np.diff(at) > 1)  # of places that overlap, every other one from the left
            first = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            ids[at] = joined[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # where the merged ones are once their right halves are gone
            ids, word, rank, joined = ids[keep], word[keep], rank[keep], joined[keep]
            self._look(ids, word, now, rank, joined)
            self._look(ids, word, now[now > 0] - 1, rank, joined)
        word, ids = (np.concatenate([r[i] for r in ready]) if ready else np.zeros(0, np.int64) for i in (0, 1))
        ids = ids[np.argsort(word, kind="stable")].astype(np.int32)
        upto = np.append(0, np.cumsum(np.bincount(word, minlength=len(short)))).tolist()
        for k, a, b in zip(short, upto, upto[1:]):
            out[k] = ids[a:b]
        return out

    def _look(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray, rank: np.ndarray, joined: np.ndarray) -> None:
        """Set rank and result of the pairs that begin at some places."""
        rank[at] = NO_MERGE
        at = at[at + 1 < len(ids)]
        at = at[word[at] == word[at + 1]]
        pair = ids[at] << 32 | ids[at + 1]
        k = np.minimum(np.searchsorted(self.v.pairs, pair), len(self.v.pairs) - 1)
        good = self.v.pairs[k] == pair
        at, k = at[good], k[good]
        rank[at], joined[at] = self.v.rank[k], self.v.joined[k]

    def _long(self, word: bytes) -> np.ndarray:
        """All places of one rank at a time.  A merge only makes pairs of later ranks, as every token has one merge."""
        ids = self.v.byte_id[np.frombuffer(word, np.uint8)].astype(np.int64)
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(places: np.ndarray) -> None:
            places = places[(places >= 0) & (after[places] < n)]
            pair = ids[places] << 32 | ids[after[places]]
            k = np.minimum(np.searchsorted(self.v.pairs, pair), len(self.v.pairs) - 1)
            good = self.v.pairs[k] == pair
            rank, places = self.v.rank[k[good]], places[good]
            order = np.argsort(rank, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1) if len(order) else []:
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(places[part])

        look(np.arange(n))
        alive = np.ones(n, bool)
        while heap:
            r = heapq.heappop(heap)
            k = self.by_rank[r]
            left, right = int(self.v.pairs[k]) >> 32, int(self.v.pairs[k]) & 0xFFFFFFFF
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (ids[at] == left) & (after[at] < n)]
            at = at[ids[after[at]] == right]
            if left == right and len(at):  # of neighbours that overlap, every other one from the left
                chain = np.append(False, after[at[:-1]] == at[1:])
                begin = np.flatnonzero(~chain)
                at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at], alive[gone], after[at] = self.v.joined[k], False, after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            look(np.unique(np.concatenate([at, before[at]])))
        return ids[alive].astype(np.int32)


class Automaton(NamedTuple):
    base: np.ndarray  # of each state's row; state 0 is the start
    check: np.ndarray  # state that owns a slot, or -1
    target: np.ndarray
    skipped: np.ndarray  # number of words before those behind a transition
    final: np.ndarray

    def numbers(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rank of each word raw[start : start + size], or -1; all words walk together."""
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        moving, done = np.flatnonzero((size > 0) & (size <= LONGEST)), np.full(len(start), -1, np.int64)
        step = 0
        while len(moving):
            s = state[moving]
            slot = self.base[s] + raw[start[moving] + step]
            open_ = self.check[slot] == s
            moving, slot = moving[open_], slot[open_]
            s = self.target[slot]
            state[moving] = s
            total[moving] += self.skipped[slot]
            step += 1
            ended = size[moving] == step
            last = moving[ended]
            done[last] = np.where(self.final[s[ended]], total[last], -1)
            moving = moving[~ended]
        return done


def compile_words(words: list[bytes]) -> Automaton:
    """Minimal automaton of distinct words in ascending order, built word by word.

    States behind the last word's path are final in form and are shared with equal ones.
    """
    known: dict[tuple, int] = {}
    rows: list[tuple] = []  # of each shared state: final, ((label, state), ...)
    behind: list[int] = []  # words behind each shared state

    def share(is_final: bool, edges: list) -> int:
        key = (is_final, *edges)
        if key not in known:
            known[key] = len(rows)
            rows.append((is_final, edges))
            behind.append(is_final + sum(behind[t] for _, t in edges))
        return known[key]

    path: list[list] = [[False, []]]  # final and edges of the states along the last word
    last = b""
    for word in [*words, None]:
        common = 0
        if word is not None:
            while common < len(last) and common < len(word) and last[common] == word[common]:
                common += 1
        while len(path) > common + 1:
            closed = path.pop()
            path[-1][1].append((last[len(path) - 1], share(*closed)))
        if word is not None:
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
    root = share(*path[0])
    order = [root] + [k for k in range(len(rows)) if k != root]
    number = np.empty(len(rows), np.int64)
    number[order] = np.arange(len(rows))
    return _laid_out([rows[k] for k in order], number, behind)


def _laid_out(rows: list[tuple], number: np.ndarray, behind: list[int]) -> Automaton:
    """Rows of transitions moved into the gaps of each other."""
    edges = sum(len(e) for _, e in rows)
    room = 4 * edges + 1024 + 256
    free = np.ones(room, bool)
    base = np.zeros(len(rows), np.int32)
    check, target, skipped = np.full(room, -1, np.int32), np.zeros(room, np.int32), np.zeros(room, np.int32)

    def put(state: int, at: int) -> None:
        base[state] = at
        final, row = rows[state]
        total = int(final)
        for label, t in row:
            slot = at + label
            free[slot], check[slot], target[slot], skipped[slot] = False, state, number[t], total
            total += behind[t]

    low = 0
    for state in sorted((s for s in range(len(rows)) if len(rows[s][1]) > 1), key=lambda s: -len(rows[s][1])):
        labels = [label for label, _ in rows[state][1]]
        at = low
        while True:
            width = min(2048, room - 256 - at)
            fits = free[at + labels[0] : at + labels[0] + width].copy()
            for label in labels[1:]:
                fits &= free[at + label : at + label + width]
            hit = int(fits.argmax()) if width > 0 else 0
            if width <= 0 or fits[hit]:
                break
            at += width
        if width <= 0:  # grow
            free, check = np.append(free, np.ones(room, bool)), np.append(check, np.full(room, -1, np.int32))
            target, skipped = np.append(target, np.zeros(room, np.int32)), np.append(skipped, np.zeros(room, np.int32))
            room *= 2
            hit = 0
        put(state, at + hit)
        while low < room and not free[low : low + 256].any():
            low += 256
    holes = iter(np.flatnonzero(free[256 : room - 256]).tolist())
    for state, (_, row) in enumerate(rows):
        if len(row) == 1:
            put(state, next(holes) + 256 - row[0][0])
    used = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
    return Automaton(base, check[:used], target[:used], skipped[:used], np.array([f for f, _ in rows], bool))


# The file: a length, a JSON table of (part, field, type, offset, count), and the arrays, each on a multiple of 64.
def pack(vocabulary: Vocabulary, automaton: Automaton, ids: list[np.ndarray]) -> bytes:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    arrays = {f"v.{f}": getattr(vocabulary, f) for f in Vocabulary._fields[:-1]} | {f"a.{f}": getattr(automaton, f) for f in Automaton._fields}
    arrays |= {"ids": flat, "ids_start": np.append(0, np.cumsum(size))}
    table, body, at = [], [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        table.append((name, a.dtype.str, at, len(a)))
        body.append(raw + bytes(-len(raw) % 64))
        at += len(body[-1])
    head = json.dumps({"arrays": table, "special": vocabulary.special}).encode()
    head = struct.pack("<q", len(head)) + head
    return head + bytes(-len(head) % 64) + b"".join(body)


class Coder:
    """Encoder and decoder over a mapped file."""

    def __init__(self, path: str):
        mapped = np.memmap(path, np.uint8, "r")
        size = struct.unpack("<q", mapped[:8].tobytes())[0]
        head = json.loads(mapped[8 : 8 + size].tobytes())
        first = -(-(8 + size) // 64) * 64
        a = {name: mapped[first + at : first + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, at, n in head["arrays"]}
        a = {name: np.asarray(x) for name, x in a.items()}  # plain arrays over the mapped file
        self.v = Vocabulary(*[a[f"v.{f}"] for f in Vocabulary._fields[:-1]], tuple(map(tuple, head["special"])))
        self.automaton = Automaton(*[a[f"a.{f}"] for f in Automaton._fields])
        self.table, self.table_start = a["ids"], a["ids_start"]
        self.merger: Merger | None = None
        self.known: dict[bytes, np.ndarray] = {}
        self.special = dict(self.v.special)
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct words; what is merged is remembered for a while."""
        new = [w for w in words if w not in self.known]
        self.merger = self.merger or Merger(self.v)
        made = dict(zip(new, self.merger.many(new)))
        found = [made[w] if w in made else self.known[w] for w in words]
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
        self.known.update((w, ids) for w, ids in made.items() if len(w) <= LONGEST)
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts: list[str] = []
        owner: list[int] = []
        marks: list[int] = []  # id of a part that is a special token, or -1
        for k, text in enumerate(texts):
            for part in self.between.split(text) if self.between and any(s in text for s in self.special) else [text]:
                mark = self.special.get(part, -1)
                for piece in [part] if mark >= 0 else pieces(part):
                    parts.append(piece)
                    owner.append(k)
                    marks.append(mark)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        low = 0
        while low < len(parts):
            high, held = low, 0
            while high < len(parts) and (held == 0 or held + len(parts[high]) <= PIECE):
                held += len(parts[high]) + 1
                high += 1
            for k, ids in zip(owner[low:high], self._pieces(parts[low:high], marks[low:high])):
                out[k].append(ids)
            low = high
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int32) for p in out]

    def _pieces(self, parts: list[str], marks: list[int]) -> list[np.ndarray]:
        raw = [p.encode("utf-8", "surrogatepass") for p in parts]
        count, sizes = np.zeros(len(parts), np.int64), []
        for k, (part, mark) in enumerate(zip(parts, marks)):
            size = word_sizes(part) if mark < 0 else np.array([len(raw[k])])
            count[k] = len(size)
            sizes.append(size)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        start = np.cumsum(size) - size
        joined = b"".join(raw)
        first = np.cumsum(count) - count
        number = self.automaton.numbers(np.frombuffer(joined, np.uint8), start, size)
        for k in np.flatnonzero(np.array(marks) >= 0).tolist():
            number[first[k]] = -1
        at, n_ids = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        hit = number >= 0
        at[hit], n_ids[hit] = self.table_start[number[hit]], self.table_start[number[hit] + 1] - self.table_start[number[hit]]
        # Special tokens and distinct unseen words get ids behind the table's.
        special_at = {int(first[k]): marks[k] for k in range(len(parts)) if marks[k] >= 0}
        miss = [j for j in np.flatnonzero(~hit).tolist() if j not in special_at] if special_at else np.flatnonzero(~hit)
        seen: dict[bytes, int] = {}
        kind = [seen.setdefault(joined[s:e], len(seen)) for s, e in zip(start[miss].tolist(), (start + size)[miss].tolist())]
        extra = [*self._merged(list(seen)), *[np.array([i], np.int32) for i in special_at.values()]]
        length = np.fromiter(map(len, extra), np.int64, len(extra))
        place = len(self.table) + np.cumsum(length) - length
        at[miss], n_ids[miss] = place[kind], length[kind]
        at[list(special_at)], n_ids[list(special_at)] = place[len(seen) :], 1
        table = np.concatenate([self.table, *extra]) if extra else self.table
        flat = table[np.repeat(at - (np.cumsum(n_ids) - n_ids), n_ids) + np.arange(n_ids.sum())]
        upto = np.append(0, np.cumsum(n_ids))
        return [flat[upto[f] : upto[f + c]] for f, c in zip(first.tolist(), count.tolist())]

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """Text of each list of ids; ids that the vocabulary lacks stand for nothing."""
        out = []
        for ids in rows:
            ids = np.asarray(ids, np.int64)
            ids = ids[(ids >= 0) & (ids < len(self.v.size))]
            size = self.v.size[ids]
            place = np.repeat(self.v.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append(self.v.blob[place].tobytes().decode("utf-8", "replace"))
        return out


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For every code point an ASCII sign that splits like it: ASCII stands for itself.

    Code points that newer tables call letters or digits, and the tokenizers library still signs, are signs.
    """
    if not _kinds:
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, ord("!"), np.uint8)
        for pattern, sign in ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", "\t")):
            table[np.frombuffer("".join(regex.findall(pattern, everything)).encode("utf-32-le"), np.uint32)] = ord(sign)
        splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        for c in regex.findall(r"[\p{L}\p{N}]", everything):
            if unicodedata.category(c) == "Cn" and all(len(splitter.pre_tokenize_str(x + c)) > 1 for x in "a1"):
                table[ord(c)] = ord("!")
        table[:128] = np.arange(128)
        _kinds.append(table)
    return _kinds[0]


def _sizes(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Characters of each word of a text, and its code points unless it is ASCII."""
    codes = None if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    words = _SPLIT.findall(text if codes is None else kinds()[codes].tobytes().decode("ascii"))
    return np.fromiter(map(len, words), np.int64, len(words)), codes


def split_words(text: str) -> list[str]:
    """Words of a text in the vocabulary's sense."""
    if text.isascii():
        return _SPLIT.findall(text)
    end = np.cumsum(_sizes(text)[0]).tolist()
    return [text[a:b] for a, b in zip([0, *end], end)]


def word_sizes(text: str) -> np.ndarray:
    """Bytes of each word of a text."""
    size, codes = _sizes(text)
    if codes is None:
        return size
    upto = np.append(0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)))
    end = np.cumsum(size)
    return upto[end] - upto[end - size]


def pieces(text: str) -> Iterator[str]:
    """A long text cut where no word goes on."""
    low = 0
    while len(text) - low > PIECE:
        edge = _CUT.search(text, low + PIECE)
        if not edge:
            break
        yield text[low : edge.start()]
        low = edge.start()
    yield text[low:]


def frequent_words(docs: DataFrame, words: int = WORDS, text: str = "text") -> list[bytes]:
    """The most frequent words over all whole texts, at most `words`: all that occur as often as a bound."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for body in batch["text"]:
                for piece in pieces(body):
                    total.update(split_words(piece))
            found = [(w, n) for w, n in total.items() if len(w) <= LONGEST]
            yield pd.DataFrame({"word": pd.Series([w for w, _ in found], dtype=object), "n": [n for _, n in found]}, columns=["word", "n"]).astype({"n": "int64"})

    counted = docs.select(text_of(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted, "word-counts")
    # Sixteen classes to a doubling: their sizes tell from which number of occurrences on at most `words` words are left.
    steps = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r.step: r.size for r in counted.groupBy(steps.alias("step")).agg(F.count("*").alias("size")).collect()}
    bound, taken = None, 0
    for step in sorted(sizes, reverse=True):
        taken += sizes[step]
        if taken > words:
            break
        bound = step
    top = counted.filter(steps >= bound).select("word").collect() if bound is not None else []
    return sorted(w for r in top if len(w := r.word.encode()) <= LONGEST)


class Lexicon(NamedTuple):
    """Name of a packed file that every executor has."""

    file: str

    def coder(self) -> Coder:
        if self.file not in _coders:
            _coders.clear()
            _coders[self.file] = Coder(SparkFiles.get(self.file))
        return _coders[self.file]


_coders: dict[str, Coder] = {}


def build(docs: DataFrame, path: str, words: int = WORDS, text: str = "text") -> Lexicon:
    """Compile the frequent words of docs under the vocabulary at path, which the driver reads.

    Any choice of words gives the same ids; it decides how many words are merged anew.
    """
    spark = docs.sparkSession
    vocabulary = read_vocabulary(path)
    merger, chosen = Merger(vocabulary), frequent_words(docs, words, text)
    raw = pack(vocabulary, compile_words(chosen), merger.many(chosen))
    uri = scratch_dir(spark, "lexicon")
    store, place = fs.FileSystem.from_uri(uri)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(raw)
    spark.sparkContext.addFile(uri)
    return Lexicon(uri.rsplit("/", 1)[1])


def encode(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The documents, with all their columns, and an array column `tokens` more.

    Special tokens of the vocabulary are found in texts and get their ids.  Null and empty texts have
    no ids.  Rows are encoded one by one, whatever their ids; an empty table stays empty.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(lexicon.coder().encode(texts.tolist()), dtype=object)

    return docs.withColumn(free_name(docs, "tokens"), ids(text_of(text)))


def decode(rows: DataFrame, lexicon: Lexicon, tokens: str) -> DataFrame:
    """The rows and a string column `decoded` more: the text of the ids, empty for null."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        return pd.Series(lexicon.coder().decode([[] if x is None else x for x in ids]), dtype=object)

    return rows.withColumn(free_name(rows, "decoded"), texts(F.col(tokens)))

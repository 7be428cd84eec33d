"""Nearest texts by partial ratio inside the blocks of a task: numpy over the pairs of a few blocks at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KINDS, LEVELS = 37, 3  # kinds of letters, and how many of a kind are told apart: 111 of 128 bits
LETTERS = 64  # letters of a shorter text whose places fit one number
COMMON = 255  # most frequent letters whose places are tabled; rarer ones are looked for
PAIRS = 1 << 16  # pairs handled together
GRAMS = 256  # kinds of two neighbouring letters
ONE = np.uint64(1)


def letter_bits(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Two columns of 64 bits: bit (kind, level) is set if a text has more than ``level`` letters of the kind."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(rows * KINDS + points % KINDS, minlength=len(lengths) * KINDS).reshape(-1, KINDS)
    bits = np.zeros((len(lengths), 128), dtype=np.uint8)
    bits[:, : KINDS * LEVELS] = (counts[:, :, None] > np.arange(LEVELS)).reshape(len(lengths), -1)
    return np.packbits(bits, axis=1).view(np.uint64)


def gram_bits(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Four columns of 64 bits: the bit of a kind is set if a text has two neighbouring letters of the kind."""
    kinds = (points[:-1].astype(np.int64) * 31 + points[1:] * 7) % (GRAMS - 5)
    counts = np.maximum(lengths - 1, 0)
    bits = np.zeros((len(lengths), GRAMS), dtype=np.uint8)
    bits[np.repeat(np.arange(len(lengths)), counts), kinds[ranges(starts, counts)]] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range behind the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def best_edits(short: str, long: str, most: int) -> int:
    """Fewest edits from ``short`` to any stretch of its length in ``long``, or more than ``most``.

    The states of a column are bits of one number, of any size, as in ``Texts.edits``.
    """
    places: dict[str, int] = {}
    for i, letter in enumerate(short):
        places[letter] = places.get(letter, 0) | 1 << i
    size = len(short)
    full, top = (1 << size) - 1, 1 << size >> 1

    def edits(stretch: str, anywhere: bool) -> int:
        up, down, value = full, 0, size
        least = value
        for letter in stretch:
            same = places.get(letter, 0)
            across = (((same & up) + up) ^ up) | same
            grow, fall = (down | ~(across | up)) & full, up & across
            value += bool(grow & top) - bool(fall & top)
            least = min(least, value)
            grow, same = (grow << 1 | (not anywhere)) & full, same | down
            up, down = (fall << 1 | ~(same | grow)) & full, grow & same
        return least if anywhere else value

    if len(long) > size and edits(long, True) > most:
        return most + 1
    return min(edits(long[i : i + size], False) for i in range(len(long) - size + 1))


class Texts:
    """Texts as flat letters, most frequent ones numbered first from 1, with the places of each letter in each text."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bits = np.ascontiguousarray(letter_bits(points, self.lengths).T)
        self.grams = np.ascontiguousarray(gram_bits(points, self.starts, self.lengths).T)
        often = np.bincount(points)
        kinds = np.flatnonzero(often)
        number = np.zeros(len(often), dtype=np.int64)
        number[kinds[np.argsort(-often[kinds], kind="stable")]] = np.arange(1, len(kinds) + 1)
        self.letters = number[points]
        self.width, self.rare = min(len(kinds), COMMON) + 1, len(kinds) > COMMON
        self.places = np.zeros((len(texts), self.width), dtype=np.uint64)
        for i in range(min(self.lengths.max(initial=0), LETTERS)):
            rows = np.flatnonzero(self.lengths > i)
            letter = self.letters[self.starts[rows] + i]
            tabled = letter < self.width
            self.places[rows[tabled], letter[tabled]] |= ONE << np.uint64(i)
        self.places = self.places.ravel()

    def _same(self, rows: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Bits of the places that hold the letter, for each row."""
        if not self.rare:
            return self.places[rows * self.width + letter]
        rare = np.flatnonzero(letter >= self.width)
        same = self.places[rows * self.width + np.where(letter < self.width, letter, 0)]
        if not len(rare):
            return same
        for i in range(min(self.lengths[rows[rare]].max(), LETTERS)):
            inside = rare[self.lengths[rows[rare]] > i]
            same[inside] |= (self.letters[self.starts[rows[inside]] + i] == letter[inside]).astype(np.uint64) << np.uint64(i)
        return same

    def edits(self, short: np.ndarray, long: np.ndarray, at: np.ndarray, steps: np.ndarray, anywhere: bool) -> np.ndarray:
        """Levenshtein edits from text ``short`` to the ``steps`` letters of ``long`` from ``at`` on, for many pairs.

        An empty ``short`` has no steps.  anywhere: to the nearest stretch of any length within these letters.  Columns of the table of edits are
        kept as bits that tell where it goes up or down (Myers), one step for each letter of the longer text.
        """
        order = np.argsort(-steps, kind="stable")
        rows, first, steps = short[order], self.starts[long[order]] + at[order], -steps[order]
        value = self.lengths[rows].copy()
        top = ONE << np.maximum(value - 1, 0).astype(np.uint64)
        least = value.copy()
        up, down = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), dtype=np.uint64)
        for j in range(-steps[0] if len(steps) else 0):
            n = np.searchsorted(steps, -j)  # pairs that have a letter left come first
            up, down, u = up[:n], down[:n], value[:n]
            same = self._same(rows[:n], self.letters[first[:n] + j])
            across = (((same & up) + up) ^ up) | same
            grow, fall = down | ~(across | up), up & across
            u += (grow & top[:n]) != 0
            u -= (fall & top[:n]) != 0
            grow <<= ONE
            if anywhere:
                np.minimum(least[:n], u, out=least[:n])
            else:
                grow |= ONE
            same |= down
            up, down = (fall << ONE) | ~(same | grow), grow & same
        out = np.empty(len(rows), dtype=np.int64)
        out[order] = least if anywhere else value
        return out


def _ratio(edits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return 100.0 * (1 - edits / np.maximum(size, 1))


def _lacking(bits: np.ndarray, ours: np.ndarray, theirs: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The most bits that a text lacks of the other, without as many as the other has letters more (``over``: ours)."""
    pairs = [(column[ours], column[theirs]) for column in bits]
    first = sum(np.bitwise_count(x & ~y) for x, y in pairs)
    second = sum(np.bitwise_count(y & ~x) for x, y in pairs)
    return np.maximum(first - np.maximum(over, 0), second + np.minimum(over, 0))


class Search:
    """Best known row for each asked row; rows are numbered in the order that decides ties."""

    def __init__(self, texts: Texts, score: float) -> None:
        self.texts, self.score = texts, score
        self.best = np.full(len(texts.texts), -1.0)
        self.row = np.full(len(texts.texts), -1)
        self.measured = 0

    def near(self, ours: np.ndarray, theirs: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs that their letters allow at most so many edits: rows of both and the edits they need at least."""
        t = self.texts
        # what lies beside the stretch of the longer text excuses as many of its letters, or pairs of neighbours
        over = t.lengths[ours] - t.lengths[theirs]
        kept = np.flatnonzero(_lacking(t.bits[:1], ours, theirs, over) <= np.minimum(most[ours], most[theirs]))  # half of the bits rule most out
        ours, theirs, over = ours[kept], theirs[kept], over[kept]
        # an edit changes two pairs of neighbours at most
        needed = np.maximum(_lacking(t.bits, ours, theirs, over), (_lacking(t.grams, ours, theirs, over) + 1) // 2)
        size = np.minimum(t.lengths[ours], t.lengths[theirs])
        kept = np.flatnonzero((needed <= np.minimum(most[ours], most[theirs])) & ((size > 0) | (over == 0)))  # an empty text has only empty ones
        return ours[kept].astype(np.int32), theirs[kept].astype(np.int32), needed[kept].astype(np.int32)

    def may_win(self, ours: np.ndarray, theirs: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        best = self.best[ours]
        return (ratio > best) | ((ratio == best) & (theirs < self.row[ours]))

    def measure(self, ours: np.ndarray, theirs: np.ndarray, needed: np.ndarray) -> None:
        """Count the edits of pairs that can still win and keep the winners."""
        t = self.texts
        short = np.where(t.lengths[ours] <= t.lengths[theirs], ours, theirs)
        long = ours + theirs - short
        size, over = t.lengths[short], t.lengths[long] - t.lengths[short]
        edits = needed.astype(np.int64)
        fits = size <= LETTERS
        # the nearest stretch of any length is no farther than that of the same length
        longer = np.flatnonzero(fits & (over > 0))
        edits[longer] = np.maximum(edits[longer], t.edits(short[longer], long[longer], np.zeros(len(longer), dtype=np.int64), t.lengths[long[longer]], True))
        ratio = _ratio(edits, size)
        kept = np.flatnonzero((ratio >= self.score) & self.may_win(ours, theirs, ratio))
        ours, theirs, short, long, size, over, fits = (c[kept] for c in (ours, theirs, short, long, size, over, fits))
        edits = np.empty(len(kept), dtype=np.int64)
        plain = np.flatnonzero(fits)
        done = 0
        while done < len(plain):  # stretches of so many pairs together
            some = plain[done : done + max(1, np.searchsorted(np.cumsum(over[plain[done:]] + 1), PAIRS, "right"))]
            counts = over[some] + 1
            at = ranges(np.zeros(len(some), dtype=np.int64), counts)
            each = [np.repeat(c[some], counts) for c in (short, long, size)]
            edits[some] = np.minimum.reduceat(t.edits(each[0], each[1], at, each[2], False), np.cumsum(counts) - counts)
            done += len(some)
        for i in np.flatnonzero(~fits):
            edits[i] = best_edits(t.texts[short[i]], t.texts[long[i]], int((1 - self.score / 100) * size[i] + 1e-9))
        self.measured += len(kept)
        ratio = _ratio(edits, size)
        won = np.flatnonzero((ratio >= self.score) & self.may_win(ours, theirs, ratio))
        won = won[np.lexsort((theirs[won], -ratio[won], ours[won]))]
        won = won[np.unique(ours[won], return_index=True)[1]]
        self.best[ours[won]], self.row[ours[won]] = ratio[won], theirs[won]

    def run(self, blocks: np.ndarray, known: np.ndarray, met: np.ndarray) -> None:
        """Compare asked with known rows of equal ``blocks``, ascending numbers; ``met`` have an equal text."""
        ours, theirs = np.flatnonzero(~known), np.flatnonzero(known)
        start, stop = (np.searchsorted(blocks[theirs], blocks[ours], side) for side in ("left", "right"))
        counts = stop - start
        most = np.where(met, 0, np.floor((1 - self.score / 100) * self.texts.lengths + 1e-9)).astype(np.int64)
        found, done, ends = [], 0, np.cumsum(counts)
        while done < len(ours):
            stop = max(done + 1, np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right"))
            some = slice(done, stop)
            found.append(self.near(np.repeat(ours[some], counts[some]), theirs[ranges(start[some], counts[some])], most))
            done = stop
        if not found:
            return
        left, right, needed = (np.concatenate(c) for c in zip(*found))
        # fewest needed edits first: most rows have their partner then, and the rest cannot win
        for edits in range(needed.max(initial=-1) + 1):
            turn = np.flatnonzero(needed == edits)
            for i in range(0, len(turn), PAIRS):
                part = turn[i : i + PAIRS]
                a, b = left[part].astype(np.int64), right[part].astype(np.int64)
                ratio = _ratio(needed[part], np.minimum(self.texts.lengths[a], self.texts.lengths[b]))
                open_ = self.may_win(a, b, ratio)
                self.measure(a[open_], b[open_], needed[part][open_])


def search(rows: pa.Table, score: float) -> Search:
    """Whole blocks, sorted by block and payload: (block, text, payload, known)."""
    found = Search(Texts(rows["text"].to_pylist()), score)
    blocks, names = (rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("block", "text"))
    known = rows["known"].to_numpy()
    keys = blocks.astype(np.int64) * len(blocks) + names
    found.run(blocks, known, ~known & np.isin(keys, keys[known]))
    return found


def nearest(batches: Iterator[pa.RecordBatch], score: float) -> Iterator[pa.RecordBatch]:
    """(block, text, payload, score) of asked rows with a partner; batches are sorted by block and payload."""

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        found = search(rows, score)
        ours = np.flatnonzero(found.row >= 0)
        asked, theirs = rows.select(["block", "text"]).take(ours), rows["payload"].take(found.row[ours])
        yield from asked.append_column("payload", theirs).append_column("score", pa.array(found.best[ours])).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch["block"][batch.num_rows - 1]
        same = pc.equal(batch["block"], last)
        whole = batch.num_rows - pc.sum(same).as_py()  # rows before the last block, which may go on
        if held and (whole or held[-1]["block"][held[-1].num_rows - 1] != last):
            yield from solved(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            held = []
        elif whole:
            yield from solved(pa.Table.from_batches([batch.slice(0, whole)]))
        held.append(batch.slice(whole))
    if held:
        yield from solved(pa.Table.from_batches(held))

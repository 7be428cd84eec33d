"""Exact n-gram Jaccard join as a grouped prefix join, with its connected components.

A document is the set of hashes of its word shingles.  Tokens of a set are ordered rare first,
by counters of fixed size over all documents; two sets that reach the threshold share a token
among the first n - ceil(threshold * n) + 1 of each.  Documents with equal sets are one class,
classes with equal prefix and size one group.  Groups that share a token are paired with the most
central group of the token's list first, members are expanded and verified, and what that links
is one component.  Then only pairs between different components are left; those that pass the
size, position and count filters are verified one by one.  No link between different texts is
lost, and no list is written out as pairs of one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import cut, free_name, text_of, tidy

SHINGLE = 3
COUNTERS = 19  # 2^19 counters order the tokens, at any input size
CELLS = 64  # tokens of a set counted by their last bits
BLOCK = 2048  # members of a token's list compared at once
ROUNDS = 1  # rounds against the centre of each list before the rest is compared
NODE = "doc long, n long, high long, low long, prefix long, cells binary, tokens array<long>, places array<int>, centre float"
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of several texts, sorted within each, and where each text begins."""
    joined = b"\n".join(texts).lower()  # of bytes: ASCII only
    first, _, words = repeats.word_hashes(joined)
    length = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.searchsorted(first, np.append(np.cumsum(length) - length, length.sum()))
    count = np.diff(begin)
    grams = words.copy()
    for k in range(1, shingle):
        whole = max(0, len(words) - k)
        grams[:whole] = repeats.mixed(grams[:whole]) + words[k:]
    grams = repeats.mixed(grams)
    text = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(words)) - begin[text]
    keep = place <= count[text] - shingle
    for t in np.flatnonzero((count > 0) & (count < shingle)).tolist():  # the whole text is one shingle
        value = np.uint64(count[t])
        for w in words[begin[t] : begin[t + 1]]:
            value = repeats.mixed(np.array([value * _ODD + w], np.uint64))[0]
        keep[begin[t]] = True
        grams[begin[t]] = value
    grams, text = grams[keep], text[keep]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[fresh], text[fresh]
    return grams, np.searchsorted(text, np.arange(len(texts) + 1))


def _groups(batches: Iterator[pd.DataFrame], shingle: int):
    for batch in batches:
        for ids, group in repeats.chunks(batch["doc"].tolist(), batch["text"].tolist()):
            yield ids, *shingle_sets(group, shingle)


def token_counters(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many documents hold a token, by hashed counter: 2^COUNTERS numbers, added up by Spark."""
    size = 1 << COUNTERS
    parts = 64

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for _, grams, _ in _groups(batches, shingle):
            np.add.at(total, (grams >> np.uint64(64 - COUNTERS)).astype(np.int64), 1)
        yield pd.DataFrame({"part": range(parts), "counts": [p.tobytes() for p in total.reshape(parts, -1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"].tolist(), batch["counts"]):
                total[part] = total.get(part, 0) + np.frombuffer(raw, np.int64)
        yield pd.DataFrame({"part": list(total), "counts": [c.tobytes() for c in total.values()]})

    rows = texts.mapInPandas(count, "part int, counts binary").repartition("part").mapInPandas(add, "part int, counts binary").collect()
    out = np.zeros((parts, size // parts), np.int64)
    for r in rows:
        out[r.part] += np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


class Ranked(NamedTuple):
    """Tokens of several sets, rare first within each."""

    tokens: np.ndarray
    often: np.ndarray
    owner: np.ndarray
    rank: np.ndarray
    prefix: np.ndarray  # flags of the tokens in their set's prefix


def _ranked(grams: np.ndarray, begin: np.ndarray, counters: np.ndarray, percent: int) -> Ranked:
    n = np.diff(begin)
    owner = np.repeat(np.arange(len(n)), n)
    often = counters[(grams >> np.uint64(64 - COUNTERS)).astype(np.int64)]
    # One key: the counter, then the hash; equal keys stay in hash order.
    key = (np.minimum(often, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | (grams & np.uint64((1 << 44) - 1))
    order = np.lexsort((key, owner))
    rank = np.arange(len(grams)) - begin[:-1][owner]
    return Ranked(grams[order], often[order], owner, rank, rank < prefix_length(n, percent)[owner])


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.append(np.zeros(1, values.dtype), np.cumsum(values))
    return total[begin[1:]] - total[begin[:-1]]


def _digests(values: np.ndarray, place: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    spread = repeats.mixed(values + np.uint64(salt)) * repeats.mixed((place.astype(np.uint64) + np.uint64(1)) * _ODD + np.uint64(salt))
    return repeats.mixed(_sums(spread, begin) + np.diff(begin).astype(np.uint64)).view(np.int64)


def nodes(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One row per document: its set's size and digest, and the prefix tokens that others have too."""
    share = texts.sparkSession.sparkContext.broadcast
    counters = share(token_counters(texts, shingle))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, grams, begin in _groups(batches, shingle):
            ranked = _ranked(grams, begin, counters.value, percent)
            yield pd.DataFrame({"name": ranked.tokens[ranked.prefix].view(np.int64)})

    shared = texts.mapInPandas(tidy(prefixes), "name long").groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    field = share(repeats.bit_field(shared, repeats.SCREEN_BITS))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, grams, begin in _groups(batches, shingle):
            ranked = _ranked(grams, begin, counters.value, percent)
            n, place = np.diff(begin), ranked.rank
            tokens, owner, rank = (v[ranked.prefix] for v in (ranked.tokens, ranked.owner, ranked.rank))
            edge = np.searchsorted(owner, np.arange(len(ids) + 1))
            hit = repeats.in_field(field.value, tokens, repeats.SCREEN_BITS)
            cut_at = np.searchsorted(owner[hit], np.arange(1, len(ids)))
            cells = np.bincount(ranked.owner * CELLS + (ranked.tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=len(ids) * CELLS)
            cells = np.minimum(cells, 65535).astype(np.uint16).reshape(-1, CELLS)
            yield pd.DataFrame(
                {
                    "doc": ids, "n": n, "high": _digests(grams, place, begin, 1), "low": _digests(grams, place, begin, 2), "prefix": _digests(tokens, rank, edge, 3),
                    "cells": [c.tobytes() for c in cells], "tokens": np.split(tokens[hit].view(np.int64), cut_at), "places": np.split(rank[hit].astype(np.int32), cut_at),
                    "centre": _sums(np.log1p(ranked.often), begin) / np.maximum(n, 1),
                }
            )

    return cut(texts.mapInPandas(tidy(rows), NODE), "jaccard-nodes")


def needed(a, b, percent: int):
    """Least common tokens of sets of these sizes: percent * (a + b) / (100 + percent), rounded up."""
    return -(-percent * (a + b) // (100 + percent))


def _fits(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may reach the threshold, by size, place in the prefix and counts per cell."""
    n, place, cells = rows["n"], rows["place"], rows["cells"]
    need = needed(n[i], n[j], percent)
    good = np.minimum(np.minimum(n[i], n[j]), np.minimum(n[i] - place[i], n[j] - place[j])) >= need
    good &= rows["comp"][i] != rows["comp"][j]
    at = np.flatnonzero(good)
    for part in np.array_split(at, len(at) // 8192 + 1):
        x, y = cells[i[part]], cells[j[part]]
        good[part] = (np.minimum(x, y).sum(axis=1) >= need[part]) | (x.max(axis=1) == 65535)
    return good


SHORT = 24  # lists of so many members are paired all at once


def _list_pairs(percent: int, once: bool):
    """Pairs within each token's list, or grid cell of a long list, that pass the filters.

    once: a member that already has a partner is not compared again with the rest of its list; every
    member with a partner is then in some pair, but not every pair is given.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in repeats.whole_groups(batches):
            frame = frame.sort_values(["name", "n"], kind="stable")
            name, side = frame["name"].to_numpy(), frame["side"].to_numpy()
            rows = {c: frame[c].to_numpy() for c in ("cls", "comp", "n", "place")}
            rows["cells"] = np.frombuffer(b"".join(frame["cells"]), np.uint16).reshape(-1, CELLS)
            begin = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            size = np.diff(np.append(begin, len(name)))
            out = []

            def add(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                good = _fits(rows, i, j, percent)
                a, b = rows["cls"][i[good]], rows["cls"][j[good]]
                out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                return good

            for length in range(2, SHORT + 1):
                lists = begin[size == length]
                x, y = np.triu_indices(length, 1)
                for some in np.array_split(lists, len(lists) * len(x) // 100_000 + 1):
                    i, j = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                    apart = (side[i] < 0) | (side[i] != side[j])
                    add(i[apart], j[apart])
            for a, length in zip(begin[size > SHORT].tolist(), size[size > SHORT].tolist()):
                n, sides = rows["n"][a : a + length], side[a : a + length]
                met = np.zeros(length, bool)
                for k in range(length):
                    if met[k]:
                        continue
                    low = 0 if once else k + 1
                    low, high = max(low, int(np.searchsorted(n, -(-n[k] * percent // 100)))), int(np.searchsorted(n, n[k] * 100 // percent + 1))
                    j = np.arange(low, high)
                    j = j[(j != k) & ((sides[k] < 0) | (sides[j] != sides[k]))]
                    good = add(np.full(len(j), a + k), a + j)
                    if once and good.any():
                        met[k] = True
                        met[j[good]] = True
            found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            yield pd.DataFrame(found, columns=["a", "b"]).drop_duplicates()

    return tidy(pairs)


def _fitting(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the filters by size and counts per cell.  classes: (cls, n, cells)."""
    both = pairs
    for side in "ab":
        both = both.join(classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("cells").alias(f"cells_{side}")), side)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            size = len(frame)
            rows = {"n": np.concatenate([frame["n_a"], frame["n_b"]]), "place": np.zeros(2 * size, np.int64), "comp": np.arange(2 * size)}
            rows["cells"] = np.frombuffer(b"".join([*frame["cells_a"], *frame["cells_b"]]), np.uint16).reshape(-1, CELLS)
            yield frame.loc[_fits(rows, np.arange(size), np.arange(size, 2 * size), percent), ["a", "b"]]

    return both.mapInPandas(check, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    mine = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    theirs = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(mine, "a").join(theirs, "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.loc[good, ["a", "b"]]

    return both.mapInPandas(check, "a long, b long")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(cls, comp): smallest class reachable by links, for classes with a link.

    Every round each class takes the smallest label around it and then its label's label; the
    number of rounds grows with the logarithm of the longest chain in practice, and it runs until
    nothing changes.
    """
    one_way = links.select("a", "b")
    if labels is not None:
        one_way = one_way.union(labels.filter("cls <> comp").select(F.col("cls").alias("a"), F.col("comp").alias("b")))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(one_way.select(F.inline(both)).distinct(), "jaccard-links")
    state = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "cls")
    while True:
        state = cut(state, "jaccard-labels")
        near = edges.join(state, edges["b"] == state["cls"]).groupBy("a").agg(F.min("comp").alias("_near"))
        jump = state.select(F.col("cls").alias("comp"), F.col("comp").alias("_up"))
        after = state.join(near, state["cls"] == near["a"]).join(jump, "comp", "left").select(
            "cls", F.col("comp").alias("_was"), F.least("comp", "_near", F.coalesce("_up", "comp")).alias("comp")
        )
        after = cut(after, "jaccard-labels")
        if after.filter("_was <> comp").isEmpty():
            return after.select("cls", "comp")
        state = after.select("cls", "comp")


def join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, percent: int = 90, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are compared without ASCII case.  A text of fewer words than a shingle is one shingle;
    without words, or null, it has none and links with nothing.  component_id is the smallest id
    reachable by links, the own id included.  Rows without an id link by their text, and the null
    id sorts last: such a component has no number unless it holds a numbered document.  Rows that
    share an id with equal texts are one document; ids are taken to be distinct otherwise.  Empty
    tables stay empty.
    """
    named = labelled(docs, text, id_col, shingle, percent, rounds)
    null_id = lambda c: F.when(F.col(c) <= repeats.NO_ID - repeats.UNNAMED, F.col(c))
    return named.select(null_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), null_id("comp").alias("component_id"))


def first_of_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, percent: int = 90) -> DataFrame:
    """The documents, with their columns, whose number is their component's; of equal rows one."""
    kept = labelled(docs, text, id_col, shingle, percent).filter("doc = comp").select(F.col("doc").alias(key := free_name(docs, "_key"))).distinct()
    return docs.withColumn(key, repeats.numbered(text, id_col)).join(kept, key, "left_semi").dropDuplicates([key, text]).drop(key)


def labelled(docs: DataFrame, text: str, id_col: str, shingle: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """(doc, n, comp) of every row; see join.  Rows without an id are numbered by their text."""
    texts = docs.select(repeats.numbered(text, id_col).alias("doc"), text_of(text).alias("text"))
    found = nodes(texts, shingle, percent)
    key = ["high", "low", "n"]
    classes = cut(
        found.filter("n > 0").groupBy(*key).agg(F.min(F.struct("doc", "prefix", "cells", "tokens", "places", "centre")).alias("r")).select(*key, F.col("r.doc").alias("cls"), "r.prefix", "r.cells", "r.tokens", "r.places", "r.centre"),
        "jaccard-classes",
    )
    # Groups of equal prefix and size meet in the lists; a group of several classes passes the count filter unseen.
    grouped = classes.groupBy("prefix", "n").agg(F.min(F.struct("cls", "cells", "tokens", "places")).alias("g"), F.count("*").alias("m"))
    cells = F.when(F.col("m") == 1, F.col("g.cells")).otherwise(F.lit(bytearray(b"\xff" * 2 * CELLS)))
    groups = cut(grouped.select("prefix", "n", "m", F.col("g.cls").alias("cls"), F.col("g.cls").alias("comp"), cells.alias("cells"), "g.tokens", "g.places"), "jaccard-groups")
    partners = repeats.by_name(_dealt(_lists(groups, "cells"), BLOCK)).mapInPandas(_list_pairs(percent, once=True), "a long, b long")
    met = partners.select(F.explode(F.array("a", "b")).alias("cls")).distinct().withColumn("_met", F.lit(True))
    wanted = groups.select("prefix", "n", "m", "cls").join(met, "cls", "left").filter("_met OR m > 1").select("prefix", "n", F.col("cls").alias("grp"))
    members = cut(classes.join(wanted, ["prefix", "n"]).drop("high", "low", "prefix"), "jaccard-members")

    # The wanted documents as a bit field of fixed size: texts are read where they lie, and a false hit is a set too many.
    wanted_field = texts.sparkSession.sparkContext.broadcast(repeats.bit_field(members.select(F.xxhash64("cls").alias("name")), repeats.SCREEN_BITS))

    def token_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chosen() -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[repeats.in_field(wanted_field.value, batch["hash"].to_numpy().view(np.uint64), repeats.SCREEN_BITS)]

        for ids, grams, begin in _groups(chosen(), shingle):
            yield pd.DataFrame({"doc": ids, "tokens": [grams[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]})

    hashed = texts.select("doc", "text", F.xxhash64("doc").alias("hash"))
    sets = cut(hashed.mapInPandas(tidy(token_sets), "doc long, tokens binary"), "jaccard-sets")
    filtered = members.select("cls", "n", "cells")
    labels = None
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100))
    for turn in range(rounds):
        state = _mixed_lists(_lists(_labelled(members, labels), "centre")).withColumn("band", band)
        ranked = state.groupBy("name", "band").agg(F.max(F.struct("centre", (-F.col("cls")).alias("cls"), "comp", "n", "place")).alias("c"))
        centre = ranked.select(
            "name", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), (-F.col("c.cls")).alias("centre_cls"),
            *[F.col(f"c.{c}").alias(f"centre_{c}") for c in ("comp", "n", "place")],
        )
        fits = F.least(F.col("n") - F.col("place"), F.col("centre_n") - F.col("centre_place")) * (100 + percent) >= (F.col("n") + F.col("centre_n")) * percent
        near = state.join(centre, ["name", "band"]).filter("comp <> centre_comp").filter(fits)
        pairs = near.select(F.least("cls", "centre_cls").alias("a"), F.greatest("cls", "centre_cls").alias("b"))
        if turn == 0:  # members of one group, with its first
            pairs = pairs.union(members.filter("cls <> grp").select(F.col("grp").alias("a"), F.col("cls").alias("b")))
        labels = components(_verify(_fitting(pairs.distinct(), filtered, percent), sets, percent), labels)
    rest = _dealt(_mixed_lists(_lists(_labelled(members, labels), "cells")), BLOCK)
    last = repeats.by_name(rest).mapInPandas(_list_pairs(percent, once=False), "a long, b long").distinct()
    labels = components(_verify(last, sets, percent), labels)
    linked = classes.select(*key, "cls").join(labels, "cls", "left").select(*key, F.coalesce("comp", "cls").alias("comp"))
    return found.select("doc", *key).join(linked, key, "left").select("doc", "n", F.coalesce("comp", "doc").alias("comp"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("cls"))
    return members.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _lists(members: DataFrame, *more: str) -> DataFrame:
    """One row per token and member: (name, cls, comp, n, place) and more."""
    rows = members.select("cls", "comp", "n", *more, F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    return rows.select("cls", "comp", "n", *more, F.col("t.tokens").alias("name"), F.col("t.places").alias("place"))


def _mixed_lists(lists: DataFrame) -> DataFrame:
    """Rows of the lists that still hold more than one component."""
    mixed = lists.groupBy("name").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low < _high").select("name")
    return lists.join(mixed, "name")


def _dealt(rest: DataFrame, block: int) -> DataFrame:
    """Long lists as a grid: block i meets block j >= i in a cell of its own.

    side -1: compare within, 0 and 1: compare the first side with the second.
    """
    # Only long lists are named here, so few that Spark usually broadcasts them.
    size = rest.groupBy("name").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks")).filter("_blocks > 1")
    rows = rest.join(cut(size, "jaccard-long-lists"), "name", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("_i", F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda j: F.struct(F.least("_i", j).alias("i"), F.greatest("_i", j).alias("j"), F.when(j == F.col("_i"), -1).when(F.col("_i") < j, 0).otherwise(1).alias("side")),
    )
    rows = rows.withColumn("_c", F.explode(cells))
    return rows.select(F.xxhash64("name", "_c.i", "_c.j").alias("name"), "cls", "comp", "n", "place", "cells", F.col("_c.side").alias("side"))

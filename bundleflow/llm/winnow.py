"""Benchmark decontamination by winnowing, in DataFrame functions only.

The fingerprint of a text is the smallest 5-gram hash of each window of 10 words.  A span of 10
words shared with a benchmark item has the same words in both, hence the same smallest hash, so
no shared span escapes the join of fingerprints.  Documents with a common fingerprint are looked
at again: windows that it stands for are compared word by word with the item windows, and the
hits that agree extend each other to the covered words.  Texts are matched by digest, so rows
keep their ids, and equal texts share one list of hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, text_of

WINDOW = 10
GRAM = 5
# Fixed value: what separates words once A-Z are lower case.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000  # benchmark fingerprints or windows are broadcast up to this counted size


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str) -> Column:
    return F.filter(F.split(ascii_lower(text_of(text)), BETWEEN_WORDS, -1), lambda w: w != "")


def _numbers(count: Column, make: Callable[[Column], Column], kind: str) -> Column:
    """[make(0), ..., make(count - 1)]"""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array().cast(f"array<{kind}>"))


def _grams(words: Column, k: int) -> Column:
    return _numbers(F.size(words) - (k - 1), lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]), "bigint")


def _marks(words: Column, then: Callable[[Column], Column]) -> Column:
    """then(smallest gram hash of every window)."""
    width = WINDOW - GRAM + 1
    return let(_grams(words, GRAM), lambda h: let(_numbers(F.size(h) - (width - 1), lambda s: F.array_min(F.slice(h, s + 1, width)), "bigint"), then))


def _fingerprints(text: str, short: list[int]) -> Column:
    def of(words: Column) -> Column:
        whole = [_grams(words, n) for n in short]
        return _marks(words, lambda m: F.array_distinct(F.concat(m, *whole) if whole else m))

    return let(words_of(text), of)


def item_windows(items: DataFrame, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """(words, items): every distinct window, with the ids, as sorted strings, of the items that hold it."""
    own = let(
        words_of(text),
        lambda w: F.when(F.size(w) >= WINDOW, _numbers(F.size(w) - (WINDOW - 1), lambda s: F.slice(w, s + 1, WINDOW), "array<string>")).when(F.size(w) > 0, F.array(w)),
    )
    return items.select(F.col(id_col).cast("string").alias("item"), F.explode(own).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def _sized(small: DataFrame) -> DataFrame:
    """Marked for broadcast if counted small; else Spark shuffles, and splits hot keys at run time."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents, with all their columns, and a struct column `leaks` more.

    leaks: n_words, n_hit (words inside an occurrence of an item window), items (sorted string ids
    of items with an occurring window), spans (sorted distinct start and length of occurrences).
    An item of fewer than 10 words is one window; an item or document without words, or null, has
    none.  Items without an id take part, but are not named.  Repeated rows are judged alike, and
    an empty table stays empty.
    """
    windows = item_windows(items, item_text, item_id)
    short = sorted(r.n for r in windows.filter(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect())
    marks = items.select(F.explode(_fingerprints(item_text, short)).alias("mark")).distinct()
    digest = F.md5(F.encode(text_of(text), "UTF-8"))
    probes = docs.select(digest.alias("_text"), F.explode(_fingerprints(text, short)).alias("mark"))
    met = probes.join(_sized(marks), "mark", "left_semi").groupBy("_text").agg(F.collect_set("mark").alias("_marks"))

    def occurrences(words: Column) -> Column:
        def of(marks_of_windows: Column, n: int) -> Column:
            at = F.filter(_numbers(F.size(marks_of_windows), lambda s: s, "int"), lambda s: F.array_contains("_marks", F.get(marks_of_windows, s)))
            return F.transform(at, lambda s: F.struct(s.alias("at"), F.slice(words, s + 1, n).alias("words")))

        def short_of(n: int) -> Column:
            return let(_grams(words, n), lambda g: of(g, n))

        return F.concat(_marks(words, lambda m: of(m, WINDOW)), *[short_of(n) for n in short])

    # Each distinct text with a common mark is looked at once.
    texts = docs.select(digest.alias("_text"), F.col(text).alias("_body")).join(met, "_text").groupBy("_text").agg(F.first("_body").alias("_body"), F.first("_marks").alias("_marks"))
    found = texts.select("_text", F.explode(let(words_of("_body"), occurrences)).alias("o")).select("_text", "o.at", "o.words")
    agreed = found.join(_sized(windows), "words")
    hits = agreed.groupBy("_text").agg(
        F.sort_array(F.collect_set(F.struct("at", F.size("words").alias("length")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    hits = hits.select("_text", F.struct(covered.cast("long").alias("n_hit"), "items", "spans").alias("_hits"))
    key, count, out = free_name(docs, "_key"), free_name(docs, "_n_words"), free_name(docs, "leaks")
    judged = docs.withColumn(key, digest).withColumn(count, F.size(words_of(text)).cast("long"))
    judged = judged.join(hits.withColumnRenamed("_text", key), key, "left")
    leaks = F.struct(
        F.col(count).alias("n_words"),
        F.coalesce("_hits.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_hits.items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("_hits.spans", F.array().cast("array<struct<at:int,length:int>>")).alias("spans"),
    )
    return judged.withColumn(out, leaks).select(*docs.columns, out)

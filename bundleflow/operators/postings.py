"""Containment look-ups on JSON columns through a posting table.

A JSON text is flattened to its leaves: (path, value), with ``[]`` for any place of an array.  What
contains a question holds all its leaves, so the rows on the list of its rarest leaf are the
candidates, and each is compared with the question as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

LEAF = "path string, value string"


def leaves(value: object, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, value as JSON) of every scalar below a value; empty objects and arrays have none."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from leaves(inner, f"{path}.{json.dumps(name, ensure_ascii=False)}")
    elif isinstance(value, list):
        for inner in value:
            yield from leaves(inner, path + "[]")
    else:
        number = isinstance(value, float) and value.is_integer() and abs(value) < 2**53
        yield path, json.dumps(int(value) if number else value, ensure_ascii=False)


def contains(whole: object, part: object) -> bool:
    """Is ``part`` contained: equal scalars, objects by name, and of arrays every item in some item?"""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(name in whole and contains(whole[name], inner) for name, inner in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(contains(w, inner) for w in whole) for inner in part)
    return type(whole) is type(part) and whole == part if isinstance(part, bool) or isinstance(whole, bool) else whole == part


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return []


def postings(texts: DataFrame, column: str) -> DataFrame:
    """(text, path, value): the distinct leaves of each distinct text; texts that are no JSON have none.

    Build it once, write it partitioned or sorted by path, and look up any number of questions.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(text, *leaf) for text in batch["text"] for leaf in set(leaves(_parsed(text)))]
            yield pd.DataFrame(rows, columns=["text", "path", "value"])

    distinct = texts.select(F.col(column).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    return distinct.mapInPandas(flatten, f"text string, {LEAF}")


def containing(listed: DataFrame, questions: DataFrame, column: str) -> DataFrame:
    """(question, text): for each distinct question the distinct texts that contain it.

    ``listed`` is a posting table.  A question without leaves would be contained nearly everywhere and
    is left out, as is one that is null or no JSON.
    """
    often = listed.groupBy("path", "value").agg(F.count("*").alias("n"))
    asked = postings(questions, column).withColumnRenamed("text", "question")
    # A leaf that no text has is the rarest of all: its question has no answer.
    rare = asked.join(often, ["path", "value"], "left").groupBy("question").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "path", "value")).alias("r"))
    keys = rare.select("question", "r.path", "r.value")
    met = listed.join(keys, ["path", "value"]).select("question", "text")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[contains(_parsed(t), _parsed(q)) for q, t in zip(batch["question"], batch["text"])]]

    return met.mapInPandas(check, "question string, text string")


def count_containing(rows: DataFrame, questions: DataFrame, column: str, key: str) -> DataFrame:
    """(key, n_rows): for each question row how many rows contain its JSON.

    Rows and questions are looked up by distinct text and weighed, so equal rows cost nothing more.
    """
    weights = rows.groupBy(F.col(column).cast("string").alias("text")).agg(F.count("*").alias("w"))
    listed = cut_lineage(postings(rows, column))
    totals = containing(listed, questions, column).join(weights, "text").groupBy("question").agg(F.sum("w").alias("n_rows"))
    asked = questions.select(key, F.col(column).cast("string").alias("question"))
    return asked.join(totals, "question", "left").select(key, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))

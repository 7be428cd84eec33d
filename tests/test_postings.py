"""JSON look-ups and medians against direct evaluation."""

import json
import random
import statistics

import pytest

from bundleflow.operators import postings as P
from bundleflow.operators.triage import median_in_band


def value(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.35:
        return {rng.choice(["a", "b", "c.d", "é"]): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if depth < 3 and kind < 0.5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([0, 1, 1.0, 2.5, True, False, None, "1", "x", ""])


def test_containment_equals_comparing_every_pair(spark):
    rng = random.Random(2)
    rows = [(i, json.dumps(value(rng))) for i in range(300)] + [(1000, None), (1001, "{broken"), (1002, "{}"), (1003, '{"a": 1}'), (1004, '{"a":1.0}')]
    asked = [r for r in rows if r[0] % 5 == 0] + [(2000, '{"a": "nowhere"}'), (1003, '{"a": 1}')]
    schema = "id long, j string"
    got = sorted(map(tuple, P.count_containing(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), "j", "id").collect()))
    parsed = [P._parsed(t) for _, t in rows if t is not None]
    want = []
    for i, t in asked:
        part = P._parsed(t)
        want.append((i, sum(P.contains(w, part) for w in parsed) if t is not None and any(True for _ in P.leaves(part)) else 0))
    assert got == sorted(want) and sum(n for _, n in want) > 200


@pytest.mark.parametrize("part,whole,expected", [
    ({"a": 1}, {"a": 1, "b": 2}, True), ({"a": [1]}, {"a": [2, 1]}, True), ({"a": [{"x": 1, "y": 2}]}, {"a": [{"x": 1}, {"y": 2}]}, False),
    ({"a": True}, {"a": 1}, False), ([1, 1], [1], True), ({"a": {}}, {"a": {"b": 1}}, True), ("x", ["x"], False),
])
def test_containment_of_one(part, whole, expected):
    assert P.contains(whole, part) is expected


def test_median_spreads_a_group(spark):
    rng = random.Random(3)
    rows = [("hot", round(rng.uniform(-8, 8), 2)) for _ in range(5001)] + [("even", float(v)) for v in (1, 2, 2, 4)] + [("pair", 1.0), ("pair", 4.0), ("out", 9.0), ("none", None), (None, 2.0), (None, 3.0)]
    rows += [("same", 1.5)] * 500
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r["median"] for r in median_in_band(df, "g", "v", 5.0).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for g in {g for g, _ in rows}:
        inside = [v for h, v in rows if h == g and v is not None and abs(v) <= 5.0]
        want[g] = statistics.median(inside) if inside else 0.0
    assert got == pytest.approx(want)
    assert median_in_band(df.limit(0), "g", "v", 5.0).count() == 0

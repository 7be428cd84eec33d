import numpy as np
import pytest

from bundleflow.llm import cube


def targets_by_resharing(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5000}, {"a": 1, "b": 1, "c": 1, "d": 1, None: 90}, {"a": 0, "b": 7}, {"x": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in cube.source_targets(df).collect()}
    assert got == pytest.approx(targets_by_resharing(sizes))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    pi, size = rng.random(500), rng.integers(1, 900, 500)
    after = cube.flight(pi, size, rng)
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert after.sum() == pytest.approx(pi.sum())
    assert (after * size).sum() == pytest.approx((pi * size).sum())


def test_inclusion_probabilities_hold():
    pi, size = np.array([0.2, 0.5, 0.7, 0.9, 0.3]), np.array([5, 1, 9, 4, 7])
    mean = np.mean([cube.flight(pi, size, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(mean - pi).max() < 0.04


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "a" if i % 3 else "b", "x") for i in range(900)]
    rows += [(900, None, None, "x"), (901, "", "c", "x"), (902, "one two", None, "x"), (None, "a b c", "a", "x"), (3, rows[3][1], "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    small = cube.mix(docs, block=64).toPandas()
    assert len(small) == len(rows)
    assert (small["taken"] <= 3 * small["size"]).all() and (small["taken"] >= 0).all()
    for _, part in small.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
    again = cube.mix(docs.repartition(5), block=64).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert again[key].sort_values(key).values.tolist().__repr__() == small[key].sort_values(key).values.tolist().__repr__()


def test_mix_empty(spark):
    assert cube.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

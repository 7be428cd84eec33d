"""Partial ratios inside blocks: numpy against scoring every pair."""

import random

import numpy as np
import pyarrow as pa
import pytest

from bundleflow.operators import match as M
from bundleflow.operators import partial as P


def edits(a, b, anywhere=False):
    """Levenshtein; with ``anywhere`` to the nearest stretch of b."""
    row = [0] * (len(b) + 1) if anywhere else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return min(row) if anywhere else row[-1]


def score(a, b):
    s, l = sorted((a, b), key=len)
    if not s:
        return 100.0 * (a == b)
    return 100.0 * (1 - min(edits(s, l[i : i + len(s)]) for i in range(len(l) - len(s) + 1)) / len(s))


def table(rows):
    """Rows (block, text, payload or None) as a task gets them."""
    rows = sorted(rows, key=lambda r: (r[0], -1 if r[2] is None else r[2]))
    block, text, payload = ([r[i] for r in rows] for i in range(3))
    return pa.table({"block": block, "text": text, "payload": pa.array(payload, pa.int64()), "known": [p is not None for p in payload]})


def texts(rng, n, letters):
    out = ["", "a"]
    while len(out) < n:
        base = list(rng.choice(out) if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.choice([3, 17, 63, 64, 65, 80]))))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(base))
            base[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 2))
        out.append("".join(base) + "".join(rng.choices(letters, k=rng.choice([0, 0, 9]))))
    return out


@pytest.mark.parametrize("least,common,pairs", [(85.0, 255, 1 << 16), (70.0, 3, 99), (100.0, 1, 1 << 16)])
def test_best_rows_of_blocks(monkeypatch, least, common, pairs):
    """Long texts, rare letters, blocks that go on in the next batch: the partners of brute force."""
    monkeypatch.setattr(P, "COMMON", common)
    monkeypatch.setattr(P, "PAIRS", pairs)
    rng = random.Random(int(least))
    pool = texts(rng, 80, "abcकख\U0001f600")
    asked = {(rng.choice("xxy"), t) for t in pool[::2]} | {("z", "alone")}
    known = {(rng.choice("xxy"), t): k for k, t in enumerate(pool[1::2] + pool[4:20:2])}
    rows = [(*r, None) for r in asked] + [(*r, k) for r, k in known.items()] + [("w", "nobody", 1)]
    got = {}
    for batch in P.nearest(iter([pa.RecordBatch.from_pylist([], schema=table(rows).schema), *table(rows).to_batches(9)]), least):
        got |= {(r["block"], r["text"]): (r["payload"], r["score"]) for r in batch.to_pylist()}
    want = {}
    for block, text in asked:
        best = min(((-score(text, t), k) for (b, t), k in known.items() if b == block), default=(0, None))
        if -best[0] >= least:
            want[block, text] = (best[1], -best[0])
    assert got == want and len(want) > 10


def test_edits_of_many_pairs():
    rng = random.Random(8)
    pool = [t for t in texts(rng, 90, "abcd") if len(t) <= 64]
    t = P.Texts(pool)
    pairs = [(a, b) for a in range(len(pool)) if pool[a] for b in rng.sample(range(len(pool)), 4)]
    short, long = (np.array(side) for side in zip(*pairs))
    at = np.array([rng.randint(0, len(pool[b])) for b in long])
    steps = t.lengths[long] - at
    for anywhere in (False, True):
        assert list(t.edits(short, long, at, steps, anywhere)) == [edits(pool[a], pool[b][i:], anywhere) for a, b, i in zip(short, long, at)]
    for a, b in pairs:
        if len(pool[a]) <= len(pool[b]):
            best = round(len(pool[a]) * (1 - score(pool[a], pool[b]) / 100))
            assert P.best_edits(pool[a], pool[b], 99) == best and (P.best_edits(pool[a], pool[b], 2) > 2) == (best > 2)


def test_few_pairs_of_near_names_are_measured():
    """Names of one block that differ in a few digits all score: only pairs that can win are measured."""
    people = [("d", f"{123 + 15000 * i:09d} customer venkatasubramaniam", i) for i in range(300)]
    asked = [("d", t.replace("customer", "cust0mer"), None) for _, t, _ in people] + [("d", t.replace("customer venkata", "benkadha customer "), None) for _, t, _ in people]
    found = P.search(table(people + asked), 85.0)
    assert (found.best > 0).sum() == 300 and found.measured < 300 * 600 // 50


def test_payloads_of_any_type_and_too_many_rows(spark, monkeypatch):
    """Texts as payloads; blocks with too many rows are cut into parts, also those that one side lacks."""
    people = [("d", f"{i * 7919:09d} some name", f"p{i % 10}{i}") for i in range(40)] + [("e", "only known", "x")]
    asked = [("d", t.replace("some", "s0me")) for _, t, _ in people[:40]] + [("f", "only asked"), ("d", None), (None, "some")]
    theirs = spark.createDataFrame(people, "block string, text string, payload string")
    ours = spark.createDataFrame(asked, "block string, text string")
    got = {}
    for rows in (M.ROWS, 0):
        monkeypatch.setattr(M, "ROWS", rows)
        got[rows] = {(r.block, r.text): (r.payload, r.score) for r in M.best_partial_match(ours, theirs, 85.0).collect()}
    want = {}
    for block, text in asked[:40]:
        best = min((-score(text, t), p) for b, t, p in people if b == block)
        want[block, text] = (best[1], pytest.approx(-best[0]))
    assert got[0] == got[100_000] == want

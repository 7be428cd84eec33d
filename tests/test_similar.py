"""Joins by a similarity against scoring every pair."""

import random

import pytest

from bundleflow.operators import match as M
from bundleflow.operators.graph import co_mentioned_top


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def indel(a, b):
    return 100.0 if not a and not b else 100.0 * (1 - (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b)))


def partial(a, b):
    s, l = sorted((a, b), key=len)
    if not s:
        return 100.0 if not l else 0.0
    return max(100.0 * (1 - edits(s, l[i : i + len(s)]) / len(s)) for i in range(len(l) - len(s) + 1))


def texts(rng, n):
    out = ["", "a", "ab", "é" * 7]
    while len(out) < n:
        base = rng.choice(out) if rng.random() < 0.6 else "".join(rng.choices("abc", k=rng.randint(1, 30)))
        letters = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 2))
        out.append("".join(letters) + "".join(rng.choices("abc", k=rng.choice([0, 0, 9]))))
    return out


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 90))) for _ in range(2))
        assert M.lcs_length(a, b) == lcs(a, b)


@pytest.mark.parametrize("score", [100.0, 85.0, 70.0])
@pytest.mark.parametrize("name,measure", [("indel", indel), ("partial", partial)])
def test_every_pair_at_the_score_is_met(spark, name, measure, score):
    rng = random.Random(int(score))
    pool = texts(rng, 120)
    left = {(rng.choice("xxy"), t) for t in pool[::2]} | {("x", None), ("z", "alone")}
    right = [(rng.choice("xxy"), t, k) for k, t in enumerate(pool[1::2] + pool[4:40:2])] + [("x", None, 900), ("x", "abcabc", 901), ("x", "abcabc", 902), (None, "ab", 903)]
    ours = spark.createDataFrame(sorted(left, key=str), "block string, text string")
    theirs = spark.createDataFrame(right, "block string, text string, payload long")
    found = M.best_partial_match(ours, theirs, score) if name == "partial" else M.best_edit_match(ours, theirs, score, "indel")
    got = {(r.block, r.text): (r.payload, pytest.approx(r.score)) for r in found.collect()}
    want = {}
    for block, text in left:
        near = [(-measure(text, t), k) for b, t, k in right if b == block and t is not None and text is not None]
        near = [x for x in near if -x[0] >= score]
        if near:
            want[block, text] = (min(near)[1], -min(near)[0])
    assert got == want and len(want) > 10
    assert M.best_partial_match(ours.limit(0), theirs, score).count() == 0


@pytest.mark.parametrize("hub", [0, 2, 6, 1000])
def test_top_partners_do_not_depend_on_what_is_a_hub(spark, hub):
    rng = random.Random(4)
    rows = [(f"{d:03d}", rng.choice("ab"), str(min(rng.randint(0, 12), rng.randint(0, 12)))) for d in range(90) for _ in range(rng.randint(0, 5))]
    rows += [(f"{d:03d}", "date", "hot") for d in range(0, 90, 3)] + rows[:20] + [("007", None, "x"), (None, "a", "1"), ("lonely", "a", "nowhere")]
    seeds = [(f"{d:03d}",) for d in range(0, 90, 7)] + [("lonely",), ("absent",), (None,), ("007",)]
    got = co_mentioned_top(spark.createDataFrame(rows, "document_id string, type string, value string"), spark.createDataFrame(seeds, "document_id string"), 4, hub)
    having = {}
    for d, kind, value in rows:
        if None not in (d, kind, value):
            having.setdefault(d, set()).add((kind, value))
    want = []
    for (seed,) in set(seeds):
        near = [(-len(having[seed] & theirs), d) for d, theirs in having.items() if d != seed and having[seed] & theirs] if seed in having else []
        want += [(seed, d, -n, rank + 1) for rank, (n, d) in enumerate(sorted(near)[:4])]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30


def test_top_partners_of_empty_tables(spark):
    none = spark.createDataFrame([], "document_id string, type string, value string")
    assert co_mentioned_top(none, none.select("document_id")).count() == 0


def test_unknown_measures_are_refused(spark):
    rows = spark.createDataFrame([("a", "b", 1, 9)], "block string, text string, payload int, weight int")
    with pytest.raises(ValueError):
        M.best_edit_match(rows, rows, 85.0, "indel")
    with pytest.raises(KeyError):
        M.best_edit_match(rows, rows, 85.0, "other")
    with pytest.raises(ValueError):
        M.match_registry_names(rows, rows, "other")


def test_common_letters_of_many_pairs():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé\0") if rng.random() < 0.02 else rng.choice("abc") for _ in range(rng.choice([0, 1, 5, 30, 62, 63, 80])))
    pairs = [(word(), word()) for _ in range(400)] + [("", ""), ("a", ""), ("", "a")]
    a, b = [list(side) for side in zip(*pairs)]
    assert list(M.lcs_lengths(a, b)) == [M.lcs_length(x, y) for x, y in pairs]
    assert list(M.lcs_lengths([], [])) == []


def test_lookups_stay_few_for_equal_and_near_names(spark):
    """Long names of one length: equal ones are not cut into parts, and no other length is asked for."""
    people = spark.createDataFrame([("d", f"{i * 7919:09d} some longer name of it", i) for i in range(300)], "block string, text string, payload int")
    asked = people.select("block", "text").union(people.filter("payload % 10 = 0").selectExpr("block", "replace(text, 'some', 's0me') AS text"))
    for measure in ("edits", "indel"):
        got = {r.text: (r.payload, r.edits) for r in M.best_edit_match(asked, people, 85.0, measure).collect()}
        assert len(got) == 330 and all(got[r.text] == (r.payload, 0) for r in people.collect())
        assert got["000000000 s0me longer name of it"] == (0, {"edits": 1, "indel": 2}[measure])
    calls = []
    plain = M._at_score
    try:
        M._at_score = lambda left, *more: calls.append(left.count()) or plain(left, *more)
        M.best_edit_match(asked, people, 85.0, "indel").count()
    finally:
        M._at_score = plain
    assert calls == [30, 0]


@pytest.mark.parametrize("measure", ["partial", "edits", "indel"])
def test_blocks_compared_whole_or_by_parts(spark, monkeypatch, measure):
    """Blocks with one common beginning, compared whole and cut into parts: the same partners as brute force."""
    random.seed(5)
    names = [f"{i:09d} customer" + " venkatasubramaniam" * (i % 3 == 0) for i in range(0, 600, 15)]
    people = [("d", n, i) for i, n in enumerate(names)] + [("e", "क ख ग घ ङ च छ ज", 7), ("e", "", 8)]
    asked = {("d", n.replace("customer", random.choice(["customer", "cust0mer", "kustomr", "clistonner"]))) for n in names} | {("e", "क ख ग घ ङ ज छ ज"), ("e", "")}
    theirs = spark.createDataFrame(people, "block string, text string, payload int")
    ours = spark.createDataFrame(sorted(asked), "block string, text string")

    def score(a: str, b: str) -> float:
        if not a or not b:
            return 100.0 * (a == b)
        s, l = sorted((a, b), key=len)
        if measure == "partial":
            return max(100.0 * (1 - edits(s, l[i : i + len(s)]) / len(s)) for i in range(len(l) - len(s) + 1))
        if measure == "indel":
            return 100.0 * (1 - (len(a) + len(b) - 2 * M.lcs_length(a, b)) / (len(a) + len(b)))
        return 100.0 * (1 - edits(a, b) / len(l))

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for block, text in asked:
        best = min(((-score(text, t), p) for b, t, p in people if b == block), default=(0, None))
        if best[0] <= -85:
            want[block, text] = (best[1], round(-best[0], 9))
    for most in (M.WHOLE, 0):
        monkeypatch.setattr(M, "WHOLE", most)
        found = M.best_partial_match(ours, theirs, 85.0) if measure == "partial" else M.best_edit_match(ours, theirs, 85.0, measure)
        assert {(r.block, r.text): (r.payload, round(r.score, 9)) for r in found.collect()} == want

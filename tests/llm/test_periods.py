import random

import numpy as np
import pytest

from bundleflow.llm import periods


def brute(words):
    """All runs by comparing every pair of places a period apart."""
    n, out = len(words), []
    code = np.unique(words, return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], code[:-q] == code[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for i, j in zip(edges[::2], edges[1::2]):
            length = j + q - i
            root = words[i : i + q]
            shorter = any(q % p == 0 and root == root[:p] * (q // p) for p in range(1, q))
            if length >= max(6, 4 * q) and not shorter:
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def text(rng, longest):
    letters = rng.choice(["ab", "abc", "abcdefghij"])
    words = []
    while len(words) < longest:
        kind = rng.random()
        if kind < 0.4:
            words += [rng.choice(letters) for _ in range(rng.randint(1, 30))]
        else:
            root = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 16, 17, 31, 32, 40]))]
            times = rng.randint(2, 9)
            words += (root * times)[: len(root) * times - rng.randint(0, len(root) - 1)]
    return words[: rng.randint(0, longest)] if rng.random() < 0.3 else words


@pytest.mark.parametrize("size", [1 << 15, 256, 160])
def test_fragments_stitch_to_the_runs_of_brute_force(size):
    rng = random.Random(size)
    total = 0
    for _ in range(60):
        group = [text(rng, rng.choice([5, 40, 300, 900])) for _ in range(rng.randint(1, 4))]
        flat = periods.of_texts([" ".join(w).encode() for w in group], size)
        for words, f in zip(group, flat):
            got = [(a, b - a, q) for q, a, b in periods.merged([tuple(t) for t in f.reshape(-1, 3).tolist()]) if b - a >= max(6, 4 * q)]
            want = brute(words)
            total += len(want)
            assert sorted(got, key=lambda r: (r[0], r[2])) == want
    assert total > 300


def test_whole_operator_with_slices(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(text(rng, rng.choice([10, 200, 1200]))), "kept") for i in range(40)]
    rows += [(100, None, "n"), (101, "", "e"), (102, " \n\t", "s"), (None, "x " * 50, "id"), (3, rows[3][1], "twice"), (3, rows[3][1], "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periods string").repartition(5)
    for size in (1 << 15, 320):
        got = periods.find(docs, size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            words = (r.text or "").split()
            want = brute(words)
            assert [tuple(x) for x in r[-1].runs] == want
            assert r[-1].n_words == len(words) and r[-1].collapsed == collapsed(words, want)
    assert periods.find(docs.limit(0)).count() == 0


def test_long_runs_and_long_texts(spark):
    cases = ["a " * 30_000, " ".join(str(i % 3000) for i in range(40_000)), "é " + "b c " * 5000 + "d " * 3, "w" * 3_000_000 + " w"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.periods for r in periods.find(docs, size=4096).collect()}
    assert [[tuple(x) for x in got[i].runs] for i in range(4)] == [[(0, 30_000, 1)], [(0, 40_000, 3000)], [(1, 10_000, 2)], []]
    assert got[0].collapsed == "a" and got[1].n_words == 40_000 and got[3].collapsed == cases[3]


def test_z_values_by_definition():
    rng = np.random.default_rng(1)
    for n in range(0, 40):
        s = rng.integers(0, 2, n).tolist()
        assert periods.z_values(s) == [next((k for k in range(n - i) if s[k] != s[i + k]), n - i) for i in range(n)]

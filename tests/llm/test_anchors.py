import random

import pytest

from bundleflow.llm import anchors


def brute(docs, window):
    first = {}
    split = [(i, t.split()) for i, t in docs]
    for i, words in split:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, words in split:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%dé" % i for i in range(40)] + ["the", "of"]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [words(rng.randint(45, 130)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = words(rng.randint(0, 80))
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            parts += s[rng.randint(0, 20) :] + words(rng.choice([0, 3, 40]))
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    docs += [(n, "x " * 300), (n + 1, "y " * 49 + "x " * 90), (n + 2, "a b " * 100), (n + 3, " \n"), (n + 4, docs[3][1]), (n + 5, docs[3][1])]
    docs += [(n + 6 + i, f"head {i} " + " ".join(shared[0]) + f" tail {i}") for i in range(40)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,hot", [(3, 20_000), (3, 5), (4, 20_000)])
def test_same_as_brute_force(spark, seed, hot):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, None, 1), (5000, None, 1)], "doc_id long, text string, repeats int").repartition(4)
    got = {r.doc_id: r[-1] for r in anchors.dedup(df, hot=hot).collect()}
    want = brute(docs, 50)
    assert sum(w[1] for w in want.values()) > 1000
    assert {i: tuple(r) for i, r in got.items() if i is not None and i < 5000} == want
    assert tuple(got[None]) == tuple(got[5000]) == (0, 0, "")


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(5)
    text = " ".join(str(rng.randint(0, 99)) for _ in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.repeats.n_removed) for r in anchors.dedup(df).collect()) == [(1, 0), (1, 0), (2, 80)]
    assert anchors.dedup(df.limit(0)).count() == 0


def test_texts_without_an_id_are_judged_by_their_text(spark):
    rng = random.Random(6)
    a, b = (" ".join(str(rng.randint(0, 99)) for _ in range(80)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (None, b), (None, b), (None, a), (None, "head " + a)], "doc_id long, text string")
    got = sorted((r.text[:4], r.repeats.n_words, r.repeats.n_removed) for r in anchors.dedup(df).collect() if r.doc_id is None)
    assert got == sorted([(a[:4], 80, 80), (b[:4], 80, 0), (b[:4], 80, 0), ("head", 81, 80)])

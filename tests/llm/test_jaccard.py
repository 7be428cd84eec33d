import random

import pytest

from bundleflow.llm import jaccard


def sets_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def brute(docs, percent=90):
    sets = [(i, sets_of(t)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def corpus(seed, n=40, copies=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)] + ["the", "of"] * 40
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    docs = [(i, " ".join(words(rng.randint(0, 120)))) for i in range(n)]
    for size in (100, 150, 31, 10):
        base = words(size)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = words(rng.randint(0, 1))
            docs.append((len(docs), rng.choice([" ", "\n"]).join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    shared = words(90)
    docs += [(len(docs) + k, " ".join(words(4) + shared + words(4))) for k in range(50)]
    docs += [(len(docs) + k, t) for k, t in enumerate(["", " \n", "one", "ONE", "one two", "one  two", "two one"])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_same_as_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(9000, None, 1), (None, "lonely words stand here", 1), (None, None, 1)], "doc_id long, text string, n int").repartition(4)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.join(df).collect()}
    want = brute(docs)
    assert len(set(c for _, c in want.values())) < len(want) - 60
    assert {k: c for k, c in got.items() if k[0] is not None and k[0] < 9000} == {(i, n): c for i, (n, c) in want.items()}
    assert got[(9000, 0)] == 9000 and got[(None, 2)] is None and got[(None, 0)] is None


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (2, "A b c d"), (7, "x y z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.join(df).collect()) == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (7, 1, 7)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = corpus(7)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, docs[0][1], 1), (None, "all alone here", 1), (docs[3][0], docs[3][1], 1)], "doc_id long, text string, _key int")
    got = sorted((r.doc_id, r._key) for r in jaccard.first_of_groups(df).collect() if r.doc_id is not None)
    want = brute(docs)
    assert got == sorted((i, 1) for i, (_, c) in want.items() if c == i)
    assert [r.text for r in jaccard.first_of_groups(df).collect() if r.doc_id is None] == ["all alone here"]


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_chunk_of_one_short_text(spark, words):
    text = " ".join("abcd"[:words])
    df = spark.createDataFrame([(1, text), (2, text), (3, text + "x")], "doc_id long, text string").repartitionByRange(3, "doc_id")
    assert set(df.rdd.glom().map(len).collect()) == {1}
    assert sorted(tuple(r) for r in jaccard.join(df, shingle=5).collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 3)]
    assert sorted(r.doc_id for r in jaccard.first_of_groups(df, shingle=5).collect()) == [1, 3]

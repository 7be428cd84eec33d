import random

import numpy as np
import pytest

from bundleflow.llm import bwt


def brute(docs, window):
    """docs: (id, bytes) -> removed mask per row."""
    first = {}
    for doc, raw in docs:
        for s in range(len(raw) - window + 1):
            key = raw[s : s + window]
            first[key] = min(first.get(key, (doc, s)), (doc, s))
    out = []
    for doc, raw in docs:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - window + 1):
            if first[raw[s : s + window]] < (doc, s):
                gone[s : s + window] = True
        out.append(gone)
    return out


def corpus(seed, n=60, alphabet="abé \n"):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [text(rng.randint(90, 260)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [text(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, 40)
            parts += [s[a:], text(rng.choice([0, 3, 80]))]
        docs.append((i, "".join(parts)))
    docs += [(n, "x" * 700), (n + 1, "y" * 99 + "x" * 180), (n + 2, "ab" * 300), (n + 40_000, "".join(chr(97 + k) for k in range(26)) * 5), (n + 40_001, text(60) + "0123456789 line again\n" * 6 + text(60)), (n + 3, ""), (n + 4, docs[3][1]), (n + 5, docs[3][1])]
    docs += [(n + 6 + i, "head %d " % i + shared[0] + " tail %d" % i) for i in range(40)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot", [20_000, 5])
def test_same_as_brute_force(spark, hot):
    docs = corpus(3)
    rows = [(i, t, "clash") for i, t in docs] + [(None, None, "clash"), (2000, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string").repartition(4)
    got = {r.doc_id: r for r in bwt.dedup(df, hot=hot).collect()}
    raws = sorted((i, t.encode()) for i, t in docs)
    removed = 0
    for (i, raw), gone in zip(raws, brute(raws, 100)):
        r = got[i].repeats
        assert (r.n_bytes, r.n_removed) == (len(raw), gone.sum()), i
        assert bytes(r.kept) == np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert r.n_spans == (np.diff(np.append(0, gone.astype(int))) == 1).sum()
        removed += gone.sum()
    assert removed > 2000 and got[None].repeats.n_bytes == 0 and got[None].doc == "clash" and got[2000].repeats.n_removed == 0


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.repeats.n_removed) for r in bwt.dedup(df).collect()) == [(1, 0), (1, 0), (2, 300)]
    assert bwt.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_common_prefixes(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(12)] + [b"ab" * 30, b"a" * 40]
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    text_no = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    symbols = joined.astype(np.int16) + 1
    symbols[ends] = 0
    order = bwt.suffix_array(symbols, text_no, ends[text_no] - np.arange(len(joined)))
    key = lambda p: [(s, 0) if s else (0, t) for s, t in zip(symbols[p : ends[text_no[p]] + 1].tolist(), [text_no[p]] * 99)]
    assert order.tolist() == sorted(range(len(joined)), key=key)
    least = 10
    got = bwt.common_prefixes(symbols, order, least)
    for i in range(1, len(order)):
        a, b = key(order[i - 1]), key(order[i])
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[i] == (same if same < least else -1)


def test_texts_without_an_id_are_judged_by_their_text(spark):
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (None, b), (None, b), (None, a), (None, "x" + a)], "doc_id long, text string")
    got = sorted((r.text[:2], r.repeats.n_bytes, r.repeats.n_removed) for r in bwt.dedup(df).collect() if r.doc_id is None)
    assert got == sorted([(a[:2], 300, 300), (b[:2], 300, 0), (b[:2], 300, 0), ("x" + a[0], 301, 300)])

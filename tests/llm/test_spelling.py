import random
import zlib
from collections import Counter

import pytest

from bundleflow.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(count, times=10):
    out = {}
    for w, n in count.items():
        close = [v for v in count if near(w, v)]
        best = min(close, key=lambda v: (-count[v], v), default=None)
        form = best if best is not None and count[best] >= times * n else None
        out[w] = [form, w, n, len(close), count[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def vocabulary(seed, letters, shortest, n):
    rng = random.Random(seed)
    found = Counter()
    while len(found) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 2, 5]) + shortest))
        found[word] = rng.choice([1, 2, 3, 30, 30, 400, 5000])
        for _ in range(rng.randint(0, 4)):
            i, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:i] + ("" if kind == 0 else rng.choice(letters)) + word[i + (kind != 1) :]
            if len(word) < shortest:
                break
            found[word] = rng.choice([1, 2, 3, 30, 300])
    return found


@pytest.mark.parametrize("letters,shortest,hot,n", [("ab", 7, 1 << 14, 250), ("ab", 7, 20, 250), ("aé", 1, 50, 120), ("abcdefghijéß", 7, 1 << 14, 700), ("abcdefghijéß", 5, 10, 500)])
def test_same_as_all_pairs(spark, letters, shortest, hot, n):
    count = vocabulary(n + hot, letters, shortest, n)
    words = spark.createDataFrame([*count.items(), (None, 5), ("lonesome", None), ("", 9)], "word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(words, hot=hot).collect()}
    want = brute(count)
    assert got == want
    assert sum(v[3] for v in want.values()) > len(want) and any(v[0] and v[0] != v[1] for v in want.values())


def test_searched_index_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TABLE", 0)  # seen by the functions called here, not by workers
    import pandas as pd

    long = "xy" * 20_000
    words = sorted([long, long[:-1], long[:777] + "z" + long[778:], "z" + long, "short", "shirt"])
    rows = [(0, 0, len(w) // 2, w, 1, True, True) for w in words if len(w) == len(long)]
    frame = pd.DataFrame([(f"{len(long)}<x", *r) for r in rows], columns=["class", "part", "shift", "shared", "word", "n", "indexed", "asked"])
    frame["shared"] = 1
    got = spelling.near_in_classes(frame)
    assert dict(zip(got["word"], got["n_near"])) == {w: sum(near(w, v) for v in words if len(v) == len(long)) for w in frame["word"]}
    table = spark.createDataFrame([(w, 1 + i) for i, w in enumerate(words)], "word string, n long")
    assert {r.word: r.n_near for r in spelling.near_words(table).collect()} == {w: sum(near(w, v) for v in words) for w in words}


def test_words_of_texts(spark):
    body = "Apple-PIE ÉTÉ été applepie1Applepie\n" * 3
    rows = [(1, body, 0), (2, None, 0), (3, "", 0), (None, "Applepie", 0), (1, body, 0), (4, "ab " * 700_000, 0), (5, "q" * 3_000_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = {r.word: r.n for r in spelling.count_words(docs, shortest=2, least=2).collect()}
    assert got == {"apple": 6, "pie": 6, "ÉtÉ": 6, "été": 6, "applepie": 13, "ab": 700_000}
    change = spelling.misspelt(31)
    wrong = [(i, w) for i in range(400) for w in ("applepie", "orchards") if change(i, w) != w]
    assert 10 < len(wrong) < 50
    for i, w in wrong:
        at = zlib.crc32(f"{i}:{w}".encode()) % 8
        assert zlib.crc32(f"{i}:{w}".encode()) % 31 == 0 and change(i, w) == w[:at] + w[at + 1 :]
    assert spelling.group_variants(spelling.count_words(docs.limit(0))).count() == 0

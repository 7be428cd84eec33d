import random
import re

import pytest

from bundleflow.llm import winnow


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    table = {}
    for i, t in items:
        w = words(t)
        for win in [tuple(w[s : s + 10]) for s in range(len(w) - 9)] or ([tuple(w)] if w else []):
            table.setdefault(win, set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in table}:
            for s in range(len(w) - n + 1):
                got = table.get(tuple(w[s : s + n]))
                if got:
                    hit |= set(range(s, s + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(str(f) for f in found if f is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,bound", [(1, 200_000), (2, 0)])
def test_same_as_brute_force(spark, seed, bound, monkeypatch):
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", bound)
    rng = random.Random(seed)
    vocabulary = ["alpha", "Über", "x1", "the", "of", "été"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 4, 7, 10, 11, 30]))) for i in range(12)] + [(20, None), (21, ""), (22, "..."), (None, text(12)), (3, text(15))]
    docs = [(i, text(rng.randint(0, 30))) for i in range(60)]
    docs += [(100 + i, f"{text(9)}; {rng.choice(items[:12])[1].upper()} - {text(40)}") for i in range(40)]
    docs += [(200, None), (201, ""), (None, items[5][1]), (100, docs[60][1]), (202, (items[5][1] + " and ") * 300)]
    got = winnow.scan(
        spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, leaks int, _key int").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    rows = sorted(((r.doc_id, r.leaks_.n_words, r.leaks_.n_hit, list(r.leaks_["items"])) for r in got.collect()), key=repr)
    assert rows == brute(docs, items)
    assert got.columns == ["doc_id", "text", "leaks", "_key", "leaks_"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert winnow.scan(docs.limit(0), items).count() == 0
    assert [r.leaks.n_hit for r in winnow.scan(docs, items.limit(0)).collect()] == [0]
    assert [tuple(r.leaks.spans[0]) for r in winnow.scan(docs, items).collect()] == [(0, 2)]

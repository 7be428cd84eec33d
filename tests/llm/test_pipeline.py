import random

import numpy as np
import pytest

import corpus_pipeline
from bundleflow.llm import quality

from .test_bwt import brute as removed_bytes
from .test_winnow import brute as leaks


def shingles(text, k=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def survivors(docs):
    """Smallest id of each component of texts with a similarity of 0.8 and more."""
    up = {i: i for i, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingles(t)) for i, t in docs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i for i, _ in docs if top(i) == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, items = words(60), [(i, words(20)) for i in range(5)]
    rows = []
    for i in range(120):
        text = words(rng.randint(20, 80))
        if i % 6 == 1:
            text += " " + passage + " " + words(10)
        if i % 10 == 2:
            text += " " + items[i % 5][1]
        if i % 5 == 3:
            text = " ".join(w + "!!" for w in text.split())
        rows.append((i, text))
    for i in range(120, 160):
        near = rows[i % 12 * 4][1].split()
        near[rng.randrange(len(near))] = "changed"
        rows.append((i, " ".join(near)))
    rows += [(160, None), (161, ""), (None, words(30))]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 4}" if i != 7 else None, len(t or ""), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int("!!" not in t), 0) for i, t in rows[:120]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    given = {}
    for (name, stage), at in zip(corpus_pipeline.STAGES, range(5)):
        before = docs.collect()
        docs = stage(spark, docs, folder)
        path = f"{folder}/stage{at}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        given[name] = (before, docs.collect())
        if at < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    pairs = lambda rows: [(r.doc_id, r.text) for r in rows]

    before, after = given[names[0]]
    model = quality.fit(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long, extra string"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = [r for r in before if model.score([(r.text or "").encode()])[0] >= 0.7]
    assert sorted(pairs(after), key=repr) == sorted(pairs(good), key=repr)
    assert not any("!!" in (t or "") for _, t in pairs(after)) and len(after) > 100

    before, after = given[names[1]]
    numbered = [(i, t) for i, t in pairs(before) if i is not None]
    assert {i for i, _ in pairs(after) if i is not None} == survivors(numbered)
    assert len(after) < len(before)

    before, after = given[names[2]]
    raws = sorted(((i if i is not None else 1 << 62, (t or "").encode()) for i, t in pairs(before)))
    want = {i: np.frombuffer(raw, np.uint8)[~gone].tobytes().decode() for (i, raw), gone in zip(raws, removed_bytes(raws, 100))}
    assert {(i if i is not None else 1 << 62): t or "" for i, t in pairs(after)} == want
    assert sum(map(len, want.values())) < sum(len(r) for _, r in raws)
    assert all(r.n_chars == len(r.text or "") for r in after)

    before, after = given[names[3]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in leaks(pairs(before), items) if not hit}
    assert {i for i, _ in pairs(after)} == clean and len(after) < len(before)

    before, after = given[names[4]]
    assert len(after) == len(before)
    assert all(0 <= r.taken <= 3 * r.size for r in after)


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and got.count() > 50


def test_every_stage_on_no_documents(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0

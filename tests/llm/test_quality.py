import random
import zlib

import numpy as np
import pytest

from bundleflow.llm import quality


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "letter", "quiet", "über"]) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join(rng.choice(["buy!!", "$$$", "river!!", "stone$$"]) for _ in range(rng.randint(5, 60)))
    rows = [(i, bad() if i % 4 == 0 else good(), 9.0) for i in range(600)]
    extra = [(601, None, 9.0), (602, "", 9.0), (None, "river stone", 9.0), (3, rows[3][1], 9.0), (603, good() * 2000, 9.0), (604, bad() * 2000, 9.0)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, quality double").repartition(4)
    labels = [(i, int(i % 4 != 0), 0) for i in range(600)] + [(3, 1, 0), (None, 0, 0), (602, None, 0), (9999, 0, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(data):
    docs, labels = data
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        q = r.quality_
        assert q.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= q.score <= 1 and q.predicted == (q.score >= 0.7)
    rest = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.quality_.held_out]
    assert np.mean([r.quality_.predicted == (r.doc_id % 4 != 0) for r in rest]) > 0.97
    at = {r.doc_id: r.quality_.score for r in got}
    assert at[601] == at[602] and at[603] > 0.7 > at[604]


def test_same_model_whatever_the_partitions(data):
    docs, labels = data
    a, b = quality.fit(docs, labels, sample=100), quality.fit(docs.repartition(7), labels.repartition(3), sample=100)
    assert np.array_equal(a.folded, b.folded) and a.bias == b.bias


def test_folded_scores_are_the_mean_of_features():
    model = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BUCKET_BITS), 0.3)
    buckets, owner = quality.features([b"", b"ab cd", b"x"])
    assert owner.tolist().count(0) == 0 and owner.tolist().count(1) == 2 + 3 + 2 and owner.tolist().count(2) == 1
    want = [0.3, model.folded[buckets[owner == 1]].mean() + 0.3]
    assert model.score([b"", b"ab cd"]) == pytest.approx(1 / (1 + np.exp(-np.array(want))))


def test_no_rows_and_no_labels(data):
    docs, labels = data
    model = quality.fit(docs, labels.limit(0))
    assert {r.quality_.score for r in quality.classify(docs, model).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_pieces_of_a_long_text_give_its_features(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 64)
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 70, 500, 2000):
        raw = bytes(rng.choice(list(b"abc \n\xc3\xa9"), n).astype(np.uint8))
        whole = np.unique(quality.features([raw])[0], return_counts=True)
        at, times = quality.counted(raw)
        assert at.tolist() == whole[0].tolist() and times.tolist() == whole[1].tolist()
        model = quality.Model(rng.normal(size=1 << quality.BUCKET_BITS), 0.1)
        monkeypatch.setattr(quality, "PIECE", 1 << 30)
        want = model.score([raw, b"short"])
        monkeypatch.setattr(quality, "PIECE", 64)
        assert np.allclose(model.score([raw, b"short"]), want)


def test_a_very_long_text_is_scored(spark):
    docs = spark.createDataFrame([(1, "word other " * 1_900_000), (2, "x" * 3_000_000), (3, None)], "doc_id long, text string")
    model = quality.Model(np.zeros(1 << quality.BUCKET_BITS), 0.0)
    assert [r.quality.score for r in quality.classify(docs, model).collect()] == [0.5] * 3

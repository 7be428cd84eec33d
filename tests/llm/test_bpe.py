import os
import random

import numpy as np
import pytest

from bundleflow.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "Quality", "été", "don't", "we'll", "x's", "1234", "naïve", "日本語", "́", "🙂🙂", "　", "\x1c", "foo_bar", "C++", "ſt", "'s", "!!!"]
    out = []
    for _ in range(80):
        parts = [rng.choice(words) + rng.choice(["", " ", "  ", "\n", "\n\n ", "\t", " ", "\x85"]) for _ in range(rng.randint(0, 60))]
        out.append("".join(parts))
    out += ["", " ", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext", "a" * 700, "ab" * 900, "".join(rng.choice("abcdeé ") for _ in range(3000)), "".join(rng.choice("etaoins") for _ in range(5000))]
    return out + ["".join(chr(rng.choice([rng.randrange(0x20, 0x2FF), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(60)]


def test_words_are_the_librarys_for_every_code_point(library):
    split = library.pre_tokenizer
    for low in range(0, 0x110000, 1 << 14):
        codes = [c for c in range(low, low + (1 << 14)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}1 {chr(c)}b !{chr(c)} " for c in codes)
        spans = [b - a for _, (a, b) in split.pre_tokenize_str(text)]
        assert [len(w) for w in bpe.split_words(text)] == spans


@pytest.mark.parametrize("short", [256, 0, 4])
def test_merges_are_exact(library, monkeypatch, short):
    monkeypatch.setattr(bpe, "SHORT", short)
    merger = bpe.Merger(bpe.read_vocabulary(PATH))
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice(["a", "ab", "etaoinshr", "eé ", "=-", "0123456789"])
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 90)))
        words = sorted(set(bpe.split_words(word)))
        assert [x.tolist() for x in merger.many([w.encode() for w in words])] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert merger.many([]) == [] and merger.many([b""])[0].tolist() == []


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abc\xc3\xff\x00") for _ in range(rng.randint(1, 7))) for _ in range(3000)} | {b"walking", b"talking", b"walked", b"talked"})
    machine = bpe.compile_words(words)
    tails = {b"": frozenset(words)}
    for w in words:
        for k in range(1, len(w) + 1):
            tails.setdefault(w[:k], frozenset(v[k:] for v in words if v.startswith(w[:k])))
    assert len(machine.base) == len(set(tails.values()))  # one state for each set of endings
    asked = words + [w + b"a" for w in words[:50]] + [w[:-1] for w in words] + [b"zzz", b"x" * 100]
    size = np.array([len(w) for w in asked])
    got = machine.numbers(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size)
    place = {w: i for i, w in enumerate(words)}
    assert got.tolist() == [place.get(w, -1) for w in asked]
    assert bpe.compile_words([]).numbers(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


@pytest.mark.parametrize("words", [1 << 17, 20, 0])
def test_whole_operator_against_the_library(spark, library, words):
    bodies = texts(words)
    rows = [(i, t, "kept") for i, t in enumerate(bodies)] + [(None, "the Quality", "n"), (500, None, "n"), (3, bodies[3], "twice"), (3, bodies[3], "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(4)
    lexicon = bpe.build(docs, PATH, words)
    coded = bpe.encode(docs, lexicon)
    got = bpe.decode(coded, lexicon, coded.columns[-1]).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r[3]) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), bpe.build(docs.limit(0), PATH)).count() == 0


def test_very_long_texts_and_foreign_ids(spark, library):
    cases = ["a" * 300_000, "lorem ipsum dolor " * 100_000, "".join(random.Random(1).choice("etaoin") for _ in range(100_000)), "é" * 50_000]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    lexicon = bpe.build(docs, PATH)
    for r in bpe.encode(docs, lexicon).collect():
        assert list(r.tokens) == library.encode(cases[r.doc_id], add_special_tokens=False).ids
    odd = spark.createDataFrame([(1, [15496, -1, 99_999_999, 995]), (2, None), (3, [129])], "id long, tokens array<int>")
    assert {r.id: r.decoded for r in bpe.decode(odd, lexicon, "tokens").collect()} == {1: "Hello world", 2: "", 3: library.decode([129], skip_special_tokens=False)}

"""The queries without SQL, on the smallest driver tables, against plain Python."""

import hashlib
import zlib

import pytest

from bundleflow.llm import queries

from . import test_periods

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def test_op13_periodic_runs(spark, data_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_periodic_runs(spark, data_dir).collect()
    assert len(got) == len(rows)
    planted = 0
    for r in got:
        words = (rows[r.doc_id] or "").split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = test_periods.brute(words)
        planted += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r.collapsed_sha256 == sha(test_periods.collapsed(words, runs))
    assert planted > 5


def test_op11_bpe_transducer(spark, data_dir):
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_bpe_transducer(spark, data_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(decoded))

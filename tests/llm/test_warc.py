import hashlib

from pyarrow import fs

from bundleflow.llm import warc
from bundleflow.session import scratch_dir


def test_url_key():
    assert warc.url_key("http://www.Example.org:8080/a/b?q=1#top") == "org,example,www:8080)/a/b?q=1"
    assert warc.url_key("https://x.com") == "com,x)/" and warc.url_key(None) == "" and warc.url_key("not a\turl") == "not a url"
    assert warc.url_key("http://[bad") == "http://[bad"


def test_round_trip(spark):
    big, other = "<p>é</p>" * 300, "x" * 999
    rows = [(i, f"http://h{i % 3}.example.com/{i % 7}", big if i % 2 else other) for i in range(50)]
    rows += [(100, None, None), (101, "http://a.b/\nc", ""), (102, "http://h0.example.com/0", "y" * 1000), (103, "http://z", "y" * 1000), (None, "http://z", big), (7, rows[7][1], big)]
    pages = spark.createDataFrame([(i, u, h, "f") for i, u, h in rows], "page_id long, url string, html string, file string").repartition(4)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, -1), i)
    want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), best.get(h) if best.get(h) != i else None) for i, u, h in rows]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert (r.record_type == "revisit") == (r.refers_to is not None) == (r.payload is None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_lookup_reads_only_what_it_asks_for(spark):
    pages = spark.createDataFrame([(i, f"http://example.org/{i % 40:02d}", f"page {i}") for i in range(400)], "page_id long, url string, html string")
    folder = scratch_dir(spark, "warc-test")
    captures = warc.write_archives(warc.decide(pages), folder)
    index = warc.build_index(captures, block_lines=16)
    assert index.count() >= 400 // 16
    ask = spark.createDataFrame([("org,example)/07",), ("org,example)/nothing",)], "key string")
    hits = warc.find(index, ask)
    assert hits.count() == 10
    assert sorted(r.page_id for r in warc.read_records(hits, folder).collect()) == list(range(7, 400, 40))
    store, path = fs.FileSystem.from_uri(folder)
    assert all(f.base_name.endswith(".warc.gz") for f in store.get_file_info(fs.FileSelector(path)))

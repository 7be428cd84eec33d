import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from bundleflow.llm import tiff

SAMPLES = [b"", b"a", b"aaaa" * 100, b"abab" * 500, bytes(range(256)) * 40, b"x" * 129 + b"yz" + b"w" * 3, bytes(random.Random(1).randbytes(9000)), ("Das ist über " * 900).encode()]


@pytest.mark.parametrize("raw", SAMPLES)
def test_codecs_round_trip(raw):
    assert tiff.unpack_bits(tiff.pack_bits(raw)) == raw
    assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


def test_known_streams():
    # The PackBits example of the format's description, and an LZW stream written out by hand.
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    assert tiff.unpack_bits(packed).hex().upper() == "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(format(c, "09b") for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE])
@pytest.mark.parametrize("tiles", [False, True])
@pytest.mark.parametrize("predictor", [False, True])
def test_pages_round_trip(compression, tiles, predictor):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 255, shape, dtype=np.uint8) for shape in ((1, 576), (300, 200), (129, 1))]
    back = list(tiff.read_file(tiff.write_file(pages, tiff.Layout(compression, tiles, predictor))))
    assert all(np.array_equal(a, b) for a, b in zip(pages, back)) and len(back) == 3


def test_big_endian_and_broken_files():
    body = b"\1\2\3\4\5\6"
    fields = [(256, 3, 3), (257, 3, 2), (258, 3, 8), (259, 3, 1), (273, 4, 8), (278, 3, 2), (279, 4, 6)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields)
    raw = b"MM\0*" + struct.pack(">I", 14) + body + struct.pack(">H", len(fields)) + entries + b"\0\0\0\0"
    assert next(tiff.read_file(raw)).tolist() == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(ValueError):
        list(tiff.read_file(b"GIF89a  "))
    with pytest.raises(ValueError):  # a directory that names itself as the next
        list(tiff.read_file(raw[:-4] + struct.pack(">I", 14)))


def test_media_table(spark, monkeypatch):
    texts = [None, "", "x", "é" * 288, "é" * 289, "a b\n" * 4000, "long " * (tiff.ROW * tiff.PAGE_ROWS // 2), "x"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int").repartition(3)
    got = {r.doc_id: r for r in tiff.media_table(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, payload = got[i if i != 4 else None], tiff.payload_of(t or "")
        assert len(payload) % 576 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > 0 and len(r.feature) == 16
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    assert tiff.media_table(docs.limit(0)).count() == 0


def test_one_row_per_page(spark):
    media = spark.createDataFrame([(1, bytearray(tiff.write_file([np.zeros((2, 3), np.uint8), np.ones((1, 4), np.uint8)], tiff.LAYOUTS[0]))), (2, None)], "page long, media binary")
    got = tiff.pages(media).orderBy("page_").collect()
    assert [(r.page, r.page_, r.n_pages, r.width, r.height, bytes(r.samples)) for r in got] == [(1, 0, 2, 3, 2, b"\0" * 6), (1, 1, 2, 4, 1, b"\1" * 4)]

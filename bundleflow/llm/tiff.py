"""TIFF media columns: encode samples as baseline TIFF files, and read files as one row per page.

The reader walks the chain of image directories in either byte order, decodes strips or tiles
(stored plain, PackBits, LZW or deflate), undoes horizontal differencing, and crops tile padding.
One sample per pixel of eight bits, which is also what the writer makes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, free_name, text_of

# Field types, tags and compression numbers of the format.
FIELD = {1: "B", 3: "H", 4: "I"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

ROW = 576  # samples of a row; payloads are padded to whole rows
FILL = 255
PAGE_ROWS = 4096  # longer payloads continue on the next page
STRIP_ROWS = 128
TILE = (192, 64)


class Layout(NamedTuple):
    compression: int
    tiles: bool = False
    predictor: bool = False


# The layout of a payload follows from its checksum.
LAYOUTS = (
    Layout(LZW), Layout(PACKBITS), Layout(DEFLATE, tiles=True), Layout(DEFLATE, tiles=True, predictor=True),
    Layout(DEFLATE), Layout(DEFLATE, predictor=True), Layout(DEFLATE), Layout(DEFLATE),
)


def pack_bits(raw: bytes) -> bytes:
    data, out, n = np.frombuffer(raw, np.uint8), bytearray(), len(raw)
    edge = np.append(np.flatnonzero(np.diff(data)) + 1, n)
    start = np.append(0, edge[:-1])
    long_runs = np.flatnonzero(edge - start >= 3)
    at = 0
    for a, b in [*zip(start[long_runs].tolist(), edge[long_runs].tolist()), (n, n)]:
        for k in range(at, a, 128):
            part = raw[k : min(k + 128, a)]
            out.append(len(part) - 1)
            out += part
        for k in range(a, b, 128):
            size = min(128, b - k)
            out += bytes((257 - size if size > 1 else 0, raw[k]))
        at = b
    return bytes(out)


def unpack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


_CLEAR, _END, _FIRST, _LAST = 256, 257, 258, 4094


def lzw_encode(raw: bytes) -> bytes:
    codes, widths = [_CLEAR], [9]
    table: dict[tuple[int, int], int] = {}
    free, width, word = _FIRST, 9, -1
    for byte in raw:
        if word < 0:
            word = byte
            continue
        known = table.get((word, byte))
        if known is not None:
            word = known
            continue
        codes.append(word)
        widths.append(width)
        table[(word, byte)] = free
        free += 1
        if free > _LAST:
            codes.append(_CLEAR)
            widths.append(width)
            table, free, width = {}, _FIRST, 9
        elif free + 1 > 1 << width:  # the reader is one entry behind and widens early
            width += 1
        word = byte
    if word >= 0:
        codes.append(word)
        widths.append(width)
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    codes.append(_END)
    widths.append(width)
    code, bits = np.array(codes, np.int64), np.array(widths, np.int64)
    begin = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(code)), bits)
    step = np.arange(len(of)) - begin[of]
    return np.packbits((code[of] >> (bits[of] - 1 - step)) & 1).tobytes()


def lzw_decode(raw: bytes) -> bytes:
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, width, last = [], roots.copy(), 9, b""
    held, n = 0, 0
    for byte in raw:
        held = (held << 8) | byte
        n += 8
        if n < width:
            continue
        n -= width
        code = held >> n
        held &= (1 << n) - 1
        if code == _CLEAR:
            table, width, last = roots.copy(), 9, b""
            continue
        if code == _END:
            break
        if last:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        else:
            entry = table[code]
        out.append(entry)
        last = entry
    return b"".join(out)


def _compress(raw: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(raw)
    if compression == PACKBITS:
        return pack_bits(raw)
    return zlib.compress(raw, 1) if compression == DEFLATE else raw


def _expand(raw: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_decode(raw)
    if compression == PACKBITS:
        return unpack_bits(raw)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression != PLAIN:
        raise ValueError(f"compression {compression} is not supported")
    return raw


def _field(tag: int, values: list[int]) -> tuple[int, int, bytes]:
    kind = 4 if tag in (STRIP_OFFSETS, STRIP_BYTES, TILE_OFFSETS, TILE_BYTES, WIDTH, HEIGHT, ROWS_PER_STRIP) else 3
    return tag, kind, struct.pack(f"<{len(values)}{FIELD[kind]}", *values)


def write_file(pages: list[np.ndarray], layout: Layout) -> bytes:
    """A little-endian file with one directory per page (2-D arrays of eight-bit samples)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        if layout.tiles:
            across, down = TILE
            rows, cols = -(-height // down), -(-width // across)
            padded = np.zeros((rows * down, cols * across), np.uint8)
            padded[:height, :width] = page
            pieces = [padded[r * down : (r + 1) * down, c * across : (c + 1) * across] for r in range(rows) for c in range(cols)]
        else:
            pieces = [page[r : r + STRIP_ROWS] for r in range(0, height, STRIP_ROWS)]
        offsets, sizes = [], []
        for piece in pieces:
            if layout.predictor:
                piece = np.diff(piece, axis=1, prepend=np.uint8(0))
            raw = _compress(np.ascontiguousarray(piece).tobytes(), layout.compression)
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        fields = [_field(WIDTH, [width]), _field(HEIGHT, [height]), _field(BITS, [8]), _field(COMPRESSION, [layout.compression]), _field(PHOTOMETRIC, [1]), _field(SAMPLES, [1])]
        if layout.tiles:
            fields += [_field(TILE_WIDTH, [TILE[0]]), _field(TILE_HEIGHT, [TILE[1]]), _field(TILE_OFFSETS, offsets), _field(TILE_BYTES, sizes)]
        else:
            fields += [_field(STRIP_OFFSETS, offsets), _field(ROWS_PER_STRIP, [STRIP_ROWS]), _field(STRIP_BYTES, sizes)]
        if layout.predictor:
            fields.append(_field(PREDICTOR, [2]))
        entries = b""
        for tag, kind, value in sorted(fields):
            count = len(value) // struct.calcsize(FIELD[kind])
            if len(value) > 4:
                at = len(out)
                out += value + b"\0" * (len(value) % 2)
                value = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(raw: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", raw, 4), set()
    while at:
        if at in seen:
            raise ValueError("the directories run in a circle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", raw, at)
        found = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (place,) = struct.unpack_from(order + "I", raw, place)
                found[tag] = struct.unpack_from(form, raw, place)
        yield found
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)


def read_file(raw: bytes) -> Iterator[np.ndarray]:
    """The pages of a file, one 2-D array each."""
    for tags in _directories(raw):
        one = lambda tag, default=None: tags.get(tag, (default,))[0]
        if set(tags.get(BITS, (1,))) != {8} or one(SAMPLES, 1) != 1:
            raise ValueError("only one sample of eight bits per pixel is supported")
        width, height, compression = one(WIDTH), one(HEIGHT), one(COMPRESSION, PLAIN)
        tiled = TILE_OFFSETS in tags
        across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
        per_row = -(-width // across)
        page = np.zeros((-(-height // down) * down, per_row * across), np.uint8)
        for k, (at, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES])):
            top, left = k // per_row * down, k % per_row * across
            rows = down if tiled else min(down, height - top)
            piece = np.frombuffer(_expand(raw[at : at + size], compression), np.uint8)[: rows * across].reshape(rows, across)
            if one(PREDICTOR, 1) == 2:
                piece = np.cumsum(piece, axis=1, dtype=np.uint8)
            page[top : top + rows, left : left + across] = piece
        yield page[:height, :width]


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, bytes((FILL,)))


def encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes as samples of a TIFF file.

    Null text is empty, and an empty text is one row of fill.  Equal texts give equal files.  Rows
    stay rows, null and repeated ids included; an empty table gives an empty table.
    """

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch.columns[0]
            for group in np.array_split(batch, -(-len(batch) // 512) or 1):
                media = []
                for text in group["_text"]:
                    raw = payload_of(text)
                    rows = np.frombuffer(raw, np.uint8).reshape(-1, ROW)
                    pages = [rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)]
                    media.append(write_file(pages, layouts[zlib.crc32(raw) % len(layouts)]))
                yield pd.DataFrame({"doc_id": group[ids], "n_bytes": group["n_bytes"], "media": media})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("_text"))
    return source.mapInPandas(files, "doc_id long, n_bytes long, media binary")


PAGE = (("page", "int"), ("n_pages", "int"), ("width", "int"), ("height", "int"), ("samples", "binary"))


def pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of the files in `column`: the other columns, page, n_pages, width, height, samples.

    A column that df has already gets an underscore.  A null file has no pages; a file that is not TIFF, or uses an unknown compression, fails the job.
    """
    others = [c for c in media.columns if c != column]
    kept = media.select(*others, F.col(column).alias("_file")).filter(F.col("_file").isNotNull())
    names = [free_name(kept, name) for name, _ in PAGE]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_file").schema] + [f"`{n}` {kind}" for n, (_, kind) in zip(names, PAGE)])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group in np.array_split(batch, -(-len(batch) // 512) or 1):
                row, parts = [], []
                for k, raw in enumerate(group["_file"]):
                    found = list(read_file(raw))
                    row += [k] * len(found)
                    parts += [(i, len(found), p.shape[1], p.shape[0], p.tobytes()) for i, p in enumerate(found)]
                left = group[others].iloc[row].reset_index(drop=True)
                yield pd.concat([left, pd.DataFrame(parts, columns=names)], axis=1)

    return kept.mapInPandas(walk, schema)


@F.pandas_udf(StringType())
def light_pattern(samples: pd.Series) -> pd.Series:
    """64 equal stretches of samples, each brighter than the whole or not, as 16 hex digits."""

    def one(raw: bytes) -> str:
        data = np.frombuffer(raw, np.uint8)
        cut_at = np.arange(64) * len(data) // 64
        means = np.add.reduceat(data.astype(np.int64), cut_at) / np.diff(np.append(cut_at, len(data)))
        return np.packbits(means > data.mean()).tobytes().hex()

    return samples.map(one)


def media_table(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Texts as stored TIFF files, read back: payload and file digests per document.

    Files of several pages are put together by their row; their number is that of very long texts.
    """
    stored = cut(encode(docs, text, id_col), "tiff-media")
    named = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("media"))
    read = pages(named.withColumn("_row", F.monotonically_increasing_id()))
    facts = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    single = read.filter("n_pages = 1").select(*facts, F.col("samples").alias("payload"))
    several = read.filter("n_pages > 1").groupBy("_row", *facts).agg(F.sort_array(F.collect_list(F.struct("page", "samples"))).alias("p"))
    joined = several.select(*facts, F.expr("aggregate(transform(p, x -> x.samples), cast('' as binary), (a, b) -> concat(a, b))").alias("payload"))
    whole = single.unionByName(joined)
    return whole.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", light_pattern("payload").alias("feature"),
    )

"""WARC archives with a two-level capture index.

Pages become gzip members of WARC files; a payload that another page stores in full is written as
a revisit record.  The index sorts captures by reversed-host URL key into compressed blocks; a
sparse directory keeps the first and last key of each block.  A look-up searches the directory,
then the block, and only then reads the record's byte range.

Archive files are opened through pyarrow's file systems, by the URI of the shared folder.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundleflow.session import scratch_dir

from .common import cut, text_of

REVISIT_BYTES = 1000  # shorter payloads are always stored
FILE_BYTES = 64 << 20
BLOCK_LINES = 300
DATE = "1970-01-01T00:00:00Z"  # the tables carry no capture time
# Header names and profile of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, at long, size long"
BLOCK = "shard int, block int, first_key string, last_key string, lines binary"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: host labels reversed, scheme, user and fragment left out.

    What is not an absolute URL is its own key, and null has the empty key.  Tabs and line ends
    become spaces, as keys are lines of the index.
    """
    raw = re.sub(r"[\t\r\n]", " ", url or "")
    try:
        parts = urlsplit(raw)
        host, port = parts.hostname, parts.port
    except ValueError:
        return raw
    if not host:
        return raw
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _record(page_id, url, digest: bytes, payload: bytes, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _parse(member: bytes) -> tuple:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    number = lambda name: int(v) if (v := re.search(r":(-?\d*)>$", fields.get(name, ":>"))[1]) else None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if kind == "revisit":
        digest, payload = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), None
    else:
        digest = hashlib.sha1(payload).hexdigest()
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, number("WARC-Refers-To"), size, digest, payload


def decide(pages: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of 1000 bytes or more the largest id is stored."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(text_of(payload), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    kept = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("kept"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.join(kept, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write WARC files, several per task if they grow long, and return their captures.

    Each attempt of a task writes files of its own name; only those of the attempt whose captures
    were stored are ever read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        out, at, name = None, 0, ""
        for batch in batches:
            rows = []
            refers = batch["refers_to"].astype("Int64")
            for page, url, payload, digest, kept in zip(batch["page_id"].astype("Int64"), batch["url"], batch["payload"], batch["digest"], refers):
                page, kept = (None if v is pd.NA else int(v) for v in (page, kept))
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = _record(page, url, bytes.fromhex(digest), payload, kept)
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            frame = pd.DataFrame(rows, columns=["key", "page_id", "file", "at", "size"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return cut(records.mapInPandas(write, CAPTURE), "warc-captures")


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Compressed blocks of sorted capture lines.  Ranges over key and page id split even one hot key."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, held = TaskContext.get().partitionId(), 0, []

        def packed(lines: list[tuple[str, str]]) -> pd.DataFrame:
            raw = zlib.compress("\n".join(line for _, line in lines).encode("utf-8", "surrogatepass"))
            return pd.DataFrame([(shard, block, lines[0][0], lines[-1][0], raw)], columns=["shard", "block", "first_key", "last_key", "lines"])

        for batch in batches:
            for key, file, at, size in zip(batch["key"], batch["file"], batch["at"], batch["size"]):
                held.append((key, f"{key}\t{file}\t{at}\t{size}"))
                if len(held) == block_lines:
                    yield packed(held)
                    block, held = block + 1, []
        if held:
            yield packed(held)

    # Strings compare by code point here, as in the searches below.
    ordered = captures.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    return cut(ordered.mapInPandas(pack, BLOCK), "warc-index")


def find(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Captures (key, file, at, size) of the distinct keys in column `key`."""
    tops = sorted((r.low, r.high, r.shard) for r in index.groupBy("shard").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect())
    lows, highs, shards = ([t[i] for t in tops] for i in range(3))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(shards[i], key) for key in batch["key"] for i in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key))]
            yield pd.DataFrame(rows, columns=["shard", "key"])

    def search(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block", kind="stable")
        firsts, lasts, packed = (blocks[c].tolist() for c in ("first_key", "last_key", "lines"))
        rows, opened, lines, at_key = [], -1, [], []
        for key in sorted(set(wanted["key"])):
            for b in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                if b != opened:
                    opened, lines = b, [x.split("\t") for x in zlib.decompress(packed[b]).decode("utf-8", "surrogatepass").split("\n")]
                    at_key = [x[0] for x in lines]
                rows += [(key, x[1], int(x[2]), int(x[3])) for x in lines[bisect.bisect_left(at_key, key) : bisect.bisect_right(at_key, key)]]
        return pd.DataFrame(rows, columns=["key", "file", "at", "size"])

    placed = keys.select("key").distinct().mapInPandas(place, "shard int, key string")
    return placed.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(search, "key string, file string, at long, size long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures (file, at, size), by range reads in file order."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for file, at, size in zip(batch["file"], batch["at"], batch["size"]):
                if file != name:
                    name, source = file, store.open_input_file(f"{path}/{file}")
                rows.append(_parse(source.read_at(size, at)))
                held += rows[-1][4]
                if held > 16 << 20:
                    yield _frame(rows)
                    rows, held = [], 0
            yield _frame(rows)

    return captures.repartition("file").sortWithinPartitions("file", "at").mapInPandas(load, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def keys_of(pages: DataFrame, url: str = "url") -> DataFrame:
    make = F.pandas_udf(lambda urls: urls.map(url_key), "string")
    return pages.select(F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url")).distinct().select(make("_url").alias("key")).distinct()


def round_trip(pages: DataFrame, payload: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Archive all pages, look every URL up again, and read the records: columns as in RECORD.

    Null payloads are empty.  Of rows with one id and payload all are stored in full, where that
    id is the largest; a null id counts as the smallest.  Pages without a URL are found under the
    empty key.  Empty tables give no records.
    """
    folder = scratch_dir(pages.sparkSession, "warc-files")
    captures = write_archives(decide(pages, payload, id_col, url), folder)
    found = find(build_index(captures), keys_of(pages, url))
    return read_records(found, folder)

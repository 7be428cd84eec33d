"""Manifests and blobs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST

PIECE = 1 << 20  # bytes of an object read at once
FILE_CHARS = 4 << 20  # JSON documents that one file holds together


def scan_manifests(spark: SparkSession, glob: str, multi_line: bool = True) -> DataFrame:
    """Manifests under a glob such as ``…/documents/*/manifest.json``.

    ``multi_line`` reads one JSON document per file; turn it off for JSON-lines files, which
    Spark can split.  The file a row came from is kept in ``source_file``.
    """
    reader = spark.read.schema(MANIFEST).option("multiLine", multi_line)
    return reader.json(glob).select("*", F.col("_metadata.file_path").alias("source_file"))


def stream_manifests(spark: SparkSession, glob: str, multi_line: bool = True, files_per_trigger: int = 10_000) -> DataFrame:
    """Arriving manifests.  The manifest is written last, so its arrival marks a whole bundle."""
    return (
        spark.readStream.schema(MANIFEST).option("multiLine", multi_line)
        .option("maxFilesPerTrigger", files_per_trigger).json(glob)
    )


def write_manifests(manifests: DataFrame, path: str) -> None:
    """JSON lines, packed: half of a manifest is hexadecimal digests and repeated names.  A file per task, so none need be split."""
    manifests.write.mode("append").option("compression", "gzip").json(path)


def _arrays(documents: list[str], per_file: int | None, file_chars: int) -> Iterator[list[str]]:
    """Documents in order, cut before one that would pass ``file_chars``, or after ``per_file`` of them."""
    part, size = [], 0
    for document in documents:
        if part and (len(part) == per_file or size + len(document) > file_chars):
            yield part
            part, size = [], 0
        part.append(document)
        size += len(document)
    if part:
        yield part


def write_manifest_documents(manifests: DataFrame, path: str, per_file: int | None = None, file_chars: int = FILE_CHARS) -> None:
    """Manifests as JSON documents over many lines, a file for each array of up to ``file_chars`` characters of them.

    A stream of files tells the driver of each file, by a task of its own, so files are cut by size
    and not by a small count.  ``per_file`` sets a count besides; 1 writes a bare object per file, as a
    scanner leaves behind.
    """

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shown = [json.dumps(json.loads(row), indent=1, ensure_ascii=False) for row in batch["row"]]
            parts = list(_arrays(shown, per_file, file_chars))
            yield pd.DataFrame({"value": pd.Series([p[0] if per_file == 1 else "[" + ",\n".join(p) + "]" for p in parts], dtype=object)})

    rows = manifests.select(F.to_json(F.struct(*manifests.columns)).alias("row"))
    rows.mapInPandas(documents, "value string").write.mode("append").option("maxRecordsPerFile", 1).text(path)


BLOB = "path string, length long"


def blob_folders(spark: SparkSession, root: str, folders: int) -> DataFrame:
    """(folder): the folders of a store whose objects are dealt over that many by hashed name."""
    return spark.range(folders).select(F.concat(F.lit(f"{root.rstrip('/')}/"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("folder"))


def write_blobs(objects: DataFrame, root: str, folders: int, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row as an object of its own, in tasks; returns (path, length), as lazy as any DataFrame.

    An object written again by a retried task is the same object.  Null content is an empty object.
    """
    folder = F.lpad(F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(folders)).cast("string"), 5, "0")
    placed = objects.select(F.concat(F.lit(f"{root.rstrip('/')}/"), folder, F.lit("/"), F.col(name).cast("string")).alias("path"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for batch in batches:
            for uri, raw in zip(batch["path"], batch["content"]):
                store, path = fs.FileSystem.from_uri(uri)
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(path) as out:
                    out.write(raw)
            yield pd.DataFrame({"path": batch["path"], "length": [len(raw) for raw in batch["content"]]})

    return placed.mapInPandas(write, BLOB)


def list_blobs(folders: DataFrame, name_glob: str = "*") -> DataFrame:
    """(path, length) of the objects below each folder.

    Folders, one per row, are listed inside tasks, so the driver never holds the names of the objects;
    a folder that is not there has none.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["folder"]:
                store, path = fs.FileSystem.from_uri(uri)
                found = store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
                rows = [(uri + f.path[len(path) :], f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, name_glob)]
                yield pd.DataFrame(rows, columns=["path", "length"])

    return folders.select("folder").distinct().repartition("folder").mapInPandas(listed, BLOB)


def blob_digests(blobs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, length, content_id): SHA-256 of each object, read in ranges of ``piece`` bytes.

    No object is ever whole in memory.  Objects are dealt over tasks one by one, whatever folder they are in.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri, length in zip(batch["path"].tolist(), batch["length"].tolist()):
                store, path = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with store.open_input_file(path) as file:
                    for at in range(0, length, piece):
                        digest.update(file.read_at(min(piece, length - at), at))
                rows.append((uri, length, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "length", "content_id"])

    return blobs.select("path", "length").repartition("path").mapInPandas(digests, BLOB + ", content_id string")


def scan_blobs(spark: SparkSession, root: str, name_glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """Objects as (path, modificationTime, length, content).

    For stores of few objects: the driver lists them (see ``list_blobs`` for others).  ``content`` is
    read only where it is used.  ``max_bytes`` refuses larger objects instead of letting one fill an executor.
    """
    if max_bytes:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(max_bytes))
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", name_glob).option("recursiveFileLookup", "true").load(root)
    )

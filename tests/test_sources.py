"""Manifests as documents and blobs in folders."""

import hashlib

import pytest
from pyspark.sql import functions as F

from bundleflow.sources import manifests as M
from bundleflow.streaming.jobs import run_to_table


@pytest.mark.parametrize("per_file", [1, 7])
def test_one_json_document_per_file_as_a_stream(spark, tmp_path, per_file):
    rows = spark.range(30).select(
        F.concat(F.lit("d"), "id").alias("document_id"), F.when(F.col("id") % 3 > 0, F.lit('say "é"\n')).alias("document_category"),
        F.lit("2023-05-01 10:00:00").cast("timestamp").alias("preprocessed_at"),
        F.array(F.struct(F.col("id").cast("int").alias("page_num"), F.lit("k").alias("s3_key"))).alias("pages"),
    ).repartition(2)
    M.write_manifest_documents(rows, f"{tmp_path}/in", per_file)
    files = list((tmp_path / "in").glob("part-*"))
    assert len(files) == 30 if per_file == 1 else 5 <= len(files) <= 6
    assert all(f.read_text().count("\n") > 3 for f in files)
    run_to_table(M.stream_manifests(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.document_id, r.document_category, r.pages[0].page_num, r.preprocessed_at.hour) for r in got} == {(f"d{i}", 'say "é"\n' if i % 3 else None, i, 10) for i in range(30)}
    assert len(got) == 30 == M.scan_manifests(spark, f"{tmp_path}/in").count()


def test_blobs_are_listed_and_hashed_in_tasks(spark, tmp_path):
    bodies = {f"b{i}": bytes([i % 251]) * (i * 37) for i in range(60)} | {"empty": b"", "null": None}
    objects = spark.createDataFrame(list(bodies.items()), "name string, content binary")
    written = M.write_blobs(objects, f"{tmp_path}/store", 5).collect()
    assert len(written) == 62 and sum(r.length for r in written) == sum(len(b or b"") for b in bodies.values())
    assert len(list((tmp_path / "store").iterdir())) == 5
    (tmp_path / "store/00001/.hidden.tmp").write_bytes(b"x")
    folders = M.blob_folders(spark, f"{tmp_path}/store", 8)  # three of them are not there
    listed = M.list_blobs(folders, "[bne]*")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.content_id) for r in M.blob_digests(listed, piece=100).collect()}
    assert got == {n: (len(b or b""), hashlib.sha256(b or b"").hexdigest()) for n, b in bodies.items()}
    assert M.list_blobs(folders.limit(0)).count() == 0


def test_documents_are_cut_into_files_by_size(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").cast("string").alias("document_id"), F.lit("other").alias("document_category")).coalesce(1)
    M.write_manifest_documents(rows, f"{tmp_path}/whole")
    M.write_manifest_documents(rows, f"{tmp_path}/cut", file_chars=2000)
    assert len(list((tmp_path / "whole").glob("*.txt"))) == 1
    files = [f.read_text() for f in (tmp_path / "cut").glob("*.txt")]
    assert len(files) > 5 and all(len(f) <= 2200 for f in files)
    assert {r.document_id for r in M.scan_manifests(spark, f"{tmp_path}/cut").collect()} == {str(i) for i in range(300)}

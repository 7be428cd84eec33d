from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bundleflow.operators import merge as M
from bundleflow.operators import validate as V
from bundleflow.schemas import DOCUMENTS, PAGES
from bundleflow.sources.tables import put_if_absent, publish, read_latest, versions

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def docs(spark, *rows):
    base = dict.fromkeys(DOCUMENTS.fieldNames()) | {"document_category": "practitioner", "status": "received", "page_count": 1, "metadata": "{}"}
    return spark.createDataFrame([tuple((base | r)[n] for n in DOCUMENTS.fieldNames()) for r in rows], DOCUMENTS)


def pages(spark, *rows):
    out = []
    for r in rows:
        row = dict.fromkeys(PAGES.fieldNames()) | {"document_id": "d", "s3_key_image": "k", "ocr_status": "pending"} | r
        row["page_id"] = f"{row['document_id']}:{row['page_num']}"
        out.append(tuple(row[n] for n in PAGES.fieldNames()))
    return spark.createDataFrame(out, PAGES)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_upsert_twice_keeps_created_at(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    one = M.upsert_documents(empty, docs(spark, {"document_id": "a", "registration_no": "73510", "dob": date(1995, 2, 27)}), T1, "overwrite")
    two = M.upsert_documents(one, docs(spark, {"document_id": "a", "status": "processed"}), T2, "overwrite")
    row = two.first()
    assert (row["status"], row["registration_no"], row["created_at"], row["updated_at"]) == ("processed", None, T1, T2)
    again = M.upsert_documents(two, docs(spark, {"document_id": "a", "status": "processed"}), T2, "overwrite")
    assert again.exceptAll(two).count() == 0


def test_forward_only_never_steps_back(spark):
    stored = pages(spark, *[{"page_num": n, "ocr_status": s, "page_type": "form"} for n, s in enumerate(["pending", "queued", "done", "failed", "skipped"], 1)])
    for incoming, want in {"pending": ["pending", "queued", "done", "failed", "skipped"], "queued": ["queued", "queued", "done", "failed", "skipped"],
                           "done": ["done", "done", "done", "failed", "skipped"]}.items():
        changes = pages(spark, *[{"page_num": n, "ocr_status": incoming} for n in range(1, 6)])
        got = by(M.upsert_pages(stored, changes, T2), "page_num")
        assert [got[n]["ocr_status"] for n in range(1, 6)] == want
        assert got[1]["page_type"] == "form"  # null does not erase


def test_bulk_upsert(spark):
    five = pages(spark, *[{"page_num": n} for n in range(1, 6)])
    stored = M.bulk_upsert_pages(spark.createDataFrame([], PAGES), five, T1)
    again = pages(spark, *[{"page_num": n, "page_type": "app_cover" if n == 1 else "blank", "structured_json": "{}"} for n in range(1, 6)])
    got = by(M.bulk_upsert_pages(stored, again, T2), "page_num")
    assert len(got) == 5 and got[1]["page_type"] == "app_cover" and got[5]["page_type"] == "blank"
    with pytest.raises(Exception, match="duplicate"):
        M.bulk_upsert_pages(stored, five.union(five), T2).collect()


def test_partial_updates_keep_the_rest(spark):
    stored = pages(spark, {"page_num": 1})
    results = spark.createDataFrame([("d", 1, "text", 92.3, None)], "document_id string, page_num int, raw_text string, confidence_score float, language_detected string")
    one = M.update_ocr(stored, results, T1)
    shape = spark.createDataFrame([("d", 1, "form", '{"a":1}')], "document_id string, page_num int, page_type string, structured_json string")
    row = M.update_structured(one, shape, T2).first()
    assert (row["raw_text"], row["ocr_status"], row["page_type"], row["structured_json"]) == ("text", "done", "form", '{"a":1}')
    with pytest.raises(Exception, match="not found"):
        M.update_ocr(stored, results.withColumn("page_num", F.lit(9)), T1).select("width").collect()


def test_status_updates(spark):
    stored = docs(spark, {"document_id": "a", "updated_at": T1}, {"document_id": "b", "status": "processed", "updated_at": T1})
    moves = spark.createDataFrame([("a", "processed"), ("b", "processed")], "document_id string, status string")
    got = by(M.update_status(stored, moves, T2), "document_id")
    assert got["a"]["updated_at"] == T2 and got["b"]["updated_at"] == T1  # equal status is no change
    with pytest.raises(Exception, match="not found"):
        M.update_status(stored, moves.withColumn("document_id", F.lit("zz")).limit(1), T2).collect()
    with pytest.raises(Exception, match="invalid status"):
        M.update_status(stored, moves.withColumn("status", F.lit("bogus")), T2).collect()


def test_field_patch_whitelist(spark):
    stored = docs(spark, {"document_id": "a", "gender": "F"}, {"document_id": "b", "gender": "M"})
    patch = spark.createDataFrame([("a", None)], "document_id string, gender string")
    got = by(M.update_fields(stored, patch, T2), "document_id")
    assert got["a"]["gender"] is None and got["b"]["gender"] == "M"  # null is written, others untouched
    with pytest.raises(ValueError, match="page_count"):
        M.update_fields(stored, patch.withColumn("page_count", F.lit(1)), T2)
    assert M.update_fields(stored, patch.select("document_id"), T2) is stored


def test_refusals(spark):
    with pytest.raises(Exception, match="invalid document_category: bogus_category"):
        V.enforce(docs(spark, {"document_id": "a", "document_category": "bogus_category"})).collect()
    with pytest.raises(Exception, match="invalid confidence_score"):
        V.enforce(pages(spark, {"page_num": 1, "confidence_score": 150.0})).collect()
    good = pages(spark, {"page_num": 1, "confidence_score": 87.5, "ocr_status": "queued"})
    assert V.enforce(good).collect() == good.collect()
    assert V.enforce(docs(spark, {"document_id": "a", "match_status": None})).count() == 1
    empty = spark.createDataFrame([], PAGES)
    with pytest.raises(Exception, match="invalid ocr_status: lost"):
        M.upsert_pages(empty, pages(spark, {"page_num": 1, "ocr_status": "lost"}), T1).collect()
    with pytest.raises(Exception, match="invalid page_num: 0"):
        M.bulk_upsert_pages(empty, pages(spark, {"page_num": 0}), T1).collect()


def test_cascade_and_set_null(spark):
    d, p = docs(spark, {"document_id": "a", "reference_data_id": 1}, {"document_id": "b", "reference_data_id": 2}), pages(spark, {"document_id": "a", "page_num": 1})
    kept, left = M.cascade_delete(d, p, spark.createDataFrame([("a",)], "document_id string"))
    assert kept.count() == 1 and left.count() == 0
    cleared, registry = M.set_null_delete(d, spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(1,)], "id bigint"))
    assert {r["document_id"]: r["reference_data_id"] for r in cleared.collect()} == {"a": None, "b": 2} and registry.count() == 1


def test_last_write_wins_with_a_hot_key(spark):
    hot = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 20011).alias("seq"), F.col("id").alias("v"))
    got = M.last_write_wins(hot.repartition(7), ["k"], "seq")
    want = hot.filter("k = 0").orderBy(F.desc("seq")).first()
    assert got.filter("k = 0").first() == want and got.count() == hot.select("k").distinct().count()


def test_put_if_absent_twice(spark):
    new = spark.createDataFrame([("k1", bytearray(b"x")), ("k2", bytearray(b"y"))], "key string, body binary")
    table, outcome = put_if_absent(new, new.filter("key = 'none'"), "key")
    assert {r["uploaded"] for r in outcome.collect()} == {True}
    table2, outcome2 = put_if_absent(new, table, "key")
    assert {r["uploaded"] for r in outcome2.collect()} == {False} and table2.count() == 2


def test_versions(spark, tmp_path):
    root, schema = str(tmp_path / "t"), spark.range(1).schema
    assert read_latest(spark, root, schema).count() == 0
    publish(spark.range(3), root, 0)
    publish(read_latest(spark, root, schema).union(spark.range(2)), root, 1)
    publish(spark.range(7), root, 1)  # a repeated batch replaces its own version
    assert versions(spark, root) == [0, 1]
    assert read_latest(spark, root, schema).count() == 7 and read_latest(spark, root, schema, before=1).count() == 3


def test_repeated_keys_never_multiply_rows(spark):
    stored = docs(spark, {"document_id": "a"}, {"document_id": "b"})
    twice = spark.createDataFrame([("a", "processing", 1), ("a", "processed", 2), ("a", "processed", 2)], "document_id string, status string, n int")
    for change in (
        lambda t: M.update_status(t, twice, T2, seq="n"), lambda t: M.upsert_documents(t, twice, T2, seq="n"),
        lambda t: M.update_fields(t, twice, T2, seq="n"), lambda t: M.insert_if_absent(t, twice, ["document_id"], T2, seq="n"),
    ):
        table = stored
        for _ in range(3):
            table = change(table)
        assert sorted(r.document_id for r in table.collect()) == ["a", "b"]
    assert by(M.update_status(stored, twice, T2, seq="n"), "document_id")["a"]["status"] == "processed"
    with pytest.raises(Exception, match="duplicate key"):
        M.upsert_documents(stored, twice.drop("n"), T2).collect()
    same = twice.drop("n").filter("status = 'processed'")
    assert by(M.upsert_documents(stored, same, T2), "document_id")["a"]["status"] == "processed"
    new = spark.createDataFrame([("k", "x"), ("k", "x"), ("l", "y")], "key string, body string")
    table, outcome = put_if_absent(new, new.limit(0), "key")
    assert table.count() == 2 and sorted(map(tuple, outcome.collect())) == [("k", False), ("k", True), ("l", True)]


def test_vector_sink_shuffles_vectors_once(spark, data_dir):
    from bundleflow.suite.all import CASES, Tables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        physical = CASES["vector_sink"].build(Tables(spark, data_dir))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    merged = [line.strip(" :+-") for line in physical.split("FullOuter")[1].splitlines()]
    assert not any(line.startswith("Exchange") for line in merged[1:4])  # both sides lie by the key already

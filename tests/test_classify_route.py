from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bundleflow.operators import classify as K
from bundleflow.operators.merge import empty_tables
from bundleflow.operators.route import document_rows, route_pages
from bundleflow.operators.triage import detect_script, language_of_page
from bundleflow.operators.validate import check_manifest, manifest_checks, quarantine
from bundleflow.plans.ingest import ingest_manifests
from bundleflow.schemas import MANIFEST
from bundleflow.sources.manifests import scan_manifests
from bundleflow.sources.queue import page_work_queue, queue_envelope

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def bundle(doc="abc123", category="other", pages=((1, None), (2, None)), **more):
    row = dict.fromkeys(MANIFEST.fieldNames())
    row.update(
        schema_version=1, document_id=doc, original_s3_key=f"documents/{doc}/original.pdf", document_category=category, page_count=len(pages),
        pages=[dict.fromkeys(["width", "height", "sha256", "language_hint"]) | {"page_num": n, "s3_key": f"k{n}", "page_type": p} for n, p in pages],
    )
    row.update(more)
    return row


def manifests(spark, *rows):
    return spark.createDataFrame([tuple(r[n] if n != "pages" else [tuple(p[f.name] for f in MANIFEST["pages"].dataType.elementType.fields) for p in r["pages"]] for n in MANIFEST.fieldNames()) for r in rows], MANIFEST)


def classified(spark, rows):
    df = spark.createDataFrame(rows, "document_id string, document_category string, cover_text string")
    return {r["document_id"]: r for r in K.flatten_result(K.classify_documents(df)).collect()}


def test_decision_order(spark):
    out = classified(spark, [
        ("hint", "letter", "Receipt"), ("blank", "other", " \n\t"), ("null", "other", None), ("rules", "other", "State Bank of India Receipt"),
        ("weak", "other", "Registration number\nReceipt"), ("none", "other", "nothing here"), ("sticker", "other", "\nQR:I-96789"),
    ])
    assert (out["hint"]["document_category"], out["hint"]["method"], out["hint"]["confidence"]) == ("letter", "manifest_hint", 0.85)
    assert out["hint"]["signals"] == ["manifest.document_category='letter'"]
    for k in ("blank", "null", "none", "sticker"):
        assert (out[k]["document_category"], out[k]["confidence"], out[k]["signals"]) == ("other", 0.0, ["no_signals_matched"])
    assert out["rules"]["document_type"] == "sbi_challan" and out["rules"]["confidence"] > 0.55
    assert out["weak"]["signals"][-1] == "[llm_skipped]" and out["weak"]["match_reference_data"]


def test_fallback_only_sees_unsure_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def fallback(df):
        @F.udf("struct<document_category:string,document_type:string,confidence:double>")
        def ask(text):
            seen.add(1)
            return ("record", None, 0.6) if "mystery" in text else None

        return df.withColumn("fallback_result", ask("cover_text"))

    df = spark.createDataFrame(
        [("a", "other", "State Bank of India Receipt"), ("b", "other", "mystery"), ("c", "other", "Registration number\nReceipt"), ("d", "letter", "mystery")],
        "document_id string, document_category string, cover_text string",
    )
    out = {r["document_id"]: r for r in K.flatten_result(K.classify_documents(df, fallback=fallback)).collect()}
    assert seen.value == 2
    assert (out["b"]["document_category"], out["b"]["method"]) == ("record", "llm")
    assert out["c"]["signals"][-1] == "[llm_skipped]"  # no answer: the weak rules result stays
    assert out["a"]["method"] == "rules" and out["d"]["method"] == "manifest_hint"


PAGE_DDL = "document_id string, page_num int, s3_key string, page_type string, layer_text string, ocr_text string"


def test_cover_page_and_text(spark):
    pages = spark.createDataFrame(
        [("a", 1, "a1", "blank", "", "x"), ("a", 2, "a2", None, "short", "OCR OF TWO"), ("b", 2, "b2", "blank", "p2", "o2"), ("b", 1, "b1", "blank", "p1", "o1")]
        + [("c", n, f"c{n}", "form", f"text of page {n} and more", "ocr") for n in range(1, 6)],
        PAGE_DDL,
    )
    assert {r["document_id"]: r["s3_key"] for r in K.cover_page(pages).collect()} == {"a": "a2", "b": "b1", "c": "c1"}
    bundles = spark.createDataFrame([("a", "I-1 "), ("b", ""), ("c", None), ("none", "I-2")], "document_id string, qr_content string")
    got = {r["document_id"]: r["cover_text"] for r in K.cover_text(pages, bundles).collect()}
    assert got == {
        "a": "OCR OF TWO\nQR:I-1", "b": "o1", "none": "\nQR:I-2",
        "c": "text of page 1 and more\ntext of page 2 and more\ntext of page 3 and more",
    }


def test_routing(spark):
    pages = spark.createDataFrame(
        [("d", 1, "k1", "form"), ("d", 2, "k2", "blank"), ("d", 3, "k3", None), ("o", 1, "k1", "form")],
        "document_id string, page_num int, s3_key_image string, page_type string",
    )
    cls = spark.createDataFrame([("d", "practitioner"), ("o", "other")], "document_id string, document_category string")
    routed = route_pages(pages, cls)
    assert {(r["document_id"], r["page_num"]): r["ocr_status"] for r in routed.states.collect()} == {
        ("d", 1): "queued", ("d", 2): "skipped", ("d", 3): "queued", ("o", 1): "skipped"
    }
    assert {(r["page_num"], r["page_type"]) for r in routed.messages.collect()} == {(1, "form"), (3, "other")}
    fifo = queue_envelope(routed.messages).orderBy("dedup_id").first()
    assert (fifo["group_id"], fifo["dedup_id"]) == ("d", "d:1")
    assert page_work_queue(routed.messages).columns == ["key", "value"]


def test_ingest_and_rerun(spark):
    _, documents, pages = empty_tables(spark)
    batch = manifests(spark, bundle("p", "practitioner", ((1, "form"), (2, "blank"), (3, "form"))), bundle("x", "other"), bundle("e", "letter", ()))
    texts = spark.createDataFrame([("x", "")], "document_id string, cover_text string")
    one = ingest_manifests(batch, texts, documents, pages, T1)
    assert {(r["document_id"], r["page_num"]) for r in one.messages.collect()} == {("p", 1), ("p", 3)}
    docs = {r["document_id"]: r for r in one.documents.collect()}
    assert (docs["x"]["document_category"], docs["x"]["match_status"]) == ("other", "manual_review")
    assert (docs["p"]["match_status"], docs["p"]["page_count"], docs["p"]["original_filename"]) == ("pending", 3, "original.pdf")
    assert docs["e"]["page_count"] == 0

    two = ingest_manifests(batch.union(batch), texts, one.documents, one.pages, T1)
    assert two.messages.count() == 0  # nothing in flight is sent again
    assert two.documents.exceptAll(one.documents).count() == 0 and two.pages.exceptAll(one.pages).count() == 0

    done = one.pages.withColumn("ocr_status", F.when(F.col("page_id") == "p:1", "done").otherwise(F.col("ocr_status")))
    kept = {r["page_id"]: r["ocr_status"] for r in ingest_manifests(batch, texts, one.documents, done, T2).pages.collect()}
    assert kept["p:1"] == "done" and kept["p:2"] == "skipped"
    reset = {r["page_id"]: r["ocr_status"] for r in ingest_manifests(batch, texts, one.documents, done, T2, "overwrite").pages.collect()}
    assert reset["p:1"] == "queued"


def test_rerun_keeps_a_match(spark):
    _, documents, pages = empty_tables(spark)
    batch, texts = manifests(spark, bundle("p", "practitioner")), spark.createDataFrame([], "document_id string, cover_text string")
    one = ingest_manifests(batch, texts, documents, pages, T1)
    matched = one.documents.withColumn("match_status", F.lit("matched")).withColumn("reference_data_id", F.lit(9).cast("bigint"))
    row = ingest_manifests(batch, texts, matched, one.pages, T2).documents.first()
    assert (row["match_status"], row["reference_data_id"], row["created_at"]) == ("matched", 9, T1)


def test_either_manifest_form(spark):
    batch = manifests(spark, bundle("n", original_s3_key=None, s3_key_original="documents/n/scan.pdf", document_category=None))
    row = document_rows(batch).first()
    assert (row["original_filename"], row["document_category"]) == ("scan.pdf", "other")


def test_manifest_checks(spark):
    sha = "a" * 64
    page = [dict(page_num=1, s3_key="k", width=6, height=4, sha256=sha, page_type=None, language_hint=None)]
    good = bundle(sha, original_sha256=sha, page_count=1)
    good["pages"] = page
    bad = dict(good, document_id="short", page_count=0, schema_version=9, pages=[dict(page[0], page_num=0, width=0, sha256="x")])
    df = manifests(spark, good, bad)
    assert {r["violation"] for r in check_manifest(df).collect()} == {"document_id", "page_count", "schema_version", "page_num", "page_size", "page_sha256"}
    accepted, refused = quarantine(df, manifest_checks())
    assert (accepted.count(), refused.count()) == (1, 1)


def test_manifest_files(spark, tmp_path):
    for doc in ("d1", "d2"):
        folder = tmp_path / "documents" / doc
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text('{\n "document_id": "%s", "pages": [{"page_num": 1, "s3_key": "k", "extra": 5}], "unknown": {}\n}' % doc)
    rows = scan_manifests(spark, f"{tmp_path}/documents/*/manifest.json").collect()
    assert {r["document_id"] for r in rows} == {"d1", "d2"} and rows[0]["pages"][0]["page_num"] == 1
    assert all(r["source_file"].endswith("manifest.json") for r in rows)


def test_message_failure_leaves_tables_alone(spark, tmp_path):
    """Messages go first: when they cannot be written no table version appears."""
    from bundleflow.sources.manifests import stream_manifests, write_manifests
    from bundleflow.sources.tables import versions
    from bundleflow.streaming.jobs import stream_ingest

    write_manifests(manifests(spark, bundle("p", "practitioner")), f"{tmp_path}/in")
    root = tmp_path / "tables"
    root.mkdir()
    (root / "messages").write_text("a file where the folder should be")
    texts = spark.createDataFrame([], "document_id string, cover_text string")
    with pytest.raises(Exception):
        stream_ingest(stream_manifests(spark, f"{tmp_path}/in", multi_line=False), texts, str(root), T1).awaitTermination()
    assert versions(spark, f"{root}/pages") == []


def test_letters_of_a_page_are_counted_once(spark):
    rows = [("plain text",), ("कखग घ",), ("ab कख",), ("aaaa ककक aaaaaaa",), ("12 34",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    shown = df.select("t", language_of_page(F.upper("t"), F.when(F.col("t") == "", "mar")).alias("l"), detect_script(F.col("t")).alias("s"))
    assert [(r.l, r.s) for r in shown.collect()] == [
        ("eng", "latin"), ("dev", "devanagari"), ("mixed", "mixed"), ("mixed", "mixed"), ("unknown", "unknown"), ("mar", "unknown"), ("unknown", "unknown"),
    ]
    plan = df.select(language_of_page(F.upper("t"), F.lit(None).cast("string")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("IsLatin") == 1 and plan.count("upper(") == 1


def test_streamed_manifests_are_cut_and_read_once(spark, tmp_path):
    from bundleflow.plans.ingest import ingest_changes, latest_manifests

    sent = manifests(spark, bundle("p", "practitioner"), bundle("q", "letter"))
    assert "sha256" not in latest_manifests(sent).schema.simpleString()
    kept = []

    def store(batch):
        batch.write.parquet(f"{tmp_path}/batch")
        kept.append(spark.read.schema(batch.schema).parquet(f"{tmp_path}/batch"))
        return kept[-1]

    sent.write.json(f"{tmp_path}/in")
    arrived = spark.read.schema(MANIFEST).json(f"{tmp_path}/in")
    texts = spark.createDataFrame([], "document_id string, cover_text string")
    found = ingest_changes(arrived, texts, empty_tables(spark)[2], store_batch=store)
    assert kept[0].count() == 2 and found.pages.count() == 4
    for part in (found.documents, found.pages, found.messages):  # all read the stored batch
        assert "FileScan json" not in part._jdf.queryExecution().executedPlan().toString()

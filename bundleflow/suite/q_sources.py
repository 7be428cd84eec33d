"""Registered queries: scans, sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import page_id, page_key, surrogate_id
from ..operators.classify import classify_documents, flatten_result, with_qr
from ..operators.merge import merge_nodes, upsert
from ..operators.registry import clean_registry
from ..operators.route import route_pages
from ..schemas import REGISTRY
from ..session import scratch_dir
from ..sources.manifests import blob_digests, blob_folders, list_blobs, scan_manifests, stream_manifests, write_blobs, write_manifest_documents, write_manifests
from ..sources.queue import page_work_queue, queue_envelope
from ..sources.registry import registry_sink, scan_registry
from ..sources.tables import blob_exists, put_if_absent
from ..streaming.jobs import run_to_table
from .registry import Tables, case
from .rulesql import decided_cte

RUN_TS = datetime(2024, 1, 1)
OLD_TS = datetime(2020, 1, 1)
NEW, OLD = "'2024-01-01 00:00:00'", "'2020-01-01 00:00:00'"


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# pages each bundle's manifest lists: document number modulo 4 of them
MANIFEST_PAGES = """manifest_pages AS (
    SELECT document_id, cast(i AS bigint) AS page_num,
           'documents/' || document_id || '/pages/page_' || lpad(cast(i AS string), 3, '0') || '.png' AS s3_key,
           CASE (cast(document_id AS bigint) + i) % 4 WHEN 0 THEN 'blank' WHEN 1 THEN 'form' WHEN 2 THEN NULL ELSE 'certificate' END AS page_type
    FROM bundles JOIN (VALUES (1), (2), (3)) g(i) ON i <= cast(document_id AS bigint) % 4)"""


def manifests(t: Tables) -> DataFrame:
    """Nested manifests, built row by row from the bundles."""
    number = F.col("document_id").cast("bigint")
    count = F.pmod(number, F.lit(4)).cast("int")
    kind = lambda i: F.pmod(number + i, F.lit(4))
    page = lambda i: F.struct(
        i.alias("page_num"),
        page_key(F.col("document_id"), i).alias("s3_key"),
        (F.lit(600) + i).alias("width"),
        (F.lit(400) - F.when(F.pmod(number, F.lit(19)) == 0, 400).otherwise(0)).alias("height"),
        F.sha2(F.concat_ws("/", "document_id", i.cast("string")), 256).alias("sha256"),
        F.when(kind(i) == 0, "blank").when(kind(i) == 1, "form").when(kind(i) == 3, "certificate").alias("page_type"),
        F.lit(None).cast("string").alias("language_hint"),
    )
    empty = F.filter(F.transform(F.array(F.lit(1)), page), lambda _: F.lit(False))
    pages = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), page)).otherwise(empty)
    return t.wide("bundles").select(
        F.when(F.pmod(number, F.lit(23)) == 0, 2).otherwise(1).alias("schema_version"),
        "document_id", F.lit("original.pdf").alias("original_name"),
        F.sha2("document_id", 256).alias("original_sha256"),
        F.lit(None).cast("string").alias("s3_key_original"), "original_s3_key",
        "document_category", "qr_content", count.alias("page_count"), pages.alias("pages"),
        F.lit(datetime(2023, 5, 1)).alias("preprocessed_at"), F.lit(None).cast("string").alias("nas_host"),
        F.lit("1.0.0").alias("preprocess_version"),
    )


def flat_manifest(df: DataFrame) -> DataFrame:
    return df.select(
        "document_id", "document_category", F.col("page_count").cast("bigint").alias("page_count"),
        F.array_join(F.transform("pages", lambda p: p["s3_key"]), ",").alias("page_keys"),
    )


_FLAT_SQL = f"""WITH {MANIFEST_PAGES}
    SELECT b.document_id, b.document_category, count(p.page_num) AS page_count,
           coalesce(string_agg(p.s3_key, ',' ORDER BY p.page_num), '') AS page_keys
    FROM bundles b LEFT JOIN manifest_pages p ON b.document_id = p.document_id GROUP BY 1, 2"""


@case("scan_registry", """SELECT cast(c_custkey AS string) AS c_custkey, c_name, cast(c_nationkey AS string) AS c_nationkey,
    cast(c_acctbal AS string) AS c_acctbal, c_mktsegment FROM customer""")
def _(t):
    return scan_registry(t.spark, f"{t.sf_dir}/customer.parquet", "parquet")


@case("scan_manifests", _FLAT_SQL, "bundles")
def _(t):
    path = scratch_dir(t.spark, "manifests")
    write_manifests(manifests(t), path)
    return flat_manifest(scan_manifests(t.spark, path, multi_line=False))


@case("stream_manifests", _FLAT_SQL, "bundles")
def _(t):
    """JSON documents over many lines, arriving as a stream."""
    path = scratch_dir(t.spark, "manifests")
    write_manifest_documents(manifests(t), path)
    out = scratch_dir(t.spark, "arrived")
    run_to_table(flat_manifest(stream_manifests(t.spark, path)), f"{out}/data", f"{out}/ck")
    return t.spark.read.parquet(f"{out}/data")


@case("scan_blobs", "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS length, sha256(coalesce(text, '')) AS content_id FROM documents")
def _(t):
    """Every document text as an object of its own in one of 64 folders, listed and hashed in tasks."""
    root = scratch_dir(t.spark, "scan_blobs")
    stored = write_blobs(t("documents").select(F.col("doc_id").alias("name"), F.col("text").alias("content")), root, 64)
    stored.write.parquet(f"{root}-written")
    found = blob_digests(list_blobs(blob_folders(t.spark, root, 64)))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("bigint").alias("doc_id"), "length", "content_id")


def _existing_keys(t: Tables) -> DataFrame:
    return manifests(t).select(F.explode("pages.s3_key").alias("s3_key"))


@case("blob_exists", f"""WITH {MANIFEST_PAGES}
    SELECT p.s3_key, EXISTS (SELECT 1 FROM manifest_pages m WHERE m.s3_key = p.s3_key) AS "exists" FROM bundle_pages p""",
      ("bundles", "bundle_pages"))
def _(t):
    return blob_exists(t("bundle_pages").select("s3_key"), _existing_keys(t), "s3_key")


@case("put_if_absent", f"""WITH {MANIFEST_PAGES}
    SELECT p.s3_key, NOT EXISTS (SELECT 1 FROM manifest_pages m WHERE m.s3_key = p.s3_key) AS uploaded FROM bundle_pages p""",
      ("bundles", "bundle_pages"))
def _(t):
    return put_if_absent(t("bundle_pages").select("s3_key"), _existing_keys(t), "s3_key")[1]


def classified(t: Tables) -> DataFrame:
    b = t.wide("bundles").withColumn("cover_text", with_qr(F.col("cover_text"), F.col("qr_content")))
    return flatten_result(classify_documents(b))


WITH_QR = "with_qr AS (SELECT * EXCLUDE (cover_text), cover_text || CASE WHEN qr_content IS NOT NULL THEN chr(10) || 'QR:' || trim(qr_content) ELSE '' END AS cover_text FROM bundles)"
DECIDED = f"{WITH_QR}, {decided_cte('with_qr', 'cover_text')}"
MESSAGES = f"""{DECIDED}, messages AS (
    SELECT p.document_id, p.page_num, p.s3_key, d.document_category, coalesce(nullif(p.page_type, ''), 'other') AS page_type
    FROM bundle_pages p JOIN decided d ON p.document_id = d.document_id
    WHERE d.document_category <> 'other' AND p.page_type IS DISTINCT FROM 'blank')"""
_BODY = """'{"document_id":"' || document_id || '","page_num":' || cast(page_num AS string) || ',"s3_key":"' || s3_key
    || '","document_category":"' || document_category || '","page_type":"' || page_type || '"}'"""


def messages(t: Tables) -> DataFrame:
    return route_pages(t("bundle_pages"), classified(t), "s3_key").messages


@case("page_work_queue", f"WITH {MESSAGES} SELECT document_id AS \"key\", {_BODY} AS \"value\" FROM messages", ("bundles", "bundle_pages"))
def _(t):
    return page_work_queue(messages(t))


@case("queue_envelope", f"""WITH {MESSAGES} SELECT {_BODY} AS body, document_id AS group_id,
    document_id || ':' || cast(page_num AS string) AS dedup_id FROM messages""", ("bundles", "bundle_pages"))
def _(t):
    return queue_envelope(messages(t))


@case("vector_sink", f"""SELECT coalesce(a.page_id, b.page_id) AS page_id,
      coalesce(b.label, a.label) AS label, round(coalesce(b.e0, a.e0), 6) AS first_component,
      CASE WHEN a.page_id IS NULL THEN {NEW} ELSE {OLD} END AS created_at, CASE WHEN b.page_id IS NULL THEN {OLD} ELSE {NEW} END AS updated_at
    FROM (SELECT v.document_id || ':' || cast(v.page_num AS string) AS page_id, cast(label AS bigint) AS label, cast(embedding[1] AS double) AS e0
          FROM page_vectors v JOIN bundle_pages p ON v.document_id = p.document_id AND v.page_num = p.page_num WHERE p.ls = 'F') a
    FULL JOIN (SELECT v.document_id || ':' || cast(v.page_num AS string) AS page_id, cast(label + 100 AS bigint) AS label, cast(-embedding[1] AS double) AS e0
          FROM page_vectors v JOIN bundle_pages p ON v.document_id = p.document_id AND v.page_num = p.page_num WHERE p.rf <> 'R') b
    ON a.page_id = b.page_id""", "page_vectors")
def _(t):
    """The flags join on the key of the merge, so vectors are shuffled once, for both sides of it."""
    vectors = t("page_vectors").select(page_id(F.col("document_id"), F.col("page_num")).alias("page_id"), "label", "embedding")
    points = vectors.join(t("bundle_pages").select("page_id", "ls", "rf"), "page_id")
    stored = points.filter("ls = 'F'").select(
        "page_id", F.col("label").cast("bigint").alias("label"), "embedding",
        F.lit(OLD_TS).alias("created_at"), F.lit(OLD_TS).alias("updated_at"),
    )
    fresh = points.filter("rf <> 'R'").select(
        "page_id", (F.col("label") + 100).cast("bigint").alias("label"), F.transform("embedding", lambda x: -x).alias("embedding")
    )
    after = upsert(stored, fresh, ["page_id"], RUN_TS)
    return after.select(
        "page_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_component"), stamp("created_at"), stamp("updated_at")
    )


@case("graph_sink", f"""SELECT document_id, page_id, CASE WHEN max(old) = 1 THEN {OLD} ELSE {NEW} END AS created_at,
      CASE WHEN max(fresh) = 1 THEN {NEW} ELSE {OLD} END AS updated_at
    FROM (SELECT document_id, page_id, 1 AS old, 0 AS fresh FROM bundle_pages WHERE ls = 'F'
          UNION ALL SELECT document_id, document_id || ':' || cast(page_num AS string), 0, 1 FROM bundle_pages_raw)
    GROUP BY document_id, page_id""", ("bundle_pages", "bundle_pages_raw"))
def _(t):
    stored = t("bundle_pages").filter("ls = 'F'").select(
        "document_id", "page_id", F.lit(OLD_TS).alias("created_at"), F.lit(OLD_TS).alias("updated_at")
    )
    seen = t("bundle_pages_raw").select("document_id", page_id(F.col("document_id"), F.col("page_num")).alias("page_id"))
    after = upsert(stored, merge_nodes(["document_id", "page_id"], seen), ["document_id", "page_id"], RUN_TS)
    return after.select("document_id", "page_id", stamp("created_at"), stamp("updated_at"))


def as_registry_table(persons: DataFrame, created_at: datetime) -> DataFrame:
    """A registry table from (registration_no, full_name, dob) rows."""
    known = {
        "id": surrogate_id(F.col("registration_no").cast("int")),
        "registration_no": F.col("registration_no").cast("int"),
        "l_name": F.col("full_name"),
        "date_of_birth": F.col("dob").cast("string"),
        "created_at": F.lit(created_at),
        "updated_at": F.lit(created_at),
    }
    return persons.select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in REGISTRY.fields]
    )


def registry_changes(persons: DataFrame, sheet: DataFrame, created_at: datetime) -> tuple[DataFrame, DataFrame]:
    """(existing table, batch) where every two sheet rows fall on one key, ordered by ``sheet_row``."""
    cleaned = clean_registry(sheet.withColumn("roll_no", F.col("sheet_row").cast("string")))
    batch = cleaned.withColumn("sheet_row", F.col("roll_no").cast("bigint")).withColumn(
        "registration_no", F.floor(F.col("registration_no") / 2).cast("int")
    )
    return as_registry_table(persons, created_at), batch


@case("registry_sink", f"""WITH keyed AS (SELECT cast(trunc(try_cast(trim(registration_no) AS double)) AS bigint) AS k, sheet_row, l_name,
        lower(trim(nullif(f_name, 'null'))) AS fn FROM registry_raw WHERE regexp_matches(trim(registration_no), '^[0-9.e]+$') AND registration_no <> '21474836480'),
      halves AS (SELECT k // 2 AS k, arg_max(l_name, sheet_row) AS l_name FROM keyed GROUP BY 1)
    SELECT coalesce(t.registration_no, h.k) AS registration_no, CASE WHEN h.k IS NULL THEN t.full_name ELSE h.l_name END AS l_name,
      CASE WHEN t.registration_no IS NULL THEN {NEW} ELSE {OLD} END AS created_at, CASE WHEN h.k IS NULL THEN {OLD} ELSE {NEW} END AS updated_at
    FROM person t FULL JOIN halves h ON t.registration_no = h.k""", ("registry_raw", "person"))
def _(t):
    target, changes = registry_changes(t("person"), t("registry_raw"), OLD_TS)
    after = registry_sink(target, changes, RUN_TS, seq="sheet_row").table
    return after.select(F.col("registration_no").cast("bigint").alias("registration_no"), "l_name", stamp("created_at"), stamp("updated_at"))

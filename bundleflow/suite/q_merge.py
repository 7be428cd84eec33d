"""Registered queries: idempotent table mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import page_id
from ..operators import merge as M
from .q_sources import NEW, OLD, OLD_TS, RUN_TS, registry_changes, stamp
from .registry import case

_STORED_DOCS = "stored AS (SELECT document_id, document_category, status, match_status, page_count FROM document_states WHERE status <> 'in_flight')"
_DOC_CHANGES = """changes AS (SELECT document_id, CASE WHEN page_count % 2 = 0 THEN 'record' END AS document_category,
    CASE status WHEN 'processed' THEN 'processing' ELSE 'received' END AS status, 'pending' AS match_status, page_count + 10 AS page_count
    FROM document_states WHERE status <> 'received')"""


def stored_documents(t):
    return t("document_states").filter("status <> 'in_flight'").select(
        "document_id", "document_category", "status", "match_status", "page_count",
        F.lit(OLD_TS).alias("created_at"), F.lit(OLD_TS).alias("updated_at"),
    )


def document_changes(t):
    return t("document_states").filter("status <> 'received'").select(
        "document_id", F.when(F.col("page_count") % 2 == 0, "record").alias("document_category"),
        F.when(F.col("status") == "processed", "processing").otherwise("received").alias("status"),
        F.lit("pending").alias("match_status"), (F.col("page_count") + 10).alias("page_count"),
    )


def _shown(df):
    return df.select(*[c for c in df.columns if not c.endswith("_at")], stamp("created_at"), stamp("updated_at"))


_STAMPS = f"CASE WHEN a.{{k}} IS NULL THEN {NEW} ELSE {OLD} END AS created_at, CASE WHEN b.{{k}} IS NULL THEN {OLD} ELSE {NEW} END AS updated_at"
_DS = _STAMPS.format(k="document_id")
_PS = _STAMPS.format(k="page_id")


@case("upsert_documents", f"""WITH {_STORED_DOCS}, {_DOC_CHANGES} SELECT coalesce(a.document_id, b.document_id) AS document_id,
      coalesce(b.document_category, a.document_category) AS document_category, coalesce(a.status, b.status) AS status,
      CASE WHEN a.match_status IN ('matched', 'unmatched') THEN a.match_status WHEN b.document_id IS NULL THEN a.match_status
           WHEN a.match_status = 'lost' OR a.match_status IS NULL OR a.match_status = 'pending' THEN b.match_status ELSE a.match_status END AS match_status,
      coalesce(b.page_count, a.page_count) AS page_count, {_DS}
    FROM stored a FULL JOIN changes b ON a.document_id = b.document_id""", "document_states")
def _(t):
    return _shown(M.upsert_documents(stored_documents(t), document_changes(t), RUN_TS))


@case("upsert_documents_overwrite", f"""WITH {_STORED_DOCS}, {_DOC_CHANGES} SELECT coalesce(a.document_id, b.document_id) AS document_id,
      CASE WHEN b.document_id IS NULL THEN a.document_category ELSE b.document_category END AS document_category,
      CASE WHEN b.document_id IS NULL THEN a.status ELSE b.status END AS status, CASE WHEN b.document_id IS NULL THEN a.match_status ELSE b.match_status END AS match_status,
      CASE WHEN b.document_id IS NULL THEN a.page_count ELSE b.page_count END AS page_count, {_DS}
    FROM stored a FULL JOIN changes b ON a.document_id = b.document_id""", "document_states")
def _(t):
    once = M.upsert_documents(stored_documents(t), document_changes(t), RUN_TS, "overwrite")
    return _shown(M.upsert_documents(once, document_changes(t), RUN_TS, "overwrite"))


_STORED_PAGES = "stored AS (SELECT page_id, document_id, page_num, page_type, confidence_score, CASE rf WHEN 'A' THEN 'done' WHEN 'N' THEN 'queued' ELSE 'pending' END AS ocr_status FROM bundle_pages WHERE ls = 'F')"
_PAGE_CHANGES = """changes AS (SELECT page_id, document_id, page_num, CASE WHEN q < 25 THEN 'form' END AS page_type,
    CASE page_num % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' ELSE 'failed' END AS ocr_status FROM bundle_pages WHERE q > 5)"""
_RANK = "CASE {c} WHEN 'pending' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END"


def stored_pages(t):
    return t("bundle_pages").filter("ls = 'F'").select(
        "page_id", "document_id", "page_num", "page_type", "confidence_score",
        F.when(F.col("rf") == "A", "done").when(F.col("rf") == "N", "queued").otherwise("pending").alias("ocr_status"),
        F.lit(OLD_TS).alias("created_at"), F.lit(OLD_TS).alias("updated_at"),
    )


def page_changes(t):
    third = F.col("page_num") % 3
    return t("bundle_pages").filter("q > 5").select(
        "document_id", "page_num", F.when(F.col("q") < 25, "form").alias("page_type"),
        F.when(third == 0, "pending").when(third == 1, "queued").otherwise("failed").alias("ocr_status"),
    )


_PAGE_KEYS = "coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.page_num, b.page_num) AS page_num, a.confidence_score"


@case("upsert_pages", f"""WITH {_STORED_PAGES}, {_PAGE_CHANGES} SELECT {_PAGE_KEYS}, coalesce(b.page_type, a.page_type) AS page_type,
      CASE WHEN a.page_id IS NULL OR (b.page_id IS NOT NULL AND {_RANK.format(c='b.ocr_status')} > {_RANK.format(c='a.ocr_status')}) THEN b.ocr_status ELSE a.ocr_status END AS ocr_status, {_PS}
    FROM stored a FULL JOIN changes b ON a.page_id = b.page_id""", "bundle_pages")
def _(t):
    return _shown(M.upsert_pages(stored_pages(t), page_changes(t), RUN_TS))


@case("upsert_pages_overwrite", f"""WITH {_STORED_PAGES}, {_PAGE_CHANGES} SELECT {_PAGE_KEYS}, CASE WHEN b.page_id IS NULL THEN a.page_type ELSE b.page_type END AS page_type,
      coalesce(b.ocr_status, a.ocr_status) AS ocr_status, {_PS} FROM stored a FULL JOIN changes b ON a.page_id = b.page_id""", "bundle_pages")
def _(t):
    return _shown(M.upsert_pages(stored_pages(t), page_changes(t), RUN_TS, "overwrite"))


@case("bulk_upsert_pages", f"""WITH {_STORED_PAGES}, changes AS (SELECT document_id || ':' || cast(page_num AS string) AS page_id, document_id, page_num, arg_max(payload, seq) / 2000.0 AS payload
        FROM bundle_pages_raw GROUP BY 1, 2, 3)
    SELECT {_PAGE_KEYS.replace('a.confidence_score', 'coalesce(b.payload, a.confidence_score) AS confidence_score')}, a.page_type, coalesce(a.ocr_status, 'pending') AS ocr_status, {_PS}
    FROM stored a FULL JOIN (SELECT * FROM changes) b ON a.page_id = b.page_id""", ("bundle_pages", "bundle_pages_raw"))
def _(t):
    batch = M.last_write_wins(t("bundle_pages_raw"), ["document_id", "page_num"], "seq")
    rows = batch.select("document_id", "page_num", (F.col("payload") / 2000.0).alias("confidence_score"), F.lit("pending").alias("ocr_status"))
    return _shown(M.bulk_upsert_pages(stored_pages(t), rows, RUN_TS, "forward_only"))


@case("upsert_pages_repeated", f"""WITH {_STORED_PAGES}, changes AS (SELECT document_id || ':' || cast(page_num AS string) AS page_id, document_id, page_num, arg_max(payload, seq) / 2000.0 AS payload
        FROM bundle_pages_raw GROUP BY 1, 2, 3)
    SELECT {_PAGE_KEYS.replace('a.confidence_score', 'coalesce(b.payload, a.confidence_score) AS confidence_score')}, a.page_type, coalesce(a.ocr_status, 'pending') AS ocr_status, {_PS}
    FROM stored a FULL JOIN (SELECT * FROM changes) b ON a.page_id = b.page_id""", ("bundle_pages", "bundle_pages_raw"))
def _(t):
    raw = t("bundle_pages_raw").select("document_id", "page_num", (F.col("payload") / 2000.0).alias("confidence_score"), F.lit("pending").alias("ocr_status"), "seq")
    after = M.upsert_pages(stored_pages(t), raw, RUN_TS, seq="seq")
    for _ in range(2):  # a batch that comes again changes nothing
        after = M.upsert_pages(after, raw, RUN_TS, seq="seq")
    return _shown(after)


@case("update_fields_repeated", f"""WITH {_STORED_PAGES.replace('stored AS', 'pages AS')}, {_STORED_DOCS}, last AS (SELECT document_id, arg_max(page_num, seq) AS n FROM bundle_pages_raw GROUP BY 1)
    SELECT s.document_id, CASE WHEN l.n IS NULL THEN s.match_status WHEN l.n % 2 = 0 THEN 'matched' ELSE 'unmatched' END AS match_status FROM stored s LEFT JOIN last l ON s.document_id = l.document_id""",
      ("bundle_pages", "bundle_pages_raw", "document_states"))
def _(t):
    state = F.when(F.col("page_num") % 2 == 0, "matched").otherwise("unmatched").alias("match_status")
    changes = t("bundle_pages_raw").select("document_id", state, "seq")
    after = M.update_fields(stored_documents(t), changes, RUN_TS, seq="seq")
    return M.update_fields(after, changes, RUN_TS, seq="seq").select("document_id", "match_status")


@case("insert_if_absent", f"""WITH {_STORED_PAGES}, {_PAGE_CHANGES} SELECT page_id, document_id, page_num, confidence_score, page_type, ocr_status, {OLD} AS created_at, {OLD} AS updated_at FROM stored
    UNION ALL SELECT page_id, document_id, page_num, NULL, page_type, ocr_status, {NEW}, {NEW} FROM changes WHERE page_id NOT IN (SELECT page_id FROM stored)""", "bundle_pages")
def _(t):
    changes = page_changes(t).withColumn("page_id", page_id(F.col("document_id"), F.col("page_num")))
    return _shown(M.insert_if_absent(stored_pages(t), changes, ["page_id"], RUN_TS))


@case("upsert_registry", f"""WITH keyed AS (SELECT cast(trunc(try_cast(trim(registration_no) AS double)) AS bigint) // 2 AS k, sheet_row, district, m_name FROM registry_raw
        WHERE regexp_matches(trim(registration_no), '^[0-9.e]+$') AND registration_no <> '21474836480'),
      last AS (SELECT k, arg_max(district, sheet_row) AS district, max(sheet_row) AS sheet_row FROM keyed GROUP BY 1)
    SELECT coalesce(p.registration_no, l.k) AS registration_no, l.district, cast(l.sheet_row AS string) AS roll_no,
      CASE WHEN l.k IS NULL THEN strftime(p.dob, '%Y-%m-%d') END AS untouched_dob, true AS stable_id
    FROM person p FULL JOIN last l ON p.registration_no = l.k""", ("registry_raw", "person"))
def _(t):
    target, batch = registry_changes(t("person"), t("registry_raw"), OLD_TS)
    after = M.upsert_registry(target, batch, RUN_TS, "sheet_row")
    return after.select(
        F.col("registration_no").cast("bigint").alias("registration_no"), "district", "roll_no",
        F.when(F.col("updated_at") == F.lit(OLD_TS), F.col("date_of_birth")).alias("untouched_dob"),
        (F.col("id") == F.xxhash64("registration_no")).alias("stable_id"),
    )


_STATUS = """SELECT s.document_id, CASE WHEN d.page_count >= 2 THEN 'processed' ELSE s.status END AS status,
    CASE WHEN d.page_count >= 2 AND s.status <> 'processed' THEN {new} ELSE {old} END AS updated_at
    FROM stored s JOIN document_states d ON s.document_id = d.document_id""".format(new=NEW, old=OLD)


def _status_moves(t):
    moves = t("document_states").filter("page_count >= 2 AND status <> 'in_flight'").select("document_id", F.lit("processed").alias("status"))
    return M.update_status(stored_documents(t), moves, RUN_TS)


@case("update_status", f"WITH {_STORED_DOCS} SELECT document_id, status FROM ({_STATUS})", "document_states")
def _(t):
    return _status_moves(t).select("document_id", "status")


@case("touch_updated_at", f"WITH {_STORED_DOCS} SELECT document_id, updated_at FROM ({_STATUS})", "document_states")
def _(t):
    return _status_moves(t).select("document_id", stamp("updated_at"))


@case("update_fields", f"""WITH {_STORED_DOCS}, {_DOC_CHANGES} SELECT a.document_id, CASE WHEN b.document_id IS NULL THEN a.document_category ELSE b.document_category END AS document_category,
      CASE WHEN b.document_id IS NULL THEN a.match_status ELSE b.match_status END AS match_status, CASE WHEN b.document_id IS NULL THEN {OLD} ELSE {NEW} END AS updated_at
    FROM stored a LEFT JOIN changes b ON a.document_id = b.document_id""", "document_states")
def _(t):
    patch = document_changes(t).select("document_id", "document_category", "match_status")
    return M.update_fields(stored_documents(t), patch, RUN_TS).select("document_id", "document_category", "match_status", stamp("updated_at"))


@case("bulk_update_ocr_status", f"""WITH {_STORED_PAGES} SELECT s.page_id, CASE WHEN e.document_id IS NOT NULL THEN 'skipped' ELSE s.ocr_status END AS ocr_status,
      CASE WHEN e.document_id IS NOT NULL THEN {NEW} ELSE {OLD} END AS updated_at
    FROM stored s LEFT JOIN entity_texts e ON s.document_id = e.document_id AND s.page_num = e.page_num""", ("bundle_pages", "entity_texts"))
def _(t):
    named = t("entity_texts").select("document_id", "page_num", F.lit("skipped").alias("ocr_status"))
    return M.bulk_update_ocr_status(stored_pages(t), named, RUN_TS).select("page_id", "ocr_status", stamp("updated_at"))


@case("update_ocr", f"""WITH {_STORED_PAGES}, results AS (SELECT document_id, page_num, CASE WHEN avg(conf) >= 50 THEN round(avg(conf), 4) END AS conf FROM ocr_tokens GROUP BY 1, 2)
    SELECT s.page_id, round(coalesce(r.conf, s.confidence_score), 4) AS confidence_score, 'done' AS ocr_status, {NEW} AS updated_at
    FROM stored s JOIN results r ON s.document_id = r.document_id AND s.page_num = r.page_num""", ("bundle_pages", "ocr_tokens"))
def _(t):
    mean = t("ocr_tokens").groupBy("document_id", "page_num").agg(F.round(F.avg("conf"), 4).alias("m"))
    results = mean.select("document_id", "page_num", F.when(F.col("m") >= 50, F.col("m")).alias("confidence_score"))
    known = results.join(stored_pages(t).select("document_id", "page_num"), ["document_id", "page_num"], "left_semi")
    after = M.update_ocr(stored_pages(t), known, RUN_TS)
    return after.select("page_id", F.round("confidence_score", 4).alias("confidence_score"), "ocr_status", stamp("updated_at"))


@case("update_structured", f"""WITH {_STORED_PAGES} SELECT s.page_id, coalesce(CASE WHEN b.cover_text LIKE '%Dear Sir%' THEN 'letter_body' END, s.page_type) AS page_type,
      s.ocr_status, {NEW} AS updated_at FROM stored s JOIN bundles b ON s.document_id = b.document_id""", ("bundle_pages", "bundles"))
def _(t):
    kind = F.when(F.contains(F.col("cover_text"), F.lit("Dear Sir")), "letter_body")
    results = stored_pages(t).select("document_id", "page_num").join(t("bundles").select("document_id", kind.alias("page_type")), "document_id")
    return M.update_structured(stored_pages(t), results, RUN_TS).select("page_id", "page_type", "ocr_status", stamp("updated_at"))


@case("merge_nodes", "SELECT registration_no, min(name) AS name FROM (SELECT registration_no, full_name AS name FROM person UNION ALL SELECT b.registration_no, lower(a.applicant_name_raw) FROM applicants a JOIN belongs_to b ON a.document_id = b.document_id WHERE a.applicant_name_raw IS NOT NULL) GROUP BY 1",
      ("person", "applicants", "belongs_to"))
def _(t):
    seen = t("applicants").filter("applicant_name_raw IS NOT NULL").join(t("belongs_to"), "document_id").select(
        "registration_no", F.lower("applicant_name_raw").alias("name")
    )
    return M.merge_nodes(["registration_no"], t("person").select("registration_no", F.col("full_name").alias("name")), seen)


@case("union_categories", """SELECT document_id, status, match_status, NULL AS vendor FROM document_states WHERE document_category = 'practitioner'
    UNION ALL SELECT document_id, status, NULL, json_extract_string(metadata, '$.vendor_name') FROM document_states WHERE document_category <> 'practitioner'""", "document_states")
def _(t):
    docs = t("document_states")
    people = docs.filter("document_category = 'practitioner'").select("document_id", "status", "match_status")
    others = docs.filter("document_category <> 'practitioner'").select("document_id", "status", F.get_json_object("metadata", "$.vendor_name").alias("vendor"))
    return M.union_categories(people, others)

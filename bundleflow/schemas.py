"""Explicit schemas and enumerations; nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: enumerations of the data model ------------------------------------
CATEGORIES = ("practitioner", "letter", "receipt", "record", "other")
DOCUMENT_STATUSES = ("received", "processing", "processed", "failed", "manual_review")
MATCH_STATUSES = ("pending", "matched", "unmatched", "not_applicable", "manual_review")
OCR_STATUSES = ("pending", "queued", "done", "skipped", "failed")
MANIFEST_VERSIONS = (1,)

# Columns a targeted document update may touch.
DOCUMENT_PATCHABLE = (
    "document_category", "match_status", "status", "registration_no", "applicant_name_raw",
    "application_number", "dob", "gender", "reference_data_id",
)
# -------------------------------------------------------------------------------------

# How far a state has advanced.  A forward-only merge never goes back, and the highest rank is final.
OCR_STATUS_RANK = {"pending": 0, "queued": 1, "done": 2, "failed": 2, "skipped": 2}
DOCUMENT_STATUS_RANK = {"received": 0, "processing": 1, "processed": 2, "failed": 2, "manual_review": 2}
MATCH_STATUS_RANK = {"pending": 0, "manual_review": 0, "matched": 1, "unmatched": 1, "not_applicable": 1}


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(),
    "date": T.DateType(), "timestamp": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """``name type, …`` to a schema; unlike DDL parsing it needs no running session."""
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


REGISTRY_DATA = _struct(
    "app_no bigint, app_date string, registration_no int, registration_date string, "
    "f_name string, m_name string, l_name string, "
    "f_name_change string, m_name_change string, l_name_change string, "
    "gender string, date_of_birth string, place_of_birth string, nationality string, "
    "qualification string, exam_month string, exam_year float, roll_no string, "
    "university string, college string, address string, district string, taluka string, pin_no int, "
    "prof_add string, prof_district string, prof_taluka string, prof_pin_no int, "
    "mobile_no string, telephone_no string, prof_telephone_no string, email_id string, "
    "cr_dt timestamp, status string, valid_upto_date string, doctor_status string"
)
FIELDS_NORM = _struct(
    "registration_no string, full_name string, name_change string, dob string, "
    "qualification string, college string, university string, district string"
)
REGISTRY = T.StructType(
    [T.StructField("id", T.LongType())]
    + REGISTRY_DATA.fields
    + [
        T.StructField("fields_norm", FIELDS_NORM),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
DOCUMENTS = _struct(
    "document_id string, document_category string, document_type string, original_filename string, "
    "qr_content string, s3_key_pdf string, page_count int, status string, application_number string, "
    "registration_no string, applicant_name_raw string, dob date, gender string, "
    "reference_data_id bigint, match_status string, metadata string, "
    "created_at timestamp, updated_at timestamp"
)
PAGES = _struct(
    "page_id string, document_id string, page_num int, s3_key_image string, page_type string, "
    "raw_text string, structured_json string, confidence_score float, language_detected string, "
    "ocr_status string, created_at timestamp, updated_at timestamp"
)
# Union of the two manifest forms in circulation; every optional field is nullable.
MANIFEST_PAGE = _struct(
    "page_num int, s3_key string, width int, height int, sha256 string, page_type string, language_hint string"
)
MANIFEST = T.StructType(
    _struct(
        "schema_version int, document_id string, original_name string, original_sha256 string, "
        "s3_key_original string, original_s3_key string, document_category string, qr_content string, page_count int"
    ).fields
    + [T.StructField("pages", T.ArrayType(MANIFEST_PAGE))]
    + _struct("preprocessed_at timestamp, nas_host string, preprocess_version string").fields
)
EXPECTED_COLUMNS = {
    "registry": tuple(REGISTRY.fieldNames()),
    "documents": tuple(DOCUMENTS.fieldNames()),
    "pages": tuple(PAGES.fieldNames()),
}

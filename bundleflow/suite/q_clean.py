"""Registered queries: projections and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.keys import content_id, filename_from_key, page_id, page_key, parse_page_key
from ..operators.dedup import content_dedup
from ..operators.registry import clean_registry, drop_missing_key, map_aliases, typed_registry
from ..operators.registry import fields_norm
from ..operators.route import explode_pages
from ..schemas import REGISTRY_DATA
from .q_sources import MANIFEST_PAGES, manifests
from .registry import case

_BLANK = "CASE WHEN trim({c}) NOT IN ('', 'nan', 'nat', 'none', 'null', '<na>') THEN trim({c}) END"
_NUM = r"CASE WHEN regexp_matches(trim({c}), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN try_cast(trim({c}) AS double) END"
_SENT = "('01/01/1900', '1900-01-01', '1900-01-01 00:00:00', '1900-01-01 00:00:00.000000')"
_TS = "try_strptime(CASE WHEN trim({c}) NOT IN " + _SENT + " THEN trim({c}) END, ['%d/%m/%Y', '%Y-%m-%d', '%d-%m-%Y', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S'])"
_DATE = "strftime(" + _TS + ", '%Y-%m-%d')"
_INT4 = "CASE WHEN abs({n}) <= 2147483647 THEN cast(trunc({n}) AS bigint) END"


def _int4(c: str) -> str:
    return _INT4.format(n="(" + _NUM.format(c=c) + ")")


_FULL = "trim(regexp_replace(concat_ws(' ', lower({f}), lower({m}), lower({l})), '\\s+', ' ', 'g'))".format(
    f=_BLANK.format(c="f_name"), m=_BLANK.format(c="m_name"), l=_BLANK.format(c="l_name")
)


@case("norm_header", r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(h)), '[\s/\\-]+', '_', 'g'), '\W', '', 'g') AS header
    FROM (SELECT p_partkey, ' ' || p_type || ' - ' || p_name || '/' || p_brand || '. ' AS h FROM part)""")
def _(t):
    h = F.concat(F.lit(" "), "p_type", F.lit(" - "), "p_name", F.lit("/"), "p_brand", F.lit(". "))
    return t("part").select("p_partkey", C.norm_header(h).alias("header"))


_REGISTRY_COLUMNS = ("registration_no", "app_no", "date_of_birth", "cr_dt", "f_name", "m_name", "l_name", "district", "exam_year")


@case("map_aliases", "SELECT " + ", ".join(c if c in _REGISTRY_COLUMNS else f"cast(NULL AS string) AS {c}" for c in REGISTRY_DATA.fieldNames()) + " FROM registry_raw", "registry_raw")
def _(t):
    sheet = t("registry_raw").select(
        F.col("registration_no").alias("Registration No"), F.col("app_no").alias("App-No"), F.col("date_of_birth").alias("DOB"),
        F.col("cr_dt").alias("Created Date"), F.col("f_name").alias("First Name"), F.col("m_name").alias("MiddleName"),
        F.col("l_name").alias("Surname"), F.col("district").alias("Distrinct"), F.col("exam_year").alias("Exam Year"), "sheet_row",
    )
    return map_aliases(sheet)


@case("alias_conflict", "SELECT app_no, CASE WHEN length(cr_dt) > 0 THEN cr_dt END AS date_of_birth FROM registry_raw", "registry_raw")
def _(t):
    sheet = t("registry_raw").select(
        "registration_no", "app_no", "date_of_birth", F.nullif("cr_dt", F.lit("")).alias("Birth Date")
    )
    return map_aliases(sheet).select("app_no", "date_of_birth")


@case("prefer_correct_spelling", "SELECT app_no, district FROM registry_raw", "registry_raw")
def _(t):
    sheet = t("registry_raw").select("registration_no", "app_no", "district", F.col("l_name").alias("Distrinct"))
    return map_aliases(sheet).select("app_no", "district")


@case("require_key_column", "SELECT registration_no FROM registry_raw", "registry_raw")
def _(t):
    try:
        map_aliases(t("registry_raw").drop("registration_no"))
    except ValueError:
        return map_aliases(t("registry_raw").withColumnRenamed("registration_no", "RegNo")).select("registration_no")
    raise AssertionError("a sheet without a key column was accepted")


@case("blank_to_null", f"SELECT sheet_row, {_BLANK.format(c='f_name')} AS f_name, {_BLANK.format(c='m_name')} AS m_name FROM registry_raw", "registry_raw")
def _(t):
    return t("registry_raw").select("sheet_row", C.blank_to_null(F.col("f_name")).alias("f_name"), C.blank_to_null(F.col("m_name")).alias("m_name"))


@case("to_int4", f"SELECT sheet_row, {_int4('registration_no')} AS n FROM registry_raw", "registry_raw")
def _(t):
    return t("registry_raw").select("sheet_row", C.to_int4(F.col("registration_no")).cast("bigint").alias("n"))


@case("to_int8", f"SELECT sheet_row, cast(trunc({_NUM.format(c='app_no')}) AS bigint) AS app, cast(trunc({_NUM.format(c='registration_no')}) AS bigint) AS reg FROM registry_raw", "registry_raw")
def _(t):
    return t("registry_raw").select("sheet_row", C.to_int8(F.col("app_no")).alias("app"), C.to_int8(F.col("registration_no")).alias("reg"))


@case("to_float", f"SELECT sheet_row, {_NUM.format(c='exam_year')} AS y FROM registry_raw", "registry_raw")
def _(t):
    return t("registry_raw").select("sheet_row", C.to_float(F.col("exam_year")).cast("double").alias("y"))


@case("parse_date_text", f"SELECT sheet_row, {_DATE.format(c='date_of_birth')} AS d FROM registry_raw", "registry_raw")
def _(t):
    return t("registry_raw").select("sheet_row", C.parse_date_text(F.col("date_of_birth")).alias("d"))


@case("parse_timestamp", f"SELECT sheet_row, strftime({_TS.format(c='cr_dt')}, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM registry_raw", "registry_raw")
def _(t):
    ts = C.parse_timestamp(F.col("cr_dt"))
    return t("registry_raw").select("sheet_row", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@case("sentinel_to_null", f"""SELECT sheet_row, CASE WHEN cr_dt NOT IN {_SENT} AND cr_dt <> '' THEN cr_dt END AS cr_dt,
    CASE WHEN date_of_birth NOT IN {_SENT} THEN date_of_birth END AS dob FROM registry_raw""", "registry_raw")
def _(t):
    return t("registry_raw").select(
        "sheet_row", C.sentinel_to_null(F.col("cr_dt")).alias("cr_dt"), C.sentinel_to_null(F.col("date_of_birth")).alias("dob")
    )


@case("strip_text", f"SELECT sheet_row, {_BLANK.format(c='f_name')} AS f_name, trim(registration_no) AS reg FROM registry_raw", "registry_raw")
def _(t):
    return t("registry_raw").select("sheet_row", C.strip_text(F.col("f_name")).alias("f_name"), C.strip(F.col("registration_no")).alias("reg"))


@case("drop_missing_key", f"SELECT sheet_row, {_int4('registration_no')} AS registration_no FROM registry_raw WHERE {_int4('registration_no')} IS NOT NULL", "registry_raw")
def _(t):
    typed = t("registry_raw").select("sheet_row", C.to_int4(F.col("registration_no")).cast("bigint").alias("registration_no"))
    return drop_missing_key(typed)


@case("full_name", f"SELECT sheet_row, {_FULL} AS full_name FROM registry_raw", "registry_raw")
def _(t):
    return t("registry_raw").select("sheet_row", C.full_name(F.col("f_name"), F.col("m_name"), F.col("l_name")).alias("full_name"))


_NORM = f"""coalesce(cast({_int4('registration_no')} AS string), '') AS registration_no, {_FULL} AS full_name, '' AS name_change,
    coalesce({_DATE.format(c='date_of_birth')}, '') AS dob, '' AS qualification, '' AS college, '' AS university, lower(district) AS district"""


@case("fields_norm", f"SELECT app_no, {_NORM} FROM (SELECT cast(app_no AS bigint) AS app_no, * EXCLUDE (app_no) FROM registry_raw)", "registry_raw")
def _(t):
    return typed_registry(t("registry_raw")).select("app_no", fields_norm().alias("n")).select("app_no", "n.*")


@case("clean_registry", f"""SELECT cast(app_no AS bigint) AS app_no, {_int4('registration_no')} AS registration_no, {_BLANK.format(c='f_name')} AS f_name,
      {_BLANK.format(c='m_name')} AS m_name, {_BLANK.format(c='l_name')} AS l_name, {_DATE.format(c='date_of_birth')} AS date_of_birth,
      strftime({_TS.format(c='cr_dt')}, '%Y-%m-%d %H:%M:%S.%f') AS cr_dt, {_NUM.format(c='exam_year')} AS exam_year, district,
      {_FULL} AS full_name FROM registry_raw WHERE {_int4('registration_no')} IS NOT NULL""", "registry_raw")
def _(t):
    return clean_registry(t.wide("registry_raw")).select(
        "app_no", F.col("registration_no").cast("bigint").alias("registration_no"), "f_name", "m_name", "l_name", "date_of_birth",
        F.date_format("cr_dt", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("cr_dt"), F.col("exam_year").cast("double").alias("exam_year"),
        "district", F.col("fields_norm.full_name").alias("full_name"),
    )


@case("page_id", "SELECT document_id, page_num, document_id || ':' || cast(page_num AS string) AS page_id FROM bundle_pages", "bundle_pages")
def _(t):
    return t("bundle_pages").select("document_id", "page_num", page_id(F.col("document_id"), F.col("page_num")).alias("page_id"))


@case("filename_from_key", "SELECT s3_key, regexp_extract(s3_key, '[^/]*$', 0) AS name FROM bundle_pages", "bundle_pages")
def _(t):
    return t("bundle_pages").select("s3_key", filename_from_key(F.col("s3_key")).alias("name"))


@case("page_key", """SELECT document_id, page_num, 'documents/' || document_id || '/pages/page_' || lpad(cast(page_num AS string), 3, '0') || '.png' AS s3_key
    FROM bundle_pages""", "bundle_pages")
def _(t):
    return t("bundle_pages").select("document_id", "page_num", page_key(F.col("document_id"), F.col("page_num")).alias("s3_key"))


@case("parse_page_key", "SELECT s3_key, document_id, page_num FROM bundle_pages UNION ALL SELECT original_s3_key, NULL, NULL FROM bundles", ("bundle_pages", "bundles"))
def _(t):
    keys = t("bundle_pages").select("s3_key").union(t("bundles").select("original_s3_key"))
    parsed = parse_page_key(F.col("s3_key"))
    return keys.select("s3_key", parsed["document_id"].alias("document_id"), parsed["page_num"].cast("bigint").alias("page_num"))


@case("explode_pages", f"""WITH {MANIFEST_PAGES} SELECT document_id || ':' || cast(page_num AS string) AS page_id, document_id, page_num,
    s3_key AS s3_key_image, page_type FROM manifest_pages""", "bundles")
def _(t):
    return explode_pages(manifests(t)).drop("language_detected").withColumn("page_num", F.col("page_num").cast("bigint"))


@case("default_fill", "SELECT page_id, coalesce(nullif(page_type, ''), 'other') AS page_type FROM bundle_pages", "bundle_pages")
def _(t):
    return t("bundle_pages").select("page_id", C.default_fill(F.col("page_type"), "other").alias("page_type"))


@case("content_id", "SELECT doc_id, sha256(text) AS content_id FROM documents")
def _(t):
    return t.wide("documents").select("doc_id", content_id(F.col("text")).alias("content_id"))


@case("content_dedup", "SELECT sha256(text) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    return content_dedup(t.wide("documents"), "text", "doc_id")

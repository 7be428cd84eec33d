"""Views that give the driver tables the shape of bundles, pages, tokens and a registry.

Each is one portable SELECT: Spark and the SQL check run the same text, over whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.plan import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_DMY = "lpad(cast(day({d}) AS string),2,'0') || '/' || lpad(cast(month({d}) AS string),2,'0') || '/' || cast(year({d}) AS string)"
_YMD = "cast(year({d}) AS string) || '-' || lpad(cast(month({d}) AS string),2,'0') || '-' || lpad(cast(day({d}) AS string),2,'0')"
_DMY2 = _DMY.replace("'/'", "'-'")
_BIRTH = "DATE '1960-01-01' + cast(c_custkey % 15000 AS int)"
# one name in three is long enough for three edits and more
_TAIL = "CASE c_custkey % 3 WHEN 0 THEN ' venkatasubramaniam' ELSE '' END"
_NAME = f"replace(lower(c_name), '#', ' ') || {_TAIL}"

VIEWS: dict[str, str] = {
    # all-string sheet: blanks, floats in text, several date shapes, both district spellings
    "registry_raw": f"""
        SELECT CASE c_custkey % 10 WHEN 0 THEN cast(c_custkey AS string) || '.0'
                 WHEN 1 THEN ' ' || cast(c_custkey AS string) || ' ' WHEN 2 THEN 'nan'
                 WHEN 3 THEN 'X' || cast(c_custkey AS string) WHEN 4 THEN cast(c_custkey AS string) || 'e0'
                 WHEN 5 THEN '21474836480' ELSE cast(c_custkey AS string) END AS registration_no,
               cast(c_custkey * 1000003 AS string) AS app_no,
               CASE c_custkey % 6 WHEN 0 THEN {_DMY.format(d="d")} WHEN 1 THEN {_YMD.format(d="d")}
                 WHEN 2 THEN {_DMY2.format(d="d")} WHEN 3 THEN {_YMD.format(d="d")} || ' 10:20:30'
                 WHEN 4 THEN '01/01/1900' ELSE 'not a date' END AS date_of_birth,
               CASE c_custkey % 4 WHEN 0 THEN {_YMD.format(d="d")} || ' 09:08:07.250000' WHEN 1 THEN {_YMD.format(d="d")} || ' 23:59:59'
                 WHEN 2 THEN '1900-01-01 00:00:00' ELSE '' END AS cr_dt,
               CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE '  ' || upper(substring(c_name,1,8)) || ' ' END AS f_name,
               CASE c_custkey % 9 WHEN 0 THEN 'NULL' WHEN 1 THEN '<na>' ELSE c_mktsegment END AS m_name,
               cast(c_custkey AS string) AS l_name, cast(c_nationkey AS string) AS district,
               CASE c_custkey % 3 WHEN 0 THEN '1999.5' WHEN 1 THEN '12d' ELSE '2001' END AS exam_year,
               c_custkey AS sheet_row
        FROM (SELECT *, {_BIRTH} AS d FROM customer)""",
    "person": f"""
        SELECT cast(c_custkey AS bigint) AS registration_no, {_NAME} AS full_name, {_BIRTH} AS dob FROM customer""",
    "bundles": """
        SELECT cast(o_orderkey AS string) AS document_id, cast(o_custkey AS string) AS registration_no_raw,
               CASE WHEN o_orderkey % 17 = 0 THEN 'letter' ELSE 'other' END AS document_category,
               'documents/' || cast(o_orderkey AS string) || '/original.pdf' AS original_s3_key,
               CASE WHEN o_orderkey % 12 = 8 THEN 'I-96789' END AS qr_content,
               CASE o_orderkey % 12
                 WHEN 0 THEN 'Application Form' || chr(10) || 'Registration No: ' || cast(o_custkey AS string) || chr(10) || 'BHMS renewal'
                 WHEN 1 THEN 'Dear Sir,' || chr(10) || 'Subject: Show cause notice' || chr(10) || 'Yours faithfully'
                 WHEN 2 THEN 'State Bank of India' || chr(10) || 'Receipt' || chr(10) || 'Amount paid Rs. 500'
                 WHEN 3 THEN 'Register Book' || chr(10) || 'Serial No 5' || chr(10) || 'Folio 7'
                 WHEN 4 THEN 'Registration number' || chr(10) || 'Receipt'
                 WHEN 5 THEN ''
                 WHEN 6 THEN 'nothing of interest on this page at all'
                 WHEN 7 THEN 'plain line' || chr(10) || 'i-96789'
                 WHEN 8 THEN 'no signal, only a sticker'
                 WHEN 9 THEN 'aadhaar and ssc copy'
                 WHEN 10 THEN 'Government' || chr(10) || 'of Maharashtra' || chr(10) || 'NCH circular' || chr(10) || 'Ref No 5'
                 ELSE 'Invoice No 55' || chr(10) || 'GST no 1' END AS cover_text
        FROM orders""",
    # one page per (order, line number); repeated lines fold into one page
    "bundle_pages": """
        SELECT document_id, page_num, document_id || ':' || cast(page_num AS string) AS page_id,
               'documents/' || document_id || '/pages/page_' || lpad(cast(page_num AS string), 3, '0') || '.png' AS s3_key,
               CASE WHEN q < 8 THEN 'blank' WHEN q < 20 THEN 'form' WHEN q < 40 THEN NULL ELSE 'certificate' END AS page_type,
               CASE rf WHEN 'A' THEN 'Latin' WHEN 'N' THEN 'Devanagari' ELSE 'Han' END AS osd_script,
               round(tax * 100, 4) AS osd_conf, cast((page_num * 90) % 450 AS int) AS osd_rotate,
               round(disc * 1000, 4) AS confidence_score,
               cast(600 + page_num AS int) AS width, cast(400 + page_num AS int) AS height, q, rf, ls
        FROM (SELECT cast(l_orderkey AS string) AS document_id, cast(l_linenumber AS bigint) AS page_num,
                     max(l_quantity) AS q, max(l_returnflag) AS rf, max(l_linestatus) AS ls, max(l_tax) AS tax, max(l_discount) AS disc
              FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    # the same keys unfolded: repeated (document_id, page_num) with an order to resolve them by
    "bundle_pages_raw": """
        SELECT cast(l_orderkey AS string) AS document_id, cast(l_linenumber AS bigint) AS page_num, l_extendedprice AS payload,
               l_partkey * 100000000 + cast(round(l_extendedprice * 100) AS bigint) AS seq
        FROM lineitem""",
    "page_texts": """
        SELECT document_id, page_num, s3_key, page_type,
               CASE WHEN q < 15 THEN '' WHEN q < 30 THEN 'Receipt no ' || cast(page_num AS string)
                    ELSE 'Dear Sir, Subject: page ' || cast(page_num AS string) END AS layer_text,
               CASE WHEN q < 10 THEN '' ELSE 'Register Book folio ' || cast(page_num AS string) END AS ocr_text
        FROM bundle_pages""",
    # token text is misspelt where confidence is low
    "ocr_tokens": """
        SELECT cast(l_orderkey AS string) AS document_id, cast(l_linenumber AS bigint) AS page_num,
               CASE WHEN l_discount >= 0.07 THEN p_name WHEN l_linenumber % 3 = 0 THEN replace(p_name, 'e', '3')
                    WHEN l_linenumber % 3 = 1 THEN substring(p_name, 2) ELSE p_name || 'qqq' END AS text,
               round(l_discount * 1000, 4) AS conf, cast(l_partkey AS bigint) AS token_id
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # documents with registration text and an applicant context in varying quality
    "applicants": f"""
        SELECT cast(o_orderkey AS string) AS document_id,
               CASE WHEN o_orderkey % 6 = 5 THEN 'letter' ELSE 'practitioner' END AS document_category,
               CASE o_orderkey % 5 WHEN 0 THEN 'I-' || lpad(cast(o_custkey AS string), 5, '0') WHEN 1 THEN cast(o_custkey AS string)
                 WHEN 2 THEN 'Reg. No 9' || lpad(cast(o_custkey AS string), 8, '0') WHEN 3 THEN NULL ELSE 'unreadable' END AS registration_no_raw,
               CASE o_orderkey % 7 WHEN 0 THEN {_NAME} WHEN 1 THEN replace(replace({_NAME}, 'customer', 'cust0mer'), 'subramaniam', 'zubramanian')
                 WHEN 2 THEN substring({_NAME}, 10) || ' customer' WHEN 3 THEN replace(replace({_NAME}, 'customer', 'kustomr'), 'venkata', 'benkadha')
                 WHEN 4 THEN replace({_NAME}, 'customer', 'clistonner') WHEN 5 THEN upper({_NAME}) ELSE NULL END AS applicant_name_raw,
               CASE WHEN o_orderkey % 11 = 0 THEN DATE '1960-01-01' + cast((c_custkey + 1) % 15000 AS int)
                 WHEN o_orderkey % 13 = 0 THEN NULL ELSE {_BIRTH} END AS dob
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "belongs_to": """
        SELECT cast(o_orderkey AS string) AS document_id, cast(o_custkey AS bigint) AS registration_no FROM orders""",
    # every page carries a vector
    "page_vectors": """
        SELECT document_id, page_num, vec_id, label, embedding
        FROM (SELECT document_id, page_num, (cast(document_id AS bigint) * 7 + page_num) % (SELECT max(vec_id) + 1 FROM embeddings) AS vec FROM bundle_pages)
             JOIN embeddings ON vec = vec_id""",
    "person_queries": f"""
        SELECT cast(c_custkey AS bigint) AS query_id, cast(c_custkey % (SELECT max(vec_id) + 1 FROM embeddings) AS bigint) AS query_vec,
               CASE c_custkey % 8 WHEN 6 THEN 'documents of ' || replace(c_name, '#', ' ') || {_TAIL}
                 WHEN 7 THEN 'all receipts, DOB ' || cast(day(d) AS string) || ' ' || substring('{_MONTHS}', 3 * month(d) - 2, 3) || ' ' || cast(year(d) AS string)
                 ELSE 'documents of ' || replace(c_name, '#', ' ') || {_TAIL} || ', DOB ' || cast(day(d) AS string) || ' ' || substring('{_MONTHS}', 3 * month(d) - 2, 3) || ' ' || cast(year(d) AS string) END AS query_text
        FROM (SELECT *, {_BIRTH} AS d FROM customer)""",
    "entity_texts": f"""
        SELECT cast(o_orderkey AS string) AS document_id, cast(1 + o_custkey % 7 AS bigint) AS page_num,
               'Applicant I-' || lpad(cast(o_custkey AS string), 5, '0') || ' form AMR-MCH-26-A-' || lpad(cast(o_orderkey % 100000 AS string), 5, '0')
                 || ' dated ' || {_DMY.format(d="o_orderdate")}
                 || ' phone 98' || lpad(cast(o_custkey AS string), 8, '0')
                 || CASE WHEN o_orderkey % 5 = 0 THEN ' and 31/02/2020, again I-' || lpad(cast(o_custkey AS string), 5, '0') ELSE '' END AS raw_text
        FROM orders""",
    # document rows with some values outside their enumerations and ranges
    "document_states": """
        SELECT cast(o_orderkey AS string) AS document_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'practitioner' WHEN '2-HIGH' THEN 'letter' WHEN '3-MEDIUM' THEN 'receipt'
                 WHEN '4-NOT SPECIFIED' THEN 'bogus_category' ELSE 'other' END AS document_category,
               CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'received' ELSE 'in_flight' END AS status,
               CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'pending' WHEN 2 THEN 'matched' WHEN 3 THEN 'lost' ELSE 'unmatched' END AS match_status,
               cast(o_orderkey % 6 - 1 AS bigint) AS page_count, (o_orderkey % 13) / 10.0 AS confidence,
               CASE WHEN o_orderkey % 5 = 2 THEN cast(o_custkey AS bigint) END AS reference_data_id,
               CASE o_orderpriority WHEN '2-HIGH' THEN '{"sender_org":"Office ' || cast(o_custkey % 40 AS string) || '","referenced_registration_nos":["' || cast(o_custkey AS string) || '","' || cast(o_custkey + 1 AS string) || '"]}'
                 WHEN '3-MEDIUM' THEN '{"vendor_name":"Vendor ' || cast(o_custkey % 60 AS string) || '","amount":12500.0}' ELSE '{}' END AS metadata
        FROM orders""",
    "component_measurements": """
        SELECT cast(l_orderkey % 500 AS string) AS page_id, 400 AS page_h, cast(l_quantity AS bigint) AS height,
               cast(l_linenumber * 3 AS bigint) AS area, l_tax * 50 + 0.5 AS stroke
        FROM lineitem""",
}

# views a view is built on
_USES = {"page_texts": ("bundle_pages",), "page_vectors": ("bundle_pages",)}


def view(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A driver table or a derived view as a DataFrame; ``wide`` spreads few-file tables."""
    if name in TABLES:
        scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(scan) if wide else scan
    needed = {n: view(spark, sf_dir, n, wide) for n in (*TABLES, *_USES.get(name, ())) if _mentions(VIEWS[name], n)}
    return spark.sql(_templated(VIEWS[name], needed), **needed)


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) is not None


def _templated(text: str, needed: dict[str, DataFrame]) -> str:
    text = text.replace("{", "{{").replace("}", "}}")
    for name in needed:
        text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
    return text


def with_views(sql: str, *names: str) -> str:
    """SQL check text with the views it needs put in front."""
    ordered: list[str] = []
    for name in names:
        for dep in (*_USES.get(name, ()), name):
            if dep not in ordered:
                ordered.append(dep)
    if not ordered:
        return sql
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    body = sql.strip()
    if body[:15].upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[14:].lstrip()}"
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:].lstrip()}"
    return f"WITH {heads} {body}"

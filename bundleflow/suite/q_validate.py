"""Registered queries: filters, predicates, validation, set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import to_int4
from ..operators import postings as P
from ..operators import validate as V
from ..operators.classify import text_layer_too_short
from ..operators.merge import update_fields
from ..schemas import EXPECTED_COLUMNS
from .q_sources import MANIFEST_PAGES, RUN_TS, manifests
from .registry import case


@case("get_document", "SELECT document_id, document_category, status FROM document_states WHERE document_id = '42'", "document_states")
def _(t):
    return V.get_document(t("document_states"), "42").select("document_id", "document_category", "status")


@case("get_page", "SELECT page_id, page_type, q FROM bundle_pages WHERE document_id = '42' AND page_num = (SELECT min(page_num) FROM bundle_pages WHERE document_id = '42' AND page_num = 1)", "bundle_pages")
def _(t):
    return V.get_page(t("bundle_pages"), "42", 1).select("page_id", "page_type", "q")


@case("check_enums", """SELECT document_id, 'document_category' AS violation FROM document_states WHERE document_category NOT IN ('practitioner','letter','receipt','record','other')
    UNION ALL SELECT document_id, 'status' FROM document_states WHERE status NOT IN ('received','processing','processed','failed','manual_review')
    UNION ALL SELECT document_id, 'match_status' FROM document_states WHERE match_status NOT IN ('pending','matched','unmatched','not_applicable','manual_review')""",
      "document_states")
def _(t):
    return V.check_enums(t("document_states"), ["document_id"])


@case("check_ranges", """SELECT document_id, 'page_count' AS violation FROM document_states WHERE page_count < 0
    UNION ALL SELECT document_id, 'confidence' FROM document_states WHERE confidence < 0 OR confidence > 1""", "document_states")
def _(t):
    return V.check_ranges(t("document_states"), ["document_id"])


@case("check_manifest", f"""WITH {MANIFEST_PAGES},
    m AS (SELECT cast(o_orderkey AS string) AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN sha256(cast(o_orderkey AS string)) ELSE cast(o_orderkey AS string) END AS manifest_id,
          o_orderkey % 4 AS n, o_orderkey AS k FROM orders)
    SELECT manifest_id AS document_id, 'document_id' AS violation FROM m WHERE k % 3 <> 0
    UNION ALL SELECT manifest_id, 'page_count' FROM m WHERE n = 0
    UNION ALL SELECT manifest_id, 'schema_version' FROM m WHERE k % 23 = 0
    UNION ALL SELECT manifest_id, 'page_size' FROM m WHERE n > 0 AND k % 19 = 0""", "bundles")
def _(t):
    # heights become 1, 2, … where the page list was made with a deduction, so shift them to 0 and below
    m = manifests(t).withColumn(
        "pages", F.transform("pages", lambda p: p.withField("height", F.when(p["height"] < 100, F.lit(0)).otherwise(p["height"])))
    )
    number = F.col("document_id").cast("bigint")
    m = m.withColumn("document_id", F.when(F.pmod(number, F.lit(3)) == 0, F.sha2("document_id", 256)).otherwise(F.col("document_id")))
    return V.check_manifest(m)


@case("check_unique", "SELECT document_id, page_num, count(*) AS n FROM bundle_pages_raw GROUP BY 1, 2 HAVING count(*) > 1", "bundle_pages_raw")
def _(t):
    return V.check_unique(t("bundle_pages_raw"), ["document_id", "page_num"])


@case("check_foreign_key", """SELECT document_id, registration_no FROM belongs_to WHERE registration_no NOT IN
    (SELECT cast(trunc(cast(trim(registration_no) AS double)) AS bigint) FROM registry_raw WHERE regexp_matches(trim(registration_no), '^[0-9.e]+$') AND registration_no <> '21474836480')""",
      ("belongs_to", "registry_raw"))
def _(t):
    registry = t("registry_raw").select(to_int4(F.col("registration_no")).cast("bigint").alias("key")).filter("key IS NOT NULL")
    return V.check_foreign_key(t("belongs_to"), registry, "registration_no", "key").select("document_id", "registration_no")


_PRESENT = ("document_id", "document_category", "status", "match_status", "page_count", "reference_data_id", "metadata")


@case("check_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {'true' if c in _PRESENT else 'false'} AS present, {f'count({c})' if c in _PRESENT else 'cast(0 AS bigint)'} AS filled_rows FROM document_states"
    + ("" if c in _PRESENT else " HAVING count(*) > 0")
    for c in EXPECTED_COLUMNS["documents"]), "document_states")
def _(t):
    return V.check_schema(t("document_states"), EXPECTED_COLUMNS["documents"])


@case("partial_predicate", "SELECT page_id, page_type FROM bundle_pages WHERE page_type IS NOT NULL", "bundle_pages")
def _(t):
    return V.partial_predicate(t("bundle_pages"), "page_type").select("page_id", "page_type")


@case("by_status", "SELECT document_id FROM document_states WHERE status = 'received'", "document_states")
def _(t):
    return V.by_values(t("document_states"), status="received").select("document_id")


@case("by_category", "SELECT document_id, status FROM document_states WHERE document_category IN ('letter', 'receipt') AND status = 'processed'", "document_states")
def _(t):
    return V.by_values(t("document_states"), document_category=["letter", "receipt"], status="processed").select("document_id", "status")


@case("json_contains", """SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'""")
def _(t):
    return t("events").filter(V.json_contains(F.col("props"), "$.k", "69")).select("event_id")


@case("json_postings", """SELECT q.event_id, count(e.event_id) AS n_rows
    FROM events q LEFT JOIN events e ON json_extract_string(e.props, '$.k') = json_extract_string(q.props, '$.k') WHERE q.event_id % 50 = 0 GROUP BY 1""")
def _(t):
    """The properties of every fiftieth event are looked for in all events."""
    events = t("events").select("event_id", "props")
    return P.count_containing(events, events.filter("event_id % 50 = 0"), "props", "event_id")


@case("json_array_contains", """SELECT document_id FROM document_states WHERE list_contains(cast(json_extract(metadata, '$.referenced_registration_nos') AS string[]), '100')
    UNION ALL SELECT document_id || '/v' FROM document_states WHERE json_extract_string(metadata, '$.vendor_name') = 'Vendor 5'""", "document_states")
def _(t):
    d = t("document_states")
    letters = d.filter(V.json_array_contains(F.col("metadata"), "$.referenced_registration_nos", "100")).select("document_id")
    vendors = d.filter(V.json_contains(F.col("metadata"), "$.vendor_name", "Vendor 5"))
    return letters.union(vendors.select(F.concat("document_id", F.lit("/v"))))


@case("text_layer_too_short", "SELECT document_id, page_num, length(trim(layer_text)) < 30 AS too_short FROM page_texts", "page_texts")
def _(t):
    return t("page_texts").select("document_id", "page_num", text_layer_too_short(F.col("layer_text")).alias("too_short"))


@case("non_blank_pages", "SELECT page_id, page_type FROM bundle_pages WHERE page_type IS DISTINCT FROM 'blank'", "bundle_pages")
def _(t):
    return t("bundle_pages").filter(V.non_blank(F.col("page_type"))).select("page_id", "page_type")


@case("update_whitelist", "SELECT document_id, CASE WHEN status = 'in_flight' THEN 'processing' ELSE status END AS status FROM document_states", "document_states")
def _(t):
    """Every refused column is refused at plan time; the allowed patch goes through."""
    docs = t("document_states").withColumn("updated_at", F.lit(RUN_TS))
    patch = docs.filter("status = 'in_flight'").select("document_id", F.lit("processing").alias("status"), "page_count", "updated_at")
    for refused in ("page_count", "updated_at"):
        try:
            update_fields(docs, patch.select("document_id", refused), RUN_TS)
        except ValueError:
            continue
        raise AssertionError(f"{refused} was accepted")
    return update_fields(docs, patch.select("document_id", "status"), RUN_TS).select("document_id", "status")


@case("vector_dim_check", "SELECT vec_id, len(embedding) = 64 AS ok FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.vector_dim_check(t("embeddings"), "embedding", 64).alias("ok"))


@case("missing_names", "SELECT DISTINCT document_id FROM bundles EXCEPT SELECT document_id FROM bundle_pages", ("bundles", "bundle_pages"))
def _(t):
    return V.missing_names(t("bundles").select("document_id"), t("bundle_pages").select("document_id"))


@case("contains_all", """SELECT document_id, coalesce(bool_or(page_type = 'form'), false) AND coalesce(bool_or(page_type = 'certificate'), false) AS complete
    FROM bundle_pages GROUP BY 1""", "bundle_pages")
def _(t):
    return V.contains_all(t("bundle_pages"), "document_id", "page_type", ["form", "certificate"])

"""Registered queries: joins and registry matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import merge as G
from ..operators.entities import entity_table
from ..operators.graph import graph_walk
from ..operators.retrieve import hydrate, rank_documents
from ..operators.route import pages_any
from ..operators.vectors import filtered_candidates
from .q_entities import ENTITIES
from .registry import case

_KEY = "try_cast(nullif(regexp_replace(registration_no_raw, '[^0-9]', '', 'g'), '') AS integer)"
_SORTED = "array_to_string(list_sort(list_filter(string_split_regex(lower(coalesce({c}, '')), '\\s+'), lambda w: w <> '')), ' ')"

EXACT = f"""exact AS (SELECT a.*, CASE WHEN a.document_category = 'practitioner' THEN p.registration_no END AS reference_data_id,
      CASE WHEN a.document_category <> 'practitioner' THEN 'not_applicable' WHEN p.registration_no IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS match_status
    FROM (SELECT *, {_KEY} AS reg_key FROM applicants) a LEFT JOIN person p ON a.reg_key = p.registration_no)"""
# every context against every person of the same birth date, or of the same name
FUZZY = f"""contexts AS (SELECT DISTINCT {_SORTED.format(c='applicant_name_raw')} AS name, strftime(dob, '%Y%m%d') AS dob
      FROM open_docs WHERE dob IS NOT NULL AND {_SORTED.format(c='applicant_name_raw')} <> ''),
    people AS (SELECT {_SORTED.format(c='full_name')} AS name, strftime(dob, '%Y%m%d') AS dob, registration_no FROM person),
    pairs AS (SELECT c.name, c.dob, p.registration_no, levenshtein(c.name, p.name) AS edits, greatest(length(c.name), length(p.name)) AS len
        FROM contexts c JOIN people p ON c.dob = p.dob
      UNION ALL SELECT c.name, c.dob, p.registration_no, levenshtein(c.dob, p.dob), greatest(length(c.name), 8)
        FROM contexts c JOIN people p ON c.name = p.name),
    scored AS (SELECT *, 100.0 * (1 - cast(edits AS double) / len) AS score FROM pairs),
    best AS (SELECT name, dob, registration_no, score FROM (SELECT *, row_number() OVER (PARTITION BY name, dob ORDER BY score DESC, registration_no) AS rn
        FROM scored WHERE score >= 85.0) WHERE rn = 1)"""


_LIKE = "100.0 * (1 - cast(levenshtein({a}, {b}) AS double) / greatest(length({a}), length({b})))"
_SPELT = "spelt AS (SELECT document_id, lower(coalesce(applicant_name_raw, '')) AS a, lower(full_name) AS b FROM applicants JOIN belongs_to USING (document_id) JOIN person USING (registration_no))"
_PARTIAL = """part AS (SELECT document_id, a, b, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM spelt),
    partial AS (SELECT document_id, a, b, CASE WHEN s = '' AND l = '' THEN 100.0 WHEN s = '' THEN 0.0
      ELSE list_max(list_transform(range(1, length(l) - length(s) + 2), lambda i: 100.0 * (1 - cast(levenshtein(s, substring(l, i, length(s))) AS double) / length(s)))) END AS p FROM part)"""
_RATIO = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 100.0 ELSE " + _LIKE.format(a="a", b="b") + " END"
_TOKENS = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 100.0 ELSE " + _LIKE.format(a=_SORTED.format(c="a"), b=_SORTED.format(c="b")) + " END"


def _spelt(t):
    pairs = t.wide("applicants").join(t("belongs_to"), "document_id").join(t("person"), "registration_no")
    return pairs.select("document_id", F.lower(F.coalesce("applicant_name_raw", F.lit(""))).alias("a"), F.lower("full_name").alias("b"))


@case("ratio", f"WITH {_SPELT} SELECT document_id, round({_RATIO}, 6) AS score FROM spelt", ("applicants", "belongs_to", "person"))
def _(t):
    return _spelt(t).select("document_id", F.round(M.ratio(F.col("a"), F.col("b")), 6).alias("score"))


@case("partial_ratio", f"WITH {_SPELT}, {_PARTIAL} SELECT document_id, round(p, 6) AS score FROM partial", ("applicants", "belongs_to", "person"))
def _(t):
    return _spelt(t).select("document_id", F.round(M.partial_ratio(F.col("a"), F.col("b")), 6).alias("score"))


@case("weighted_ratio", f"""WITH {_SPELT}, {_PARTIAL}, f AS (SELECT *, least(length(a), length(b)) AS lo, greatest(length(a), length(b)) AS hi FROM partial)
    SELECT document_id, round(greatest({_RATIO}, 0.95 * {_TOKENS}, p * CASE WHEN hi < 1.5 * lo THEN 0.0 WHEN hi <= 8 * lo THEN 0.9 ELSE 0.6 END), 6) AS score FROM f""",
      ("applicants", "belongs_to", "person"))
def _(t):
    return _spelt(t).select("document_id", F.round(M.weighted_ratio(F.col("a"), F.col("b")), 6).alias("score"))


def registry(t):
    return t.wide("person").select("registration_no", "full_name", "dob", F.col("registration_no").alias("reference_data_id"))


@case("match_registry_exact", f"WITH {EXACT} SELECT document_id, reference_data_id, match_status FROM exact", ("applicants", "person"))
def _(t):
    return M.match_registry_exact(t.wide("applicants"), registry(t)).select("document_id", "reference_data_id", "match_status")


@case("match_registry_fuzzy", f"WITH open_docs AS (SELECT * FROM applicants), {FUZZY} SELECT name, dob, registration_no AS reference_data_id, round(score, 6) AS score FROM best",
      ("applicants", "person"))
def _(t):
    found = M.match_registry_fuzzy(t.wide("applicants"), registry(t))
    return found.select(F.col("_name").alias("name"), F.col("_dob").alias("dob"), "reference_data_id", F.round("score", 6).alias("score"))


@case("match_registry", f"""WITH {EXACT}, open_docs AS (SELECT * FROM exact WHERE match_status = 'unmatched'), {FUZZY}
    SELECT e.document_id, coalesce(e.reference_data_id, b.registration_no) AS reference_data_id,
      CASE WHEN b.registration_no IS NOT NULL THEN 'matched' WHEN e.match_status = 'unmatched' THEN 'manual_review' ELSE e.match_status END AS match_status,
      CASE WHEN b.registration_no IS NOT NULL THEN 'fuzzy' WHEN e.match_status = 'matched' THEN 'exact' END AS match_method
    FROM exact e LEFT JOIN best b ON e.match_status = 'unmatched' AND {_SORTED.format(c='e.applicant_name_raw')} = b.name AND strftime(e.dob, '%Y%m%d') = b.dob""",
      ("applicants", "person"))
def _(t):
    return M.match_registry(t.wide("applicants"), registry(t)).select("document_id", "reference_data_id", "match_status", "match_method")


_NAMED = FUZZY[: FUZZY.index("    pairs AS (")].replace("open_docs", "applicants") + """    pairs AS (SELECT c.name, c.dob, p.registration_no, c.name AS a, p.name AS b FROM contexts c JOIN people p ON c.dob = p.dob AND p.name <> ''),"""
_NEAREST = """best AS (SELECT name, dob, registration_no, score FROM (SELECT *, row_number() OVER (PARTITION BY name, dob ORDER BY score DESC, registration_no) AS rn
        FROM scored WHERE score >= 85.0) WHERE rn = 1)
    SELECT name, dob, registration_no AS reference_data_id, round(score, 6) AS score FROM best"""
# bits of the places of a that are still open, letter by letter of b; names are below 60 letters
_OPEN = """list_reduce(list_prepend((1::BIGINT << length(a)) - 1, list_transform(range(1, length(b) + 1), lambda j:
      coalesce(list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = b[j] THEN 1::BIGINT << (i - 1) ELSE 0 END)), 0)::BIGINT)),
      lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(a)) - 1))"""


def _by_name(t, measure: str):
    found = M.match_registry_names(t.wide("applicants"), registry(t), measure)
    return found.select(F.col("_name").alias("name"), "dob", "reference_data_id", F.round("score", 6).alias("score"))


@case("match_registry_partial", f"""WITH {_NAMED}
    sides AS (SELECT *, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM pairs),
    scored AS (SELECT *, list_max(list_transform(range(1, length(l) - length(s) + 2), lambda i: 100.0 * (1 - cast(levenshtein(s, substring(l, i, length(s))) AS double) / length(s)))) AS score FROM sides),
    {_NEAREST}""", ("applicants", "person"))
def _(t):
    return _by_name(t, "partial")


@case("match_registry_indel", f"""WITH {_NAMED}
    edited AS (SELECT *, length(a) + length(b) AS len, length(b) - length(a) + 2 * bit_count({_OPEN}) AS edits FROM pairs),
    scored AS (SELECT *, 100.0 * (1 - cast(edits AS double) / len) AS score FROM edited),
    {_NEAREST}""", ("applicants", "person"))
def _(t):
    return _by_name(t, "indel")


@case("token_sort_similarity", f"""SELECT document_id, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 100.0
      ELSE 100.0 * (1 - cast(levenshtein(x, y) AS double) / greatest(length(x), length(y))) END, 6) AS similarity
    FROM (SELECT a.document_id, {_SORTED.format(c='a.applicant_name_raw')} AS x, {_SORTED.format(c='p.full_name')} AS y
          FROM applicants a JOIN belongs_to b ON a.document_id = b.document_id JOIN person p ON b.registration_no = p.registration_no)""",
      ("applicants", "belongs_to", "person"))
def _(t):
    pairs = t.wide("applicants").join(t("belongs_to"), "document_id").join(t("person").select("registration_no", "full_name"), "registration_no")
    s = M.token_sort_similarity(F.col("applicant_name_raw"), F.col("full_name"))
    return pairs.select("document_id", F.round(s, 6).alias("similarity"))


@case("filtered_candidates", """SELECT document_id, page_num, vec_id FROM page_vectors WHERE document_id IN
    (SELECT document_id FROM bundles WHERE document_category = 'letter')""", ("page_vectors", "bundles"))
def _(t):
    wanted = t("bundles").filter("document_category = 'letter'")
    return filtered_candidates(t("page_vectors"), wanted).select("document_id", "page_num", "vec_id")


@case("graph_walk", f"""WITH {ENTITIES} SELECT p.registration_no, p.full_name, e.document_id, e.page_num, e.type, e.value
    FROM person p JOIN belongs_to b ON p.registration_no = b.registration_no JOIN bundle_pages g ON g.document_id = b.document_id
    JOIN entities e ON e.document_id = g.document_id AND e.page_num = g.page_num""", ("person", "belongs_to", "bundle_pages", "entity_texts"))
def _(t):
    walk = graph_walk(t("person"), t("belongs_to"), t("bundle_pages"), entity_table(t.wide("entity_texts")))
    return walk.select("registration_no", "full_name", "document_id", "page_num", "type", "value")


_SCORED_PAGES = "scored AS (SELECT b.registration_no AS query_id, p.document_id, p.page_num, p.confidence_score AS score FROM bundle_pages p JOIN belongs_to b ON p.document_id = b.document_id)"
_RANKED = f"""{_SCORED_PAGES}, best AS (SELECT query_id, document_id, max(score) AS score, min(page_num) FILTER (rk = 1) AS page_num
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, page_num) AS rk FROM scored) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS doc_rank FROM best)"""


def scored_pages(t):
    return t("bundle_pages").join(t("belongs_to"), "document_id").select(
        F.col("registration_no").alias("query_id"), "document_id", "page_num", F.col("confidence_score").alias("score")
    )


@case("rank_documents", f"WITH {_RANKED} SELECT query_id, document_id, score, page_num, doc_rank FROM ranked", ("bundle_pages", "belongs_to"))
def _(t):
    return rank_documents(scored_pages(t))


@case("hydrate", f"""WITH {_RANKED} SELECT r.query_id, r.doc_rank, r.document_id, r.page_num, r.score, d.status, d.document_category, p.page_type, p.s3_key
    FROM ranked r JOIN document_states d ON r.document_id = d.document_id JOIN bundle_pages p ON p.document_id = r.document_id AND p.page_num = r.page_num""",
      ("bundle_pages", "belongs_to", "document_states"))
def _(t):
    docs = t("document_states").select("document_id", "status", "document_category")
    return hydrate(rank_documents(scored_pages(t)), docs, t("bundle_pages").select("document_id", "page_num", "page_type", "s3_key"))


@case("cascade_delete", """SELECT 'document' AS kind, document_id AS id FROM document_states WHERE status <> 'in_flight'
    UNION ALL SELECT 'page', page_id FROM bundle_pages WHERE document_id NOT IN (SELECT document_id FROM document_states WHERE status = 'in_flight')""",
      ("document_states", "bundle_pages"))
def _(t):
    docs = t("document_states")
    kept, pages = G.cascade_delete(docs, t("bundle_pages"), docs.filter("status = 'in_flight'"))
    return kept.select(F.lit("document").alias("kind"), F.col("document_id").alias("id")).union(pages.select(F.lit("page"), "page_id"))


@case("set_null_delete", """SELECT document_id, CASE WHEN reference_data_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN reference_data_id END AS reference_data_id
    FROM document_states""", "document_states")
def _(t):
    ids = t("customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return G.set_null_delete(t("document_states"), ids, ids.filter("c_acctbal < 0"))[0].select("document_id", "reference_data_id")


@case("pages_any", """SELECT p.page_id FROM bundle_pages p WHERE EXISTS (SELECT 1 FROM entity_texts e WHERE e.document_id = p.document_id AND e.page_num = p.page_num)""",
      ("bundle_pages", "entity_texts"))
def _(t):
    return pages_any(t("bundle_pages"), t.wide("entity_texts")).select("page_id")



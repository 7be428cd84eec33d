"""Registered queries: graph, vectors, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import graph as G
from ..operators import retrieve as R
from ..operators import vectors as V
from ..operators.entities import entity_table, entity_types_payload
from ..operators.match import match_registry_exact
from .q_entities import ENTITIES
from .q_joins import EXACT, registry
from .registry import case


def _entities(t):
    return entity_table(t.wide("entity_texts"))


def nodes(t):
    return G.graph_nodes(t("document_states"), t("bundle_pages"), t("person"), _entities(t))


def edges(t):
    belongs = t("belongs_to").select("document_id", F.col("registration_no").cast("string").alias("person_key"))
    return G.graph_edges(t("bundle_pages"), _entities(t), belongs, match_registry_exact(t("applicants"), registry(t)))


_NODE_SQL = """SELECT 'Document' AS label, document_id AS k FROM document_states UNION ALL SELECT 'Page', page_id FROM bundle_pages
    UNION ALL SELECT 'Person', cast(registration_no AS string) FROM person UNION ALL SELECT DISTINCT 'Entity', type || '/' || value FROM entities
    UNION ALL SELECT DISTINCT 'Organization', json_extract_string(metadata, '$.sender_org') FROM document_states WHERE document_category = 'letter'
    UNION ALL SELECT DISTINCT 'Vendor', json_extract_string(metadata, '$.vendor_name') FROM document_states WHERE document_category = 'receipt'"""
_NODE_VIEWS = ("document_states", "bundle_pages", "person", "entity_texts")
_EDGE_SQL = """SELECT 'HAS_PAGE' AS label, document_id || '>' || page_id AS k FROM bundle_pages
    UNION ALL SELECT 'MENTIONS', document_id || ':' || cast(page_num AS string) || '>' || type || '/' || value FROM entities
    UNION ALL SELECT 'BELONGS_TO', document_id || '>' || cast(registration_no AS string) FROM belongs_to
    UNION ALL SELECT 'MATCHES', document_id || '>' || cast(reference_data_id AS string) FROM exact WHERE reference_data_id IS NOT NULL"""


@case("graph_nodes", f"WITH {ENTITIES} {_NODE_SQL}", _NODE_VIEWS)
def _(t):
    parts = [df.select(F.lit(label).alias("label"), F.concat_ws("/", *G.NODE_KEYS[label]).alias("k")) for label, df in nodes(t).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@case("graph_edges", f"WITH {ENTITIES}, {EXACT} {_EDGE_SQL}", ("bundle_pages", "entity_texts", "belongs_to", "applicants", "person"))
def _(t):
    e = edges(t)
    shown = [
        e["HAS_PAGE"].select(F.lit("HAS_PAGE").alias("label"), F.concat_ws(">", "document_id", "page_id").alias("k")),
        e["MENTIONS"].select(F.lit("MENTIONS").alias("label"), F.concat("page_id", F.lit(">"), "type", F.lit("/"), "value").alias("k")),
        e["BELONGS_TO"].select(F.lit("BELONGS_TO").alias("label"), F.concat_ws(">", "document_id", "person_key").alias("k")),
        e["MATCHES"].select(F.lit("MATCHES").alias("label"), F.concat_ws(">", "document_id", F.col("reference_data_id").cast("string")).alias("k")),
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2]).unionByName(shown[3])


@case("label_counts", f"WITH {ENTITIES} SELECT label, count(*) AS n FROM ({_NODE_SQL}) GROUP BY 1", _NODE_VIEWS)
def _(t):
    return G.label_counts(nodes(t))


@case("graph_constraints", """SELECT 'Document' AS label, count(*) AS violations FROM (SELECT 1 FROM document_states GROUP BY document_id HAVING count(*) > 1)
    UNION ALL SELECT 'Page', count(*) FROM (SELECT 1 FROM bundle_pages_raw GROUP BY document_id, page_num HAVING count(*) > 1)
    UNION ALL SELECT 'Person', count(*) FROM (SELECT 1 FROM person GROUP BY registration_no HAVING count(*) > 1)""", ("document_states", "bundle_pages_raw", "person"))
def _(t):
    """Pages before they are merged, so the constraint has something to find."""
    raw = t("bundle_pages_raw").select(F.concat_ws(":", "document_id", "page_num").alias("page_id"))
    return G.graph_constraints({**nodes(t), "Page": raw})


@case("entity_lookup", f"WITH {ENTITIES} SELECT DISTINCT document_id || ':' || cast(page_num AS string) AS page_id FROM entities WHERE type = 'registration_no' AND value = 'I-00042'", "entity_texts")
def _(t):
    return G.entity_lookup(edges(t)["MENTIONS"], "registration_no", "I-00042")


@case("documents_of_person", "SELECT document_id FROM belongs_to WHERE registration_no IN (SELECT registration_no FROM person WHERE full_name = 'customer 000000042' AND dob = DATE '1960-02-12')", ("belongs_to", "person"))
def _(t):
    return G.documents_of_person(t("person"), t("belongs_to"), "Customer 000000042", "1960-02-12")


@case("co_mentions", f"""WITH {ENTITIES}, m AS (SELECT DISTINCT document_id, type, value FROM entities),
    s AS (SELECT type, value, count(*) AS df, min(document_id) AS hub FROM m GROUP BY 1, 2)
    SELECT m.document_id, count(*) AS entities, count(*) FILTER (df > 1) AS shared_entities, cast(sum(df - 1) AS bigint) AS links, min(hub) AS hub_document
    FROM m JOIN s ON m.type = s.type AND m.value = s.value GROUP BY 1""", "entity_texts")
def _(t):
    return G.co_mentions(_entities(t))


@case("co_mentioned_with", f"""WITH {ENTITIES}, m AS (SELECT DISTINCT document_id, type, value FROM entities)
    SELECT b.document_id, count(*) AS shared FROM m a JOIN m b ON a.type = b.type AND a.value = b.value AND a.document_id = '42' AND b.document_id <> '42' GROUP BY 1""", "entity_texts")
def _(t):
    return G.co_mentioned_with(_entities(t), "42")


@case("co_mentioned_top", f"""WITH {ENTITIES}, m AS (SELECT DISTINCT document_id, type, value FROM entities),
    s AS (SELECT a.document_id, b.document_id AS partner, count(*) AS shared FROM m a JOIN m b ON a.type = b.type AND a.value = b.value AND a.document_id <> b.document_id
      WHERE cast(a.document_id AS bigint) % 50 = 0 GROUP BY 1, 2)
    SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY document_id ORDER BY shared DESC, partner) AS integer) AS rank FROM s) WHERE rank <= 10""", "entity_texts")
def _(t):
    """Every fiftieth document asks for its nearest by shared entities."""
    found = _entities(t)
    return G.co_mentioned_top(found, found.filter(F.col("document_id").cast("long") % 50 == 0))


@case("entity_clusters", f"""WITH RECURSIVE {ENTITIES},
    edges AS (SELECT DISTINCT 'd:' || document_id AS a, 'e:' || type || '/' || value AS b FROM entities),
    both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
    reached(node, cluster) USING KEY (node) AS (
      SELECT DISTINCT a, a FROM both_ways
      UNION SELECT e.b, min(r.cluster) FROM reached r JOIN both_ways e ON e.a = r.node JOIN recurring.reached o ON o.node = e.b
        WHERE r.cluster < o.cluster GROUP BY e.b)
    SELECT node, cluster FROM reached""", "entity_texts")
def _(t):
    links = _entities(t).select(F.concat(F.lit("d:"), "document_id").alias("a"), F.concat(F.lit("e:"), "type", F.lit("/"), "value").alias("b"))
    return G.entity_clusters(links)


_D = "cast({c} AS double[])"
_COS = f"round(list_cosine_similarity({_D.format(c='a.embedding')}, {_D.format(c='b.embedding')}), 6)"


def _first_vector(t):
    return t("embeddings").filter("vec_id = 0").select("embedding").first()["embedding"]


@case("cosine", f"SELECT a.vec_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = (SELECT min(vec_id) FROM embeddings c WHERE c.label = a.label)")
def _(t):
    e = t("embeddings")
    head = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return e.join(head, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("head")), 6).alias("score"))


@case("vector_topk", f"SELECT a.vec_id, {_COS} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return V.vector_topk(t("embeddings"), _first_vector(t))


@case("vector_topk_per_query", f"""WITH asked AS (SELECT cast(vec_id AS bigint) AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT b.query_id, a.vec_id, {_COS} AS score FROM embeddings a, asked b)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def _(t):
    """Every fiftieth vector asks for its nearest among all."""
    asked = t("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return V.vector_topk_per_query(t("embeddings"), asked)


@case("cosine_search", f"""SELECT page_id, score FROM (SELECT a.document_id || ':' || cast(a.page_num AS string) AS page_id, {_COS} AS score
      FROM page_vectors a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE a.document_id IN (SELECT document_id FROM bundles WHERE document_category = 'letter'))
    ORDER BY score DESC, page_id LIMIT 10""", ("page_vectors", "bundles"))
def _(t):
    letters = t("bundles").filter("document_category = 'letter'")
    return V.cosine_search(t("page_vectors"), _first_vector(t), letters, id_col="page_id", row_id=F.concat_ws(":", "document_id", "page_num"))


PARSED = r"""parsed AS (SELECT query_id, query_vec, nullif(lower(regexp_extract(query_text, '(?i)\bdocuments\s+of\s+(.+?)\s*(?:,|$)', 1)), '') AS name,
    cast(try_strptime(nullif(regexp_extract(query_text, '(?i)\bdob\s+(\d{1,2} [a-z]{3} \d{4})\b', 1), ''), '%d %b %Y') AS date) AS dob FROM person_queries)"""
CANDIDATES = """candidates AS (SELECT DISTINCT q.query_id, q.query_vec, b.document_id FROM parsed q JOIN person p ON q.name = p.full_name AND q.dob = p.dob
    JOIN belongs_to b ON b.registration_no = p.registration_no)"""


@case("parse_person_query", f"WITH {PARSED} SELECT query_id, name, strftime(dob, '%Y-%m-%d') AS dob FROM parsed", "person_queries")
def _(t):
    return R.parse_person_query(t("person_queries")).select("query_id", "name", F.date_format("dob", "yyyy-MM-dd").alias("dob"))


@case("candidates", f"WITH {PARSED}, {CANDIDATES} SELECT query_id, document_id FROM candidates", ("person_queries", "person", "belongs_to"))
def _(t):
    return R.candidates(R.parse_person_query(t("person_queries")), t("person"), t("belongs_to"))


def query_vectors(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("query_vec"), F.col("embedding").alias("query_vector"))
    return t("person_queries").join(vectors, "query_vec").select("query_id", "query_vector")


_TOP = f"""pairs AS (SELECT c.query_id, a.document_id, a.page_num, {_COS} AS score
      FROM candidates c JOIN page_vectors a ON a.document_id = c.document_id JOIN embeddings b ON b.vec_id = c.query_vec),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, page_num) AS rn FROM pairs) WHERE rn <= 10),
    best AS (SELECT query_id, document_id, score, page_num FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, page_num) AS rk FROM top) WHERE rk = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS doc_rank FROM best)"""
_RETRIEVAL_VIEWS = ("person_queries", "person", "belongs_to", "page_vectors")


@case("retrieve", f"""WITH {PARSED}, {CANDIDATES}, {_TOP} SELECT r.query_id, r.doc_rank, r.document_id, r.page_num, r.score, d.status, p.page_type, p.s3_key
    FROM ranked r JOIN document_states d ON d.document_id = r.document_id JOIN bundle_pages p ON p.document_id = r.document_id AND p.page_num = r.page_num""",
      (*_RETRIEVAL_VIEWS, "document_states"))
def _(t):
    return R.retrieve(
        t("person_queries"), query_vectors(t), t("person"), t("belongs_to"), t("page_vectors"),
        t("document_states").select("document_id", "status"), t("bundle_pages").select("document_id", "page_num", "page_type", "s3_key"),
    ).select("query_id", "doc_rank", "document_id", "page_num", "score", "status", "page_type", "s3_key")


@case("highlights", f"""WITH {ENTITIES}, {PARSED}, {CANDIDATES}, {_TOP}
    SELECT r.query_id, r.document_id, r.page_num, e.type, e.value FROM ranked r JOIN entities e ON e.document_id = r.document_id AND e.page_num = r.page_num
    JOIN (SELECT query_id, unnest(string_split(name, ' ')) AS w FROM (SELECT query_id, name || ' 0' || substring(name, 14, 5) AS name FROM parsed)) q ON q.query_id = r.query_id
      AND contains(lower(e.value), q.w) GROUP BY ALL""", (*_RETRIEVAL_VIEWS, "entity_texts"))
def _(t):
    parsed = R.parse_person_query(t("person_queries"))
    scored = R.score_pages(R.candidates(parsed, t("person"), t("belongs_to")), query_vectors(t), t("page_vectors"))
    top = V.top_per_group(scored, ["query_id"], 10, [F.desc("score"), F.asc("document_id"), F.asc("page_num")]).drop("rank")
    # names are numbers in these tables; add the short form an entity value carries
    asked = parsed.withColumn("name", F.concat("name", F.lit(" 0"), F.substring("name", 14, 5)))
    return R.highlights(R.rank_documents(top, bounded=True), asked, _entities(t))


@case("payload_snippet", f"""WITH {ENTITIES}, types AS (SELECT document_id, page_num, string_agg(DISTINCT type, ',' ORDER BY type) AS entity_types FROM entities GROUP BY 1, 2)
    SELECT t.document_id, t.page_num, p.page_type, coalesce(y.entity_types, '') AS entity_types, b.registration_no, substring(t.raw_text, 1, 40) AS raw_text_snippet
    FROM entity_texts t JOIN belongs_to b ON b.document_id = t.document_id LEFT JOIN bundle_pages p ON p.document_id = t.document_id AND p.page_num = t.page_num
    LEFT JOIN types y ON y.document_id = t.document_id AND y.page_num = t.page_num""", ("entity_texts", "belongs_to", "bundle_pages"))
def _(t):
    kinds = t("bundle_pages").select("document_id", "page_num", "page_type")
    pages = t.wide("entity_texts").join(t("belongs_to"), "document_id").join(kinds, ["document_id", "page_num"], "left")
    return V.payload_snippet(pages, entity_types_payload(_entities(t)), 40)

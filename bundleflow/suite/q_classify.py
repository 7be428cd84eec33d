"""Registered queries: classification and routing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.rulepacks import (
    BUNDLE_RULES,
    BUNDLE_TYPE_RULES,
    Rule,
    categories_of,
    fired_rules,
    first_type,
    rules_from_table,
    signal_array,
)
from ..functions.plan import fence
from ..operators import classify as K
from ..operators import route as R
from ..operators.rules import scores_by_table
from ..operators.merge import empty_tables
from ..plans.ingest import ingest_manifests
from .q_sources import DECIDED, MANIFEST_PAGES, RUN_TS, classified, manifests
from .registry import case
from .rulesql import hit, ruled_cte, scored_cte

CATEGORIES = categories_of(BUNDLE_RULES)
SCORES = {c: f"score_{c}" for c in CATEGORIES}
_SCORED = scored_cte("bundles", "cover_text")
_RULED = ruled_cte("bundles", "cover_text")


@case("score_text", f"WITH {_SCORED} SELECT document_id, {', '.join(f's_{c} AS score_{c}' for c in CATEGORIES)} FROM scored", "bundles")
def _(t):
    return K.score_text(t.wide("bundles").select("document_id", "cover_text"), "cover_text").drop("cover_text")


_RULE_VALUES = ", ".join(
    "({}, '{}', {}, '(?im){}')".format(i, r.category, r.weight, r.pattern.replace(r"\₹", "₹")) for i, r in enumerate(BUNDLE_RULES)
)


@case("rules_join", f"""SELECT document_id, cast(i AS bigint) AS rule_ord, category, cast(w AS double) AS weight
    FROM bundles, (VALUES {_RULE_VALUES}) r(i, category, w, p) WHERE regexp_matches(lower(cover_text), p)""", "bundles")
def _(t):
    lowered = t.wide("bundles").select("document_id", F.lower("cover_text").alias("low"))
    return fired_rules(lowered, "low", ["document_id"], BUNDLE_RULES)


@case("signals", f"WITH {_RULED} SELECT document_id, r_category AS category, r_signals AS signals FROM ruled WHERE r_category IS NOT NULL", "bundles")
def _(t):
    scored = K.score_text(t.wide("bundles").select("document_id", "cover_text", F.lower("cover_text").alias("low")), "cover_text")
    won = fence(K.with_winner(scored, SCORES), category=F.col("_win.category"))
    labels = F.array_join(signal_array("low", "category", BUNDLE_RULES), " | ")
    return fence(won, signals=labels).filter("category IS NOT NULL").select("document_id", "category", "signals")


@case("top_category", f"WITH {_RULED} SELECT document_id, r_category AS category, round(r_confidence, 6) AS confidence FROM ruled", "bundles")
def _(t):
    scored = K.score_text(t.wide("bundles").select("document_id", "cover_text"), "cover_text")
    won = K.with_winner(scored, SCORES)
    return won.select("document_id", F.col("_win.category").alias("category"), F.round("_win.confidence", 6).alias("confidence"))


@case("first_matching_subtype", f"WITH {_RULED} SELECT document_id, r_type AS document_type FROM ruled", "bundles")
def _(t):
    scored = K.score_text(t.wide("bundles").select("document_id", "cover_text", F.lower("cover_text").alias("low")), "cover_text")
    won = K.with_winner(scored, SCORES).withColumn("category", F.col("_win.category"))
    return won.select("document_id", first_type("low", "category", BUNDLE_TYPE_RULES).alias("document_type"))


@case("classify_text", f"""WITH {_RULED} SELECT document_id, r_category AS category, r_type AS document_type, round(r_confidence, 6) AS confidence,
    coalesce(r_signals, '') AS signals FROM ruled""", "bundles")
def _(t):
    r = F.col("rules_result")
    return K.classify_text(t.wide("bundles").select("document_id", "cover_text"), "cover_text").select(
        "document_id", r["category"].alias("category"), r["document_type"].alias("document_type"),
        F.round(r["confidence"], 6).alias("confidence"), F.coalesce(F.array_join(r["signals"], " | "), F.lit("")).alias("signals"),
    )


@case("manifest_hint", """SELECT document_id, CASE WHEN document_category <> 'other' THEN document_category END AS category,
    CASE WHEN document_category <> 'other' THEN cast(0.85 AS double) END AS confidence,
    CASE WHEN document_category <> 'other' THEN 'manifest.document_category=''' || document_category || '''' END AS signals FROM bundles""", "bundles")
def _(t):
    h = K.manifest_hint(F.col("document_category"))
    return t.wide("bundles").select(
        "document_id", h["document_category"].alias("category"), h["confidence"].alias("confidence"),
        F.array_join(h["signals"], " | ").alias("signals"),
    )


@case("cover_page", """SELECT document_id, page_num, s3_key FROM (SELECT *, row_number() OVER (PARTITION BY document_id
    ORDER BY CASE WHEN page_type = 'blank' THEN 1 ELSE 0 END, page_num) AS rn FROM bundle_pages) WHERE rn = 1""", "bundle_pages")
def _(t):
    return K.cover_page(t("bundle_pages"))


_FIRST3 = """first3 AS (SELECT document_id, string_agg(layer_text, chr(10) ORDER BY page_num) AS cover_text
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_num) AS rn FROM page_texts) WHERE rn <= 3 GROUP BY 1)"""


@case("cover_text_first_n", f"WITH {_FIRST3} SELECT document_id, cover_text FROM first3", "page_texts")
def _(t):
    return K.cover_text_first_n(t("page_texts"))


@case("cover_text", f"""WITH {_FIRST3}, cover AS (SELECT document_id, ocr_text FROM (SELECT *, row_number() OVER (PARTITION BY document_id
      ORDER BY CASE WHEN page_type = 'blank' THEN 1 ELSE 0 END, page_num) AS rn FROM page_texts) WHERE rn = 1)
    SELECT b.document_id, CASE WHEN length(trim(coalesce(f.cover_text, ''), chr(10) || ' ')) < 30 THEN coalesce(c.ocr_text, '') ELSE f.cover_text END
      || CASE WHEN b.qr_content IS NOT NULL THEN chr(10) || 'QR:' || b.qr_content ELSE '' END AS cover_text
    FROM bundles b LEFT JOIN first3 f ON b.document_id = f.document_id LEFT JOIN cover c ON b.document_id = c.document_id""", ("page_texts", "bundles"))
def _(t):
    return K.cover_text(t("page_texts"), t.wide("bundles").select("document_id", "qr_content")).drop("qr_content")


@case("classify_documents", f"""WITH {DECIDED} SELECT document_id, document_category, document_type, round(confidence, 6) AS confidence, method, signals,
    document_category = 'practitioner' AS match_reference_data, false AS skip_ocr FROM decided""", "bundles")
def _(t):
    return classified(t).withColumn("signals", F.array_join("signals", " | ")).withColumn("confidence", F.round("confidence", 6))


def _second_opinion(df):
    @F.pandas_udf("document_category string, document_type string, confidence double")
    def guess(text: pd.Series) -> pd.DataFrame:
        hit = text.str.contains("sticker")
        return pd.DataFrame(
            {"document_category": hit.map({True: "record", False: None}), "document_type": None, "confidence": hit.map({True: 0.7, False: None})}
        )

    g = guess(F.coalesce("cover_text", F.lit("")))
    asked = df.withColumn("_g", g)
    return asked.withColumn("fallback_result", F.when(F.col("_g.document_category").isNotNull(), F.col("_g"))).drop("_g")


@case("llm_fallback_hook", f"""WITH {DECIDED} SELECT document_id,
    CASE WHEN open AND cover_text LIKE '%sticker%' THEN 'record' ELSE document_category END AS document_category,
    CASE WHEN open AND cover_text LIKE '%sticker%' THEN 'llm' ELSE method END AS method,
    CASE WHEN open AND cover_text LIKE '%sticker%' THEN 'llm_fallback' ELSE signals END AS signals
    FROM (SELECT *, method = 'rules' AND trim(cover_text, chr(10) || ' ') <> '' AND coalesce(r_confidence, 0) < 0.55 AS open FROM decided)""", "bundles")
def _(t):
    b = t.wide("bundles").withColumn("cover_text", K.with_qr(F.col("cover_text"), F.col("qr_content")))
    out = K.flatten_result(K.classify_documents(b, fallback=_second_opinion))
    return out.select("document_id", "document_category", "method", F.array_join("signals", " | ").alias("signals"))


@case("route_pages", f"""WITH {DECIDED} SELECT p.page_id, CASE WHEN d.document_category <> 'other' AND p.page_type IS DISTINCT FROM 'blank'
    THEN 'queued' ELSE 'skipped' END AS ocr_status FROM bundle_pages p JOIN decided d ON p.document_id = d.document_id""", ("bundles", "bundle_pages"))
def _(t):
    return R.route_pages(t("bundle_pages"), classified(t), "s3_key").pages.select("page_id", "ocr_status")


@case("document_states", f"""WITH {DECIDED} SELECT document_id, document_category,
    CASE WHEN document_category = 'other' THEN 'manual_review' ELSE 'pending' END AS match_status FROM decided""", "bundles")
def _(t):
    return R.document_states(classified(t))


@case("ingest_counts", f"""WITH {DECIDED} SELECT p.document_id,
      count(*) FILTER (d.document_category <> 'other' AND p.page_type IS DISTINCT FROM 'blank') AS queued,
      count(*) FILTER (p.page_type = 'blank') AS skipped_blank, count(*) AS pages
    FROM bundle_pages p JOIN decided d ON p.document_id = d.document_id GROUP BY 1""", ("bundles", "bundle_pages"))
def _(t):
    return R.ingest_counts(R.route_pages(t("bundle_pages"), classified(t), "s3_key").pages)


INGESTED = f"""{MANIFEST_PAGES}, {DECIDED} SELECT d.document_id, d.document_category,
      CASE WHEN d.document_category = 'other' THEN 'manual_review' ELSE 'pending' END AS match_status,
      count(p.page_num) AS pages,
      count(*) FILTER (p.page_num IS NOT NULL AND d.document_category <> 'other' AND p.page_type IS DISTINCT FROM 'blank') AS queued,
      count(*) FILTER (p.page_num IS NOT NULL AND (d.document_category = 'other' OR p.page_type = 'blank')) AS skipped
    FROM decided d LEFT JOIN manifest_pages p ON d.document_id = p.document_id GROUP BY 1, 2, 3"""


def table_summary(documents, pages):
    per = pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ocr_status") == "queued").alias("queued"),
        F.count_if(F.col("ocr_status") == "skipped").alias("skipped"),
    )
    zero = F.lit(0).cast("bigint")
    return documents.select("document_id", "document_category", "match_status").join(per, "document_id", "left").select(
        "document_id", "document_category", "match_status",
        *[F.coalesce(c, zero).alias(c) for c in ("pages", "queued", "skipped")],
    )


@case("ingest_manifests", f"WITH {INGESTED}", "bundles")
def _(t):
    """Two runs of the same batch, the second on the tables of the first."""
    _, documents, pages = empty_tables(t.spark)
    texts = t.wide("bundles").select("document_id", "cover_text")
    first = ingest_manifests(manifests(t), texts, documents, pages, RUN_TS)
    again = ingest_manifests(manifests(t), texts, first.documents, first.pages, RUN_TS)
    return table_summary(again.documents, again.pages)


# Two neighbouring words of every fiftieth document make a rule; one more rule has no literal.
_PHRASE_RULES = r"""SELECT doc_id AS ord, 'lot ' || cast(doc_id % 7 AS string) AS category, w1 || ' +' || w2 AS pattern, 1.0 + doc_id % 3 AS weight
    FROM (SELECT doc_id, {extract}(low, '([a-z]{4,}) ([a-z]{4,})', 1) AS w1, {extract}(low, '([a-z]{4,}) ([a-z]{4,})', 2) AS w2
      FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE doc_id % 50 = 0)) WHERE w1 <> ''
    UNION ALL SELECT -1, 'digits', '{nine}', 0.5"""


@case("rules_table_join", "WITH rules AS (" + _PHRASE_RULES.replace("{extract}", "regexp_extract").replace("{nine}", r"\d{9,}") + """)
    SELECT d.doc_id, category, cast(sum(weight) AS double) AS score, count(*) AS n_rules
    FROM documents d JOIN rules ON regexp_matches(lower(d.text), pattern) GROUP BY 1, 2""")
def _(t):
    docs = t("documents").select("doc_id", "text")
    rules = t.spark.sql(_PHRASE_RULES.replace("documents", "{documents}").replace("{4,}", "{{4,}}").replace("{extract}", "regexp_extract").replace("'([a-z]", "r'([a-z]").replace("'{nine}'", r"r'\d{{9,}}'"), documents=docs)
    return scores_by_table(docs, "text", ["doc_id"], rules)


@case("rule_packs_as_data", "SELECT doc_id, " + ", ".join(
    f"cast({' + '.join(f'CASE WHEN {hit(p, chr(108) + chr(111) + chr(119))} THEN {w} ELSE 0.0 END' for p, w in rules)} AS double) AS score_{c}"
    for c, rules in {"licence": ((r"\blicen[cs]e", 2.0), (r"\bcopyright\b", 1.0)), "secret": ((r"\b(token|secret|password)\b", 2.0), (r"\d{9,}", 0.5)),
                     "contact": ((r"[a-z0-9.]+@[a-z0-9.]+", 2.0), (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 1.0))}.items())
    + " FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def _(t):
    """A pack kept in a table, compiled at plan time, over the whole document texts."""
    pack = [("licence", r"\blicen[cs]e", 2.0), ("licence", r"\bcopyright\b", 1.0), ("secret", r"\b(token|secret|password)\b", 2.0),
            ("secret", r"\d{9,}", 0.5), ("contact", r"[a-z0-9.]+@[a-z0-9.]+", 2.0), ("contact", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 1.0)]
    rules = rules_from_table(
        t.spark.createDataFrame([(c, p, w, i) for i, (c, p, w) in enumerate(pack)], "category string, pattern string, weight double, ord int")
    )
    assert all(isinstance(r, Rule) for r in rules)
    return K.score_text(t.wide("documents").select("doc_id", "text"), "text", rules).drop("text")

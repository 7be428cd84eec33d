"""Registered queries: OCR tokens, entities, page structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import DEVANAGARI_DIGITS, devanagari_digits
from ..functions.rulepacks import PAGE_RULES, categories_of
from ..operators import entities as E
from ..operators.triage import detect_script, language_of_page
from .registry import case
from .rulesql import scored_cte

ENTITIES = r"""found AS (
      SELECT document_id, page_num, 'date' AS type, strftime(try_strptime(d, '%d/%m/%Y'), '%Y-%m-%d') AS value
        FROM (SELECT document_id, page_num, unnest(regexp_extract_all(raw_text, '\b(\d{2}/\d{2}/\d{4})\b', 1)) AS d FROM entity_texts)
      UNION ALL SELECT document_id, page_num, 'phone', regexp_extract(w, '\d{10}', 0)
        FROM (SELECT document_id, page_num, unnest(string_split_regex(raw_text, '[ ,]+')) AS w FROM entity_texts) WHERE regexp_full_match(w, '\d{10}')
      UNION ALL SELECT document_id, page_num, 'registration_no', unnest(regexp_extract_all(raw_text, '\bI-\d{5,}\b', 0)) FROM entity_texts
      UNION ALL SELECT document_id, page_num, 'application_no', unnest(regexp_extract_all(raw_text, '\bAMR-MCH-26-A-\d{5}\b', 0)) FROM entity_texts),
    entities AS (SELECT DISTINCT document_id, page_num, type, value FROM found WHERE value IS NOT NULL)"""


@case("flag_tokens", "SELECT document_id, page_num, token_id, conf, conf < 70.0 AS low_confidence FROM ocr_tokens", "ocr_tokens")
def _(t):
    return E.flag_tokens(t("ocr_tokens")).select("document_id", "page_num", "token_id", "conf", "low_confidence")


@case("low_confidence_tokens", """SELECT document_id, page_num, count(*) FILTER (conf < 70.0) AS low_tokens, count(*) AS tokens,
    round(cast(count(*) FILTER (conf < 70.0) AS double) / count(*), 6) AS low_ratio FROM ocr_tokens GROUP BY 1, 2""", "ocr_tokens")
def _(t):
    return E.low_confidence_tokens(t("ocr_tokens")).withColumn("low_ratio", F.round("low_ratio", 6))


_MEAN = "mean AS (SELECT document_id, page_num, avg(conf) AS mean_conf FROM ocr_tokens GROUP BY 1, 2)"


@case("page_mean_confidence", f"WITH {_MEAN} SELECT document_id, page_num, round(mean_conf, 6) AS mean_conf, CASE WHEN mean_conf >= 70.0 THEN 'tier1' ELSE 'fallback' END AS route FROM mean",
      "ocr_tokens")
def _(t):
    return E.page_mean_confidence(t("ocr_tokens")).withColumn("mean_conf", F.round("mean_conf", 6))


@case("confidence_route", f"""WITH {_MEAN} SELECT document_id, count(*) AS pages, count(*) FILTER (mean_conf < 70.0) AS fallback_pages,
    CASE WHEN min(mean_conf) < 70.0 THEN 'manual_review' ELSE 'tier1' END AS route FROM mean GROUP BY 1""", "ocr_tokens")
def _(t):
    return E.confidence_route(t("ocr_tokens"))


@case("augment_tokens", """WITH words AS (SELECT DISTINCT lower(p_name) AS word FROM part),
    low AS (SELECT DISTINCT lower(text) AS spelling FROM ocr_tokens WHERE conf < 70.0),
    near AS (SELECT spelling, word, 100.0 * (1 - cast(levenshtein(spelling, word) AS double) / greatest(length(spelling), length(word))) AS score
      FROM low, words),
    best AS (SELECT spelling, word FROM (SELECT *, row_number() OVER (PARTITION BY spelling ORDER BY score DESC, word) AS rn FROM near WHERE score >= 85.0) WHERE rn = 1)
    SELECT document_id, page_num, token_id, CASE WHEN conf < 70.0 THEN coalesce(word, text) ELSE text END AS final_text,
      CASE WHEN conf >= 70.0 THEN 'ocr' WHEN word IS NOT NULL THEN 'augmented' ELSE 'manual_review' END AS source
    FROM ocr_tokens LEFT JOIN best ON conf < 70.0 AND lower(text) = spelling""", "ocr_tokens")
def _(t):
    return E.augment_tokens(t("ocr_tokens"), t("part"), "p_name").select("document_id", "page_num", "token_id", "final_text", "source")


@case("extract_dates", f"WITH {ENTITIES} SELECT document_id, value FROM found WHERE type = 'date' AND value IS NOT NULL", "entity_texts")
def _(t):
    # the same text with Devanagari digits gives the same dates
    shown = F.translate("raw_text", "0123456789", DEVANAGARI_DIGITS)
    return t.wide("entity_texts").select("document_id", F.explode(E.iso_dates(shown)).alias("value"))


@case("extract_phones", f"WITH {ENTITIES} SELECT document_id, value FROM found WHERE type = 'phone'", "entity_texts")
def _(t):
    return t.wide("entity_texts").select("document_id", F.explode(E.phones(F.col("raw_text"))).alias("value"))


@case("extract_ids", f"WITH {ENTITIES} SELECT document_id, type, value FROM found WHERE type LIKE '%_no'", "entity_texts")
def _(t):
    def tagged(kind: str):
        return F.transform(E.ids(F.col("raw_text"), kind), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    return t.wide("entity_texts").select("document_id", F.inline(F.concat(*[tagged(kind) for kind in E.ID_PATTERNS])))


@case("entity_table", f"WITH {ENTITIES} SELECT *, cast(1.0 AS double) AS confidence, 'ocr' AS source FROM entities", "entity_texts")
def _(t):
    return E.entity_table(t.wide("entity_texts"))


@case("structured_json", f"""WITH {ENTITIES} SELECT t.document_id, t.page_num, t.raw_text, count(e.value) AS entities
    FROM entity_texts t LEFT JOIN entities e ON t.document_id = e.document_id AND t.page_num = e.page_num GROUP BY 1, 2, 3""", "entity_texts")
def _(t):
    """The JSON read back: text kept whole, every entity nested."""
    schema = "raw_text string, entities array<struct<type string, value string>>"
    back = E.structured_json(t.wide("entity_texts")).withColumn("j", F.from_json("structured_json", schema))
    return back.select("document_id", "page_num", "j.raw_text", F.size("j.entities").cast("bigint").alias("entities"))


@case("entity_types_payload", f"WITH {ENTITIES} SELECT document_id, page_num, string_agg(DISTINCT type, ',' ORDER BY type) AS entity_types FROM entities GROUP BY 1, 2", "entity_texts")
def _(t):
    return E.entity_types_payload(E.entity_table(t.wide("entity_texts")))


_PAGE_CATS = categories_of(PAGE_RULES)
_PAGE_BEST = "greatest(" + ", ".join(f"s_{c}" for c in _PAGE_CATS) + ")"


@case("page_type_rules", f"""WITH {scored_cte('bundles', 'cover_text', PAGE_RULES)} SELECT document_id, CASE WHEN {_PAGE_BEST} < 1.0 THEN 'other' """
      + " ".join(f"WHEN s_{c} = {_PAGE_BEST} THEN '{c}'" for c in _PAGE_CATS) + " END AS detected_type FROM scored", "bundles")
def _(t):
    return E.page_type_rules(t.wide("bundles").select("document_id", "cover_text"), "cover_text").select("document_id", "detected_type")


_LETTERS = "length(regexp_replace({c}, '[^\\p{{Latin}}]', '', 'g'))", "length(regexp_replace({c}, '[^\\p{{Devanagari}}]', '', 'g'))"
_SCRIPT = """CASE WHEN la + de = 0 THEN 'unknown' WHEN cast(la AS double) / (la + de) BETWEEN 0.2 AND 0.8 THEN 'mixed'
    WHEN cast(la AS double) / (la + de) > 0.5 THEN 'latin' ELSE 'devanagari' END"""
_SHOWN = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'कखगघङचछजझञटठडढणतथदधनपफबभमय') ELSE translate(lower(text), 'aeiou', 'अएइओउ') END"


def _shown(t):
    text = F.col("text")
    deva = F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "कखगघङचछजझञटठडढणतथदधनपफबभमय")
    mixed = F.translate(F.lower(text), "aeiou", "अएइओउ")
    third = F.pmod("doc_id", F.lit(3))
    return t.wide("documents").withColumn("shown", F.when(third == 0, text).when(third == 1, deva).otherwise(mixed))


@case("detect_script", f"SELECT doc_id, {_SCRIPT} AS script FROM (SELECT doc_id, {_LETTERS[0].format(c='s')} AS la, {_LETTERS[1].format(c='s')} AS de FROM (SELECT doc_id, {_SHOWN} AS s FROM documents))")
def _(t):
    return _shown(t).select("doc_id", detect_script(F.col("shown")).alias("script"))


@case("language_of_page", f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'mar' ELSE CASE {_SCRIPT} WHEN 'latin' THEN 'eng' WHEN 'mixed' THEN 'mixed' WHEN 'devanagari' THEN 'dev' ELSE 'unknown' END END AS language
    FROM (SELECT doc_id, {_LETTERS[0].format(c='s')} AS la, {_LETTERS[1].format(c='s')} AS de FROM (SELECT doc_id, {_SHOWN} AS s FROM documents))""")
def _(t):
    hint = F.when(F.pmod("doc_id", F.lit(5)) == 0, "mar")
    return _shown(t).select("doc_id", language_of_page(F.col("shown"), hint).alias("language"))


@case("layout_blocks", r"""SELECT document_id, page_num, line_no - 1 AS line_no, line, CASE WHEN regexp_matches(line, '\t|\S {2,}\S+ {2,}\S') THEN 'table'
      WHEN regexp_matches(line, '^[^:]{1,40}:\s') THEN 'key_value' WHEN line_no = 1 THEN 'header' ELSE 'body' END AS block
    FROM (SELECT document_id, page_num, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no
      FROM (SELECT document_id, cast(1 AS bigint) AS page_num, list_filter(string_split(cover_text, chr(10)), lambda s: trim(s) <> '') AS lines FROM bundles))""", "bundles")
def _(t):
    return E.layout_blocks(t.wide("bundles").select("document_id", F.lit(1).cast("bigint").alias("page_num"), "cover_text"), "cover_text")


@case("devanagari_digits", f"SELECT document_id, raw_text AS text FROM entity_texts", "entity_texts")
def _(t):
    shown = F.translate("raw_text", "0123456789", DEVANAGARI_DIGITS)
    return t.wide("entity_texts").select("document_id", devanagari_digits(shown).alias("text"))

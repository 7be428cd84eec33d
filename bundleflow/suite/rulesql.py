"""SQL text for the classification checks, spelled out from the rule pack."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.rulepacks import BUNDLE_RULES, BUNDLE_TYPE_RULES, Rule, categories_of


def _p(pattern: str) -> str:
    return "'(?im)" + pattern.replace(r"\₹", "₹").replace("'", "''") + "'"


def hit(pattern: str, text: str = "low") -> str:
    return f"regexp_matches({text}, {_p(pattern)})"


def score(category: str, text: str = "low", rules: Sequence[Rule] = BUNDLE_RULES) -> str:
    terms = [f"CASE WHEN {hit(r.pattern, text)} THEN {r.weight} ELSE 0.0 END" for r in rules if r.category == category]
    return "cast(" + " + ".join(terms) + " AS double)"


def signals(category: str, text: str = "low", rules: Sequence[Rule] = BUNDLE_RULES) -> str:
    terms = [
        f"CASE WHEN {hit(r.pattern, text)} THEN '''' || replace(regexp_extract({text}, {_p(r.pattern)}, 0), chr(10), '\\n') || ''' (+{r.weight})' END"
        for r in rules
        if r.category == category
    ]
    return f"concat_ws(' | ', {', '.join(terms)})"


def subtype(category: str, text: str = "low") -> str:
    whens = [f"WHEN {hit(r.pattern, text)} THEN '{r.type_name}'" for r in BUNDLE_TYPE_RULES if r.category == category]
    return f"CASE {' '.join(whens)} END"


def scored_cte(source: str, text: str, rules: Sequence[Rule] = BUNDLE_RULES) -> str:
    """CTEs ``lowered`` and ``scored``: every source column plus one s_<category> each."""
    cats = categories_of(rules)
    columns = ", ".join(f"{score(c, rules=rules)} AS s_{c}" for c in cats)
    return (
        f"lowered AS (SELECT *, lower({text}) AS low FROM {source}), "
        f"scored AS (SELECT *, {columns} FROM lowered)"
    )


def ruled_cte(source: str, text: str, floor: float = 2.0) -> str:
    """CTEs up to ``ruled``: r_category, r_confidence, r_type, r_signals (null when no winner)."""
    cats = categories_of(BUNDLE_RULES)
    names = ", ".join(f"s_{c}" for c in cats)
    pick = " ".join(f"WHEN s_{c} = best THEN '{c}'" for c in cats)
    types = " ".join(f"WHEN '{c}' THEN {subtype(c)}" for c in cats)
    labels = " ".join(f"WHEN '{c}' THEN {signals(c)}" for c in cats)
    return (
        scored_cte(source, text)
        + f", best AS (SELECT *, greatest({names}) AS best, list_sort([{names}], 'DESC')[2] AS runner FROM scored)"
        + f", won AS (SELECT *, CASE WHEN best >= {floor} THEN CASE {pick} END END AS r_category,"
        + f" CASE WHEN best >= {floor} THEN least(best / (best + runner + 1.0), 1.0) END AS r_confidence FROM best)"
        + f", ruled AS (SELECT *, CASE r_category {types} END AS r_type, CASE r_category {labels} END AS r_signals FROM won)"
    )


def decided_cte(source: str, text: str, hint: str = "document_category") -> str:
    """CTEs up to ``decided``: the final result columns per source row."""
    return ruled_cte(source, text) + f""",
    decided AS (SELECT * EXCLUDE ({hint}),
      CASE WHEN {hint} <> 'other' THEN {hint} WHEN trim({text}, chr(10) || ' ') = '' OR r_category IS NULL THEN 'other' ELSE r_category END AS document_category,
      CASE WHEN {hint} <> 'other' OR trim({text}, chr(10) || ' ') = '' THEN NULL ELSE r_type END AS document_type,
      CASE WHEN {hint} <> 'other' THEN 0.85 WHEN trim({text}, chr(10) || ' ') = '' OR r_category IS NULL THEN 0.0 ELSE r_confidence END AS confidence,
      CASE WHEN {hint} <> 'other' THEN 'manifest_hint' ELSE 'rules' END AS method,
      CASE WHEN {hint} <> 'other' THEN 'manifest.document_category=''' || {hint} || ''''
           WHEN trim({text}, chr(10) || ' ') = '' OR r_category IS NULL THEN 'no_signals_matched'
           WHEN r_confidence < 0.55 THEN r_signals || ' | [llm_skipped]' ELSE r_signals END AS signals
      FROM ruled)"""

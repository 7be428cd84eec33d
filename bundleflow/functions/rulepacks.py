"""Weighted keyword rules as data, compiled to Spark columns.

A pack is a tuple of ``Rule``.  Compiling it yields one expression per rule with a literal
pattern, so every task compiles each pattern once and the whole pack is one narrow
projection: no rule table, no join, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    category: str
    pattern: str
    weight: float


class TypeRule(NamedTuple):
    category: str
    pattern: str
    type_name: str


# --- Fixed values: patterns, weights and their order decide results ------------------
MIN_SCORE = 2.0

_CATEGORY_PATTERNS = {
    "practitioner": [
        (r"\bregistration\s*(no|number|no\.)\b", 3.0),
        (r"\bapplication\s*(form|no|number)\b", 3.0),
        (r"\bamr[-\s]mch\b", 3.0),
        (r"\bform\s*[e]\b", 2.5),
        (r"\bprovisional\s*reg", 2.5),
        (r"\binternship\s*cert", 2.0),
        (r"\bbhms\b", 2.0),
        (r"\bbams\b", 2.0),
        (r"\bhomoeo", 1.5),
        (r"\bmarks?\s*statement", 1.5),
        (r"\baadhaar\b", 1.0),
        (r"\bssc\b|\bhsc\b", 0.5),
        (r"\bmarriage\s*cert", 0.5),
        (r"^[a-z]-\d{5,}$", 2.0),
    ],
    "letter": [
        (r"\bdear\s+(sir|madam|dr\.?)\b", 3.0),
        (r"\byours?\s*(faithfully|sincerely|truly)", 2.5),
        (r"\bsubject\s*:", 2.0),
        (r"\bgovernment\s+of\s+(maharashtra|india)", 2.0),
        (r"\bnational\s*commission", 2.0),
        (r"\bnch\b", 1.5),
        (r"\boffice\s+of\s+the\s+(registrar|director)", 1.5),
        (r"\bref(erence)?\s*no", 1.0),
        (r"\bletterhead\b", 1.0),
        (r"\bencl(osure)?", 0.5),
    ],
    "receipt": [
        (r"\breceipt\b", 3.0),
        (r"\bstate\s+bank\s+of\s+india\b|\bsbi\b", 3.0),
        (r"\bpayment\s*(of|for|receipt)\b", 2.5),
        (r"\bamount\s*(paid|received|rs\.?|₹)", 2.5),
        (r"\binvoice\s*(no|number)?\b", 2.0),
        (r"\bgst\s*(no|number|in)\b", 1.5),
        (r"\brs\.?\s*\d+|\₹\s*\d+", 1.5),
        (r"\bcash\s*memo\b|\bvoucher\b", 1.5),
        (r"\btransaction\s*(id|no)\b", 1.0),
    ],
    "record": [
        (r"\bregister\s*(no|book|vol|volume)?\b", 2.5),
        (r"\brecord\s*book\b", 2.5),
        (r"\bregist(er|ry)\b", 2.0),
        (r"\bserial\s*(no|number)\b", 1.0),
        (r"\bfolio\b", 1.0),
    ],
}
_TYPE_PATTERNS = {
    "practitioner": [
        (r"\bnew\s*registration\b", "new_registration"),
        (r"\brenewal\b", "renewal_application"),
        (r"\brestoration\b", "restoration_application"),
        (r"\bname\s*change\b", "name_change_application"),
    ],
    "letter": [
        (r"\bshow\s*cause\b", "show_cause_notice"),
        (r"\bsuspension\b|\bsuspend\b", "suspension_notice"),
        (r"\bappointment\b", "appointment_letter"),
        (r"\bcircular\b", "circular"),
    ],
    "receipt": [
        (r"\bstate\s+bank\s+of\s+india\b|\bsbi\b", "sbi_challan"),
        (r"\binvoice\b", "vendor_invoice"),
        (r"\bcash\s*memo\b", "cash_memo"),
    ],
    "record": [
        (r"\bregister\s*book\b", "register_book"),
    ],
}
# -------------------------------------------------------------------------------------

BUNDLE_RULES = tuple(Rule(c, p, w) for c, rules in _CATEGORY_PATTERNS.items() for p, w in rules)
BUNDLE_TYPE_RULES = tuple(TypeRule(c, p, t) for c, rules in _TYPE_PATTERNS.items() for p, t in rules)

# Page types by keyword: names come from the page table's documented types, the keywords
# are ours (the type is the lower-case words printed on such a page).
PAGE_RULES = (
    Rule("app_cover", r"\bapplication\s*form\b", 2.0),
    Rule("provisional_reg", r"\bprovisional\s*reg", 2.0),
    Rule("marks_statement", r"\bmarks?\s*statement", 2.0),
    Rule("internship_cert", r"\binternship\s*cert", 2.0),
    Rule("marriage_cert", r"\bmarriage\s*cert", 2.0),
    Rule("form_e", r"\bform\s*e\b", 2.0),
    Rule("aadhaar", r"\baadhaar\b", 2.0),
    Rule("ssc", r"\bssc\b", 2.0),
    Rule("hsc", r"\bhsc\b", 2.0),
    Rule("letter_body", r"\bdear\s+(sir|madam)\b", 2.0),
    Rule("letter_body", r"\byours\s*faithfully\b", 1.0),
    Rule("invoice_lines", r"\binvoice\b", 2.0),
)

# Multi-line, '\n' as the only line end, Unicode classes.  The text that patterns see is lower case
# (see ``fold``); patterns outside the plain lower-case grammar below also ignore case themselves.
JAVA_FLAGS = "(?mdU)"
JAVA_FLAGS_ANY_CASE = "(?imdU)"


def fold(text: Column) -> Column:
    """Text as the rules see it: lower case, with the two letters that match i and s without
    regard to case but survive lower-casing (dotless i, long s) written as i and s."""
    return F.translate(F.lower(text), "ıſ", "is")


def categories_of(rules: Sequence[Rule]) -> tuple[str, ...]:
    """Categories in first-appearance order; this is the order ties resolve in."""
    return tuple(dict.fromkeys(r.category for r in rules))


# Lower-case ASCII letters, digits, a few signs, plain escapes, simple classes, groups, quantifiers.
_PLAIN = re.compile(
    r"""(?:[a-z0-9 ₹_/#:,'"@%&=;!<>~-]|\\[bBsSdDwW.\-/()+*?|^$₹]|\[\^?(?:[a-z0-9 .:/#,_@+-]|\\[sdw.\-/])+\]"""
    r"""|\((?:\?:)?|\)|\||[.?*+^$]|\{\d+,?\d*\})+"""
)


def is_plain(pattern: str) -> bool:
    """In the grammar for which literals can be derived and case is settled by folding."""
    return _PLAIN.fullmatch(pattern) is not None


def java_pattern(pattern: str) -> str:
    return (JAVA_FLAGS if is_plain(pattern) else JAVA_FLAGS_ANY_CASE) + pattern


_OPTIONAL_GROUP = re.compile(r"\((?:[^()\\]|\\.)*\)[?*+]?|\[[^\]]*\](?:[?*+]|\{\d+,?\d*\})?")
_ESCAPE = re.compile(r"\\([a-zA-Z])(?:[?*+]|\{\d+,?\d*\})?|\\(.)")
_MAYBE_ABSENT = re.compile(r".(?:[?*]|\{\d*,?\d*\})")


def needed_text(pattern: str) -> tuple[str, ...]:
    """Literals of which at least one occurs in any match, one per top-level alternative.

    Empty when some alternative has no literal of two characters or a non-ASCII one, and for
    every pattern outside the plain grammar; then the pattern itself has to decide.
    """
    if not is_plain(pattern):
        return ()
    flat = _OPTIONAL_GROUP.sub("\0", pattern)
    while "(" in flat and _OPTIONAL_GROUP.search(flat):
        flat = _OPTIONAL_GROUP.sub("\0", flat)
    found = []
    for alternative in flat.split("|"):
        plain = _ESCAPE.sub(lambda m: "\0" if m.group(1) else m.group(2), alternative)
        plain = _MAYBE_ABSENT.sub("\0", plain)
        runs = re.findall(r"[a-z0-9₹]+", plain)
        best = max(runs, key=len, default="")
        if len(best) < 2 and best != "₹":
            return ()
        found.append(best)
    return tuple(found)


_NEIGHBOURS = re.compile(r"([a-z0-9₹]{4,}) \+?([a-z0-9₹]{4,})")


def needed_neighbours(pattern: str) -> tuple[str, ...]:
    """``<last four letters> <first four letters>`` of two neighbouring words (runs of letters, digits
    and ₹), one per top-level alternative, of which at least one occurs in any match.

    Empty when some alternative has no two literals of four letters with nothing but space between.
    """
    if not is_plain(pattern):
        return ()
    flat = _OPTIONAL_GROUP.sub("\0", pattern)
    while "(" in flat and _OPTIONAL_GROUP.search(flat):
        flat = _OPTIONAL_GROUP.sub("\0", flat)
    found = []
    for alternative in flat.split("|"):
        plain = _ESCAPE.sub(lambda m: " " if m.group(0) in (r"\s", r"\s+") else "\0", alternative)
        pair = _NEIGHBOURS.search(_MAYBE_ABSENT.sub("\0", plain))
        if pair is None:
            return ()
        found.append(f"{pair.group(1)[-4:]} {pair.group(2)[:4]}")
    return tuple(found)


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


# Packs compile to SQL text, not to nested Column calls: one call into the JVM per expression
# instead of several per rule.

def match_sql(text: str, pattern: str) -> str:
    """Does the pattern occur in column ``text``?  A plain substring test goes first: it settles
    most rules on most texts far cheaper than a regular expression, and cannot change the answer."""
    test = f"rlike({text}, {_text(java_pattern(pattern))})"
    literals = needed_text(pattern)
    if not literals:
        return test
    return "(" + " OR ".join(f"contains({text}, {_text(w)})" for w in literals) + f") AND {test}"


def matches(text: str, pattern: str) -> Column:
    return F.expr(match_sql(text, pattern))


def score_columns(text: str, rules: Sequence[Rule]) -> dict[str, Column]:
    """Per category: sum of the weights of rules that match at least once.  ``text`` names a
    folded column."""
    out: dict[str, Column] = {}
    for category in categories_of(rules):
        terms = [
            f"CASE WHEN {match_sql(text, r.pattern)} THEN {r.weight}D ELSE 0D END" for r in rules if r.category == category
        ]
        out[category] = F.expr(" + ".join(terms))
    return out


def _label_sql(text: str, rule: Rule) -> str:
    """``'<first match>' (+<weight>)``, or null; control characters and no-break space spelled out."""
    label = f"regexp_extract({text}, {_text(java_pattern(rule.pattern))}, 0)"
    for raw, shown in (
        ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x0b", "\\x0b"), ("\x0c", "\\x0c"), ("\xa0", "\\xa0"),
    ):
        label = f"replace({label}, {_text(raw)}, {_text(shown)})"
    return f"CASE WHEN {match_sql(text, rule.pattern)} THEN concat('\\'', {label}, {_text(f"' (+{rule.weight})")}) END"


_BETWEEN = "\x1e"  # cannot occur in a match: no rule matches it


def signal_array(text: str, category: str, rules: Sequence[Rule]) -> Column:
    """Labels of the winning category's rules that fired, in rule order.

    One branch per category, so the other categories' patterns are not evaluated.  Labels are
    joined and split again, which stays in generated code where an array filter would not.
    """
    branches = [
        f"WHEN {_text(name)} THEN concat_ws({_text(_BETWEEN)}, "
        + ", ".join(_label_sql(text, r) for r in rules if r.category == name)
        + ")"
        for name in categories_of(rules)
    ]
    return F.split(F.expr(f"CASE {category} {' '.join(branches)} END"), _BETWEEN)


def first_type(text: str, category: str, rules: Sequence[TypeRule]) -> Column:
    """First type rule, in list order, that matches within the winning category."""
    whens = [f"WHEN {category} = {_text(r.category)} AND {match_sql(text, r.pattern)} THEN {_text(r.type_name)}" for r in rules]
    return F.expr(f"CASE {' '.join(whens)} END")


def fired_rules(df: DataFrame, text: str, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Long form: one row per (text row, rule that matches), still without a join."""
    tests = ", ".join(
        f"CASE WHEN {match_sql(text, r.pattern)} THEN named_struct('rule_ord', {i}L, 'category', {_text(r.category)}, 'weight', {r.weight}D) END"
        for i, r in enumerate(rules)
    )
    hits = df.select(*keys, F.explode(F.expr(f"array({tests})")).alias("hit")).filter("hit IS NOT NULL")
    return hits.select(*keys, "hit.rule_ord", "hit.category", "hit.weight")


def rules_from_table(rules: DataFrame, limit: int | None = None) -> tuple[Rule, ...]:
    """Rules kept in a table (category, pattern, weight, ord) become a pack at plan time.

    A rule table is configuration; with ``limit``, a larger one is refused, not truncated.
    """
    wanted = rules.select("category", "pattern", "weight", "ord")
    rows = (wanted if limit is None else wanted.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"rule table has more than {limit} rows")
    return tuple(Rule(r.category, r.pattern, float(r.weight)) for r in sorted(rows, key=lambda r: r.ord))

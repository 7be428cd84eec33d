"""Rule packs against a direct evaluation with Python's regular expressions."""

import random
import re

from pyspark.sql import functions as F

from bundleflow.functions import rulepacks
from bundleflow.functions.rulepacks import BUNDLE_RULES, BUNDLE_TYPE_RULES, MIN_SCORE, PAGE_RULES, Rule, fired_rules, fold, needed_text, rules_from_table
from bundleflow.operators import classify as K

PHRASES = [
    "Registration No: 5", "application  form", "AMR-MCH-26-A-00001", "amr mch", "Form E", "provisional registration", "Internship\nCertificate",
    "BHMS", "BAMS", "homoeopathy", "Marks Statement", "mark statement", "aadhaar", "SSC", "hsc", "Marriage certificate", "i-96789", "\ni-96789\n",
    "Dear Sir", "dear dr.", "yours truly", "Your sincerely", "Subject :", "Government  of\tIndia", "National Commission", "NCH", "office of the director",
    "reference no", "Ref No", "letterhead", "encl", "enclosure", "Receipt", "SBI", "state bank of india", "payment for", "amount ₹", "Amount rs.",
    "invoice", "GST in", "Rs. 500", "rs ५००", "₹ 12", "cash memo", "voucher", "transaction id", "register vol", "record book", "registry",
    "serial number", "folio", "nothing", "registered", "preregistration no", "QR:I-96789", "new registration", "renewal", "show cause", "suspend",
    "circular", "register book", "name change", " nch ", "ſsc", "regıstration no",
]


def expected(text, rules=BUNDLE_RULES):
    low = text.lower()
    flags = re.IGNORECASE | re.MULTILINE
    scores = {}
    for r in rules:
        scores[r.category] = scores.get(r.category, 0.0) + (r.weight if re.search(r.pattern, low, flags) else 0.0)
    best = max(scores.values())
    if best < MIN_SCORE:
        return scores, None
    ranked = sorted(scores.items(), key=lambda kv: kv[1], reverse=True)
    category, runner = ranked[0][0], ranked[1][1]
    signals = [f"{m.group(0)!r} (+{r.weight})" for r in rules if r.category == category and (m := re.search(r.pattern, low, flags))]
    kind = next((t.type_name for t in BUNDLE_TYPE_RULES if t.category == category and re.search(t.pattern, low, flags)), None)
    return scores, (category, kind, min(best / (best + runner + 1.0), 1.0), signals)


def texts():
    rng = random.Random(7)
    return PHRASES + ["\n".join(rng.sample(PHRASES, rng.randint(1, 6))) for _ in range(400)] + [""]


def test_scores_and_results_equal_direct_evaluation(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, text string")
    scored = {r["i"]: r for r in K.score_text(df, "text").collect()}
    ruled = {r["i"]: r["rules_result"] for r in K.classify_text(df, "text").collect()}
    for i, text in rows:
        scores, result = expected(text)
        assert {c: scored[i][f"score_{c}"] for c in scores} == scores, text
        if result is None:
            assert ruled[i] is None, text
            continue
        category, kind, confidence, signals = result
        assert (ruled[i]["category"], ruled[i]["document_type"]) == (category, kind), text
        assert abs(ruled[i]["confidence"] - confidence) < 1e-12
        if not set(text) & set("ſı"):
            assert ruled[i]["signals"] == signals, text


def test_needed_text_never_rejects_a_match():
    flags = re.IGNORECASE | re.MULTILINE
    for rule in (*BUNDLE_RULES, *BUNDLE_TYPE_RULES, *PAGE_RULES):
        literals = needed_text(rule.pattern)
        for text in texts():
            low = text.lower().replace("ſ", "s").replace("ı", "i")
            if literals and re.search(rule.pattern, low, flags):
                assert any(w in low for w in literals), (rule, text)


def test_ties_go_to_the_first_category(spark):
    df = spark.createDataFrame([("Registration number\nReceipt",)], "text string")
    r = K.classify_text(df, "text").first()["rules_result"]
    assert r["category"] == "practitioner" and abs(r["confidence"] - 3.0 / 7.0) < 1e-12


def test_long_form_equals_scores(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, text string").withColumn("low", fold(F.col("text")))
    long = fired_rules(df, "low", ["i"], BUNDLE_RULES).groupBy("i").agg(F.sum("weight").alias("w"))
    wide = K.score_text(df.select("i", "text"), "text")
    total = sum((F.col(c) for c in wide.columns if c.startswith("score_")), F.lit(0.0))
    diff = wide.select("i", total.alias("t")).join(long, "i", "left").filter(F.col("t") != F.coalesce("w", F.lit(0.0)))
    assert diff.count() == 0


def test_rules_from_table_keep_order_and_refuse_excess(spark):
    df = spark.createDataFrame([("b", "y", 1.0, 2), ("a", "x", 2.0, 1)], "category string, pattern string, weight double, ord int")
    assert rules_from_table(df) == (Rule("a", "x", 2.0), Rule("b", "y", 1.0))
    try:
        rules_from_table(df, limit=1)
    except ValueError:
        return
    raise AssertionError("too many rules accepted")


def test_any_legal_pattern_of_a_table_fires(spark):
    text = "GST no 5 नमस्ते a]cd"
    df = spark.createDataFrame([(text,)], "raw string").select(rulepacks.fold(F.col("raw")).alias("t"))
    for pattern in (r"\bGST\b", r"\p{IsDevanagari}+", r"\x67st", r"[\]ab]cd", r"gst no \d", r"(GST|pan)\s+NO"):
        assert df.select(rulepacks.matches("t", pattern)).first()[0], pattern
        bare = F.expr(f"rlike(t, {rulepacks._text(rulepacks.java_pattern(pattern))})")
        assert df.select(bare).first()[0], pattern


def test_prefilter_never_changes_the_answer(spark):
    rng = random.Random(2)
    pieces = [r"\bgst\b", "no", r"\s*", r"\d{2,}", "(pan|gst)?", "[a-c]+", r"\.", "x?", "|", "in", r"(?:ab|cd)", "₹"]
    texts = ["".join(rng.choice(["gst", "no", " ", "12", "pan", "abc", ".", "x", "in", "ab", "₹", "\n"]) for _ in range(8)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for _ in range(40):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        if pattern.startswith("|") or pattern.endswith("|") or "||" in pattern:
            continue
        bare = F.expr(f"rlike(t, {rulepacks._text(rulepacks.java_pattern(pattern))})")
        assert df.filter(rulepacks.matches("t", pattern) != bare).count() == 0, pattern

"""Rules kept as a table against the same rules compiled."""

import random

import pytest
from pyspark.sql import functions as F

from bundleflow.functions.rulepacks import BUNDLE_RULES, PAGE_RULES, Rule, fired_rules, fold, needed_neighbours
from bundleflow.operators import rules as R

from test_rules import texts

TABLE = "ord long, category string, pattern string, weight double"


def fired(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rules):
    return spark.createDataFrame([(i, r.category, r.pattern, float(r.weight)) for i, r in enumerate(rules)], TABLE)


@pytest.mark.parametrize("gram", [2, 4])
def test_same_as_the_compiled_pack(spark, gram):
    rows = [(i, None if i % 3 == 0 else i % 5, t) for i, t in enumerate(texts())] + [(9000, 1, None), (9001, 2, ""), (5, 5, texts()[5])]
    df = spark.createDataFrame(rows, "i int, k int, text string")
    rules = [*BUNDLE_RULES, *PAGE_RULES, Rule("any", r"\d{9,}", 0.5), Rule("any", r"[^a-z]", 0.25), Rule("one", "₹", 1.0), Rule("alt", "folio|receipt|sb", 2.0)]
    want = fired_rules(df.withColumn("low", fold(F.col("text"))).filter("low IS NOT NULL"), "low", ["i", "k"], rules)
    with_null = table(spark, rules).union(spark.createDataFrame([(777, "none", None, 1.0)], TABLE))
    assert fired(R.rules_matched(df, "text", ["i", "k"], with_null, gram)) == fired(want)
    assert R.rules_matched(df.limit(0), "text", ["i", "k"], with_null).count() == 0
    assert R.rules_matched(df, "text", ["i", "k"], with_null.limit(0)).count() == 0


def test_many_rules_stay_off_the_driver(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    names = sorted({word() for _ in range(50_000)})
    rules = spark.createDataFrame([(i, "name", w, 1.0) for i, w in enumerate(names)], TABLE)
    rows = [(k, " ".join([word(), names[k * 7], "x" + names[k * 11] + "y", word()])) for k in range(300)]
    got = R.rules_matched(spark.createDataFrame(rows, "k int, text string"), "text", ["k"], rules)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    found = {(r.k, names[r.rule_ord]) for r in got.collect()}
    assert {(k, names[k * 7]) for k in range(300)} | {(k, names[k * 11]) for k in range(300)} <= found
    assert all(w in rows[k][1] for k, w in found)


def test_too_many_open_rules_are_refused(spark):
    rules = table(spark, [Rule("any", r"\d{%d,}" % n, 1.0) for n in range(1, 5)])
    with pytest.raises(ValueError, match="3 rules"):
        R.open_rules(rules, 3)
    assert len(R.open_rules(rules, 4)) == 4


def test_neighbouring_words_are_keys(spark):
    keys = {"theand +thble": "eand thbl", r"\babcde\s+fghij\b": "bcde fghi", "xyz|abcd +efgh": None, "abcd *efgh": None, "abcds? +efgh": None,
            "abcd+ +efgh": None, r"abcd \+efgh": None, "abcd +efg?h": None, "abcd +e+fgh": None, "wxab +cdefg+": "wxab cdef"}
    assert {p: (needed_neighbours(p) or (None,))[0] for p in keys} == keys
    rng = random.Random(5)
    text = lambda: rng.choice(["", " ", "é"]).join(rng.choice(["abab", "baba", " ", "  ", "\n", "-", "a", "b", "Ab"]) for _ in range(30))
    rows = [(i % 90, text()) for i in range(120)]
    rules = [Rule("x", f"{a}{gap}{b}", w) for a in ("abab", "baab", "bababa") for b in ("abab", "baba+", "abab?a") for gap in (" +", " ", r"\s+", " *") for w in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, text string")
    want = fired_rules(df.withColumn("low", fold(F.col("text"))), "low", ["k"], rules)
    assert want.count() > 500 and fired(R.rules_matched(df, "text", ["k"], table(spark, rules))) == fired(want)
    want = want.groupBy("k", "category").agg(F.sum("weight"), F.count("*"))
    assert fired(R.scores_by_table(df, "text", ["k"], table(spark, rules))) == fired(want)


def test_candidates_of_common_words_stay_near_the_matches(spark):
    """All rules share their words with all texts; only neighbours may make a candidate."""
    words = [f"word{chr(97 + i)}" for i in range(20)]
    rules = table(spark, [Rule("c", f"{a} +{b}", 1.0) for a in words for b in words])
    rng = random.Random(7)
    df = spark.createDataFrame([(k, " ".join(rng.sample(words, 20))) for k in range(200)], "k int, text string")
    _, texts_ = R._digested(df, "text", ["k"])
    assert R.literal_index(rules).count() == 0 and R.neighbour_index(rules).count() == 400
    assert R.patterns_hit(texts_, rules).count() == 200 * 19

"""Rules kept as a table, matched to texts through an index of their literals.

A pattern can only match where one of its literals stands, and a literal stands inside one word.
Where a pattern needs two neighbouring words, the end of the first and the start of the second are
its key, and every text is looked up by its neighbouring words: candidates are few more than matches.
For other patterns the index holds, for every literal, one gram of it.  The distinct words of all
texts are cut into grams and meet the index; which literals a word holds is so settled once per word.
Texts that have such a word are candidates, and only there is the pattern run.  Equal patterns and
equal texts are settled once.  Rules are never collected and never cross the texts; only patterns
without a literal, which any text may match, are compiled into the plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rulepacks import JAVA_FLAGS, Rule, fold, match_sql, needed_neighbours, needed_text
from ..session import cut_lineage

GRAM = 4  # letters of a gram; shorter literals are a gram as they are
OPEN_RULES = 500  # rules without a literal that a plan may hold
INDEX_BYTES = 32 << 20  # estimated size up to which the index is broadcast

def _patterns(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("pattern").isNotNull()).select("pattern").distinct()


def neighbour_index(rules: DataFrame) -> DataFrame:
    """(key, pattern): one row per key of each pattern that has to hold two neighbouring words."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, p) for p in batch["pattern"] for k in set(needed_neighbours(p))], columns=["key", "pattern"])

    return _patterns(rules).mapInPandas(keys, "key string, pattern string")


def literal_index(rules: DataFrame, gram: int = GRAM) -> DataFrame:
    """(gram, size, literal, pattern): one row per literal of each pattern without neighbours.

    Of a literal's grams the one that the fewest literals hold stands for it.  Patterns without a
    literal have no row.
    """

    def literals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, needed) for p in batch["pattern"] if not needed_neighbours(p) for needed in set(needed_text(p))]
            yield pd.DataFrame(rows, columns=["pattern", "literal"])

    found = _patterns(rules).mapInPandas(literals, "pattern string, literal string")
    size = F.least(F.lit(gram), F.length("literal"))
    grams = F.transform(F.sequence(F.lit(1), F.length("literal") - size + 1), lambda i: F.substring(F.col("literal"), i, size))
    parts = found.select("literal", size.alias("size"), F.explode(F.array_distinct(grams)).alias("gram")).distinct()
    rare = parts.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = parts.join(rare, "gram").groupBy("literal", "size").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return found.join(chosen, "literal").select("gram", "size", "literal", "pattern")


def open_rules(rules: DataFrame, limit: int = OPEN_RULES) -> list[tuple[int, Rule]]:
    """Rules without a literal, which have to be in the plan; more than ``limit`` are refused."""

    @F.pandas_udf("boolean")
    def no_literal(patterns: pd.Series) -> pd.Series:
        return pd.Series([not needed_text(p) for p in patterns], dtype=bool)

    rows = rules.filter(F.col("pattern").isNotNull()).filter(no_literal("pattern")).select("ord", "category", "pattern", "weight").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules have no literal to look them up by")
    return [(int(r.ord), Rule(r.category, r.pattern, float(r.weight))) for r in rows]


# Fixed value: the letters a literal is made of (see ``needed_text``).
WORD = "[a-z0-9₹]+"


def _word_grams(gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, g) for w in batch["word"] for n in range(1, gram + 1) for g in {w[i : i + n] for i in range(len(w) - n + 1)}]
            yield pd.DataFrame({"word": pd.Series([w for w, _ in rows], dtype=object), "gram": pd.Series([g for _, g in rows], dtype=object)})

    return run


def words_with_literals(words: DataFrame, index: DataFrame, gram: int = GRAM) -> DataFrame:
    """(word, pattern): words that hold a literal of a pattern."""
    grams = words.mapInPandas(_word_grams(gram), "word string, gram string")
    met = grams.join(_small(index, INDEX_BYTES // 256), "gram").filter(F.contains("word", "literal"))
    return met.select("word", "pattern").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if counted small enough; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _neighbours(low: str):
    """Keys of all neighbouring words of a folded text, see ``needed_neighbours``."""
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    ends = F.transform(words, lambda w: F.right(w, F.lit(4)))
    starts = F.transform(words, lambda w: F.left(w, F.lit(4)))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    keys = F.zip_with(F.slice(ends, F.lit(1), n), F.slice(starts, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) == 9))


def _digested(df: DataFrame, text: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, _digest), and their texts (_digest, _low), each once."""
    low = df.select(*keys, fold(F.col(text)).alias("_low")).filter(F.col("_low").isNotNull()).withColumn("_digest", F.unhex(F.md5(F.encode("_low", "UTF-8"))))
    return low.select(*keys, "_digest"), low.select("_digest", "_low").dropDuplicates(["_digest"])


def patterns_hit(texts: DataFrame, rules: DataFrame, gram: int = GRAM, open_limit: int = OPEN_RULES) -> DataFrame:
    """(_digest, pattern): each pattern of the rules once for each text (_digest, _low) that it matches."""
    met = texts.select("_digest", F.explode(_neighbours("_low")).alias("key")).join(_small(neighbour_index(rules), INDEX_BYTES // 256), "key").select("_digest", "pattern")
    index = literal_index(rules, gram)
    if not index.isEmpty():
        words = texts.select("_digest", F.explode(F.array_distinct(F.regexp_extract_all("_low", F.lit(WORD), F.lit(0)))).alias("word"))
        held = cut_lineage(words_with_literals(words.select("word").distinct(), index, gram))
        met = met.unionByName(words.join(_small(held, INDEX_BYTES // 256), "word").select("_digest", "pattern"))
    checked = texts.join(met.distinct(), "_digest").filter(F.expr(f"rlike(_low, concat('{JAVA_FLAGS}', pattern))")).select("_digest", "pattern")
    tests = [F.when(F.expr(match_sql("_low", p)), F.lit(p)) for p in sorted({r.pattern for _, r in open_rules(rules, open_limit)})]
    if not tests:
        return checked
    return checked.unionByName(texts.select("_digest", F.explode(F.array(*tests)).alias("pattern")).filter("pattern IS NOT NULL"))


def rules_matched(
    df: DataFrame, text: str, keys: Sequence[str], rules: DataFrame, gram: int = GRAM, open_limit: int = OPEN_RULES
) -> DataFrame:
    """Long form: (keys, rule_ord, category, weight), one row per text row and rule that matches.

    rules: (ord, category, pattern, weight), any number of them.  Equal to ``fired_rules`` of the same
    rules compiled.  Texts are looked up by their digest, so keys may be null or repeated; a null
    text or pattern matches nothing.
    """
    rows, texts = _digested(df, text, keys)
    wanted = rules.select("pattern", F.col("ord").cast("long").alias("rule_ord"), "category", F.col("weight").cast("double"))
    fired = patterns_hit(texts, rules, gram, open_limit).join(_small(wanted, INDEX_BYTES // 256), "pattern").drop("pattern")
    return rows.join(fired, "_digest").drop("_digest")


def scores_by_table(df: DataFrame, text: str, keys: Sequence[str], rules: DataFrame) -> DataFrame:
    """(keys, category, score, n_rules): per text and category the sum of the weights that fired.

    Weights are summed per pattern first and per text next, so rules that share a pattern and rows
    that share a text cost one match.
    """
    rows, texts = _digested(df, text, keys)
    summed = rules.groupBy("pattern", "category").agg(F.sum(F.col("weight").cast("double")).alias("score"), F.count("*").alias("n_rules"))
    hits = patterns_hit(texts, rules).join(_small(summed, INDEX_BYTES // 256), "pattern")
    total = [F.sum("score").alias("score"), F.sum("n_rules").alias("n_rules")]
    per_text = hits.groupBy("_digest", "category").agg(*total)
    return rows.join(per_text, "_digest").groupBy(*keys, "category").agg(*total)

"""License scans by canonical digest lookup.

Texts are brought to a canonical form, so that wordings which mean the same licence get the same
SHA-256, and are hash-joined to the digests of known licences: whole documents, and each line of
a document as a text of its own (a notice usually stands on one line).  The body of a licence may
be wrapped so that a line begins with "copyright" or ends inside a spelling of two words; such
documents are looked up by a second digest too, of one line of words without only those copyright
lines that name a year or begin a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, text_of
from .license_texts import full_texts

# Spellings that licence comparison treats as one, and copyright marks.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"), ("fulfil", "fulfill"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("v2", "version 2"), ("v3", "version 3"),
)
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
# Copyright notices proper: with a year or a mark, or at the beginning of a paragraph.
NOTICE_LINE = (
    r"(^|\n)[ \t]*((copyright|©)[^\n]*(\d{4}|\(c\)|©|year|yyyy)|©|\(c\)[^\n]*(\d{4}|year|yyyy))[^\n]*"
    r"|(^[ \t\n]*|\n[ \t]*\n[ \t]*)copyright[^\n]*"
)
# Spellings of two words that a line end parts.
PARTED = r"(sub|non|copyright|per)[^a-z0-9\n]*\n[^a-z0-9]*(licen[cs]e|infringement|commercial|owner|cent)"
# Everything ASCII but letters, digits and the line end.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

# One-line notices, and whole texts of known licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
     "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
     "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    *full_texts(),
)


def _spelled(clean: Column) -> Column:
    either = "|".join(a for a, _ in SPELLINGS)
    spelled = clean
    for a, b in SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"\b{a}\b", b)
    return F.when(clean.rlike(rf"\b({either})\b"), spelled).otherwise(clean)


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical form: lower case, no copyright lines, no punctuation, one spelling."""
    clean = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "\n")
    clean = _spelled(F.regexp_replace(clean, PUNCTUATION, " "))
    lines = F.transform(F.split(clean, "\n", -1), lambda line: F.trim(line))
    return F.filter(lines, lambda line: line != "")


def canonical_words(text: Column) -> Column:
    """The text as one canonical line, however it is wrapped; only copyright notices proper are left out."""
    clean = F.regexp_replace(ascii_lower(text), NOTICE_LINE, "\n")
    clean = F.translate(F.regexp_replace(clean, PUNCTUATION, " "), "\n", " ")
    return F.trim(_spelled(F.regexp_replace(clean, " {2,}", " ")))


def digest(words: Column) -> Column:
    return F.sha2(F.encode(words, "UTF-8"), 256)


def known_licenses(spark: SparkSession, texts=NOTICES) -> DataFrame:
    """(license_id, digest) of a list of (license_id, text), by both digests; of equal ones the first id stays."""
    rows = spark.createDataFrame(list(texts), "license_id string, text string")
    both = F.array(digest(F.array_join(canonical_lines(F.col("text")), " ")), digest(canonical_words(F.col("text"))))
    return rows.select("license_id", F.explode(both).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, digest (whole text), license_id or null, n_notices, notices.

    n_notices counts the lines that are a known text; notices joins their distinct ids by commas
    in order, empty if none.  Null text counts as empty, and an empty canonical form matches
    nothing.  Rows stay rows: repeated documents are scanned each for itself.
    The lines of a document are matched as distinct digests with their counts, so a line repeated
    a million times in one text is one probe.
    """
    lines = canonical_lines(text_of(text))
    wrapped = F.when(ascii_lower(text_of(text)).rlike(f"{COPYRIGHT_LINE}|{PARTED}"), digest(canonical_words(text_of(text))))
    base = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), lines.alias("_lines"), wrapped.alias("_wrapped"))
    whole = base.select("doc_id", "_row", F.lit(True).alias("_whole"), digest(F.array_join("_lines", " ")).alias("digest"), "_wrapped")
    by_wrapped = known.select(F.col("digest").alias("_wrapped"), F.col("license_id").alias("_wrapped_id"))
    by_line = base.select("doc_id", "_row", F.lit(False).alias("_whole"), F.explode("_lines").alias("_line")).withColumn("digest", digest(F.col("_line"))).drop("_line")
    hits = by_line.join(known, "digest").groupBy("_row").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    return (
        whole.join(known, "digest", "left")
        .join(by_wrapped, "_wrapped", "left")
        .join(hits, "_row", "left")
        .select("doc_id", "digest", F.coalesce("license_id", "_wrapped_id").alias("license_id"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
    )

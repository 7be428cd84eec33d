"""Person queries to ranked documents: parse, graph filter, vector re-rank, hydrate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plan import fence
from ..functions.vectors import cosine_prenormed, norm
from ..session import cut_lineage
from .vectors import DEFAULT_K, top_per_group

NAME_PATTERN = r"(?i)\bdocuments\s+of\s+(.+?)\s*(?:,|$)"
DOB_PATTERN = r"(?i)\bdob\s+(\d{1,2} [a-z]{3} \d{4})\b"


def parse_person_query(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Adds ``name`` (lower case) and ``dob`` (date); null for the part that is not there."""
    name = F.nullif(F.lower(F.regexp_extract(text, NAME_PATTERN, 1)), F.lit(""))
    raw = F.nullif(F.initcap(F.regexp_extract(text, DOB_PATTERN, 1)), F.lit(""))
    return queries.withColumn("name", name).withColumn("dob", F.try_to_timestamp(raw, F.lit("d MMM yyyy")).cast("date"))


def candidates(parsed: DataFrame, persons: DataFrame, belongs_to: DataFrame) -> DataFrame:
    """(query_id, document_id): documents of every person with the query's name and birth date."""
    people = persons.select(F.lower("full_name").alias("name"), "dob", "registration_no")
    found = parsed.filter(F.col("name").isNotNull() & F.col("dob").isNotNull()).join(people, ["name", "dob"])
    return found.join(belongs_to, "registration_no").select("query_id", "document_id").distinct()


def score_pages(found: DataFrame, query_vectors: DataFrame, page_vectors: DataFrame) -> DataFrame:
    """(query_id, document_id, page_num, score) for the pages of candidate documents only.

    The query vector joins the small candidate table first; pages come last, on the document,
    so a later top-k per query can cut each task's rows before they are shuffled by query.
    """
    q = query_vectors.select("query_id", "query_vector", norm(F.col("query_vector")).alias("_qn"))
    v = page_vectors.select("document_id", "page_num", "embedding")
    pairs = found.join(q, "query_id").join(v, "document_id")
    score = F.round(
        cosine_prenormed(F.col("embedding"), norm(F.col("embedding")), F.col("query_vector"), F.col("_qn")), 6
    )
    scored = fence(pairs, score=score)
    return scored.filter(F.col("score").isNotNull()).select("query_id", "document_id", "page_num", "score")


def best_pages(scored: DataFrame) -> DataFrame:
    """(query_id, document_id, score, page_num): the best page per document, as an aggregate."""
    return scored.groupBy("query_id", "document_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "page_num")).alias("b")
    ).select("query_id", "document_id", (-F.col("b.s")).alias("score"), F.col("b.page_num").alias("page_num"))


def rank_documents(scored: DataFrame, bounded: bool = False) -> DataFrame:
    """Documents by best page: (query_id, document_id, score, page_num, doc_rank).

    ``bounded`` promises a few rows per query (after a top-k); otherwise one query may own a
    large share of all rows and is ranked in pieces.
    """
    best = best_pages(scored)
    order = [F.desc("score"), F.asc("document_id")]
    if bounded:
        w = Window.partitionBy("query_id").orderBy(*order)
        return best.withColumn("doc_rank", F.row_number().over(w).cast("bigint"))
    return split_rank(best, "query_id", order, "doc_rank")


def split_rank(df: DataFrame, group: str, order: Sequence[Column], out: str) -> DataFrame:
    """row_number per group for groups of any size.

    Rows are range-partitioned by group and order, which cuts a large group over many
    partitions; each partition is numbered on its own and shifted by what comes before it.
    The placement is checkpointed, so both uses of the partition number see the same one.
    """
    placed = cut_lineage(df.repartitionByRange(F.asc(group), *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = placed.withColumn("_pos", F.row_number().over(inside)).join(shifts, [group, "_part"])
    return numbered.withColumn(out, (F.col("_pos") + F.col("_shift")).cast("bigint")).select(*df.columns, out)


def hydrate(ranked: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Ranked rows with their document and page columns; the rank column carries the order."""
    return ranked.join(documents, "document_id").join(pages, ["document_id", "page_num"])


def highlights(ranked: DataFrame, parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities on ranked pages whose value contains a word of the query."""
    words = parsed.select("query_id", F.filter(F.split("name", r"\s+"), lambda w: F.length(w) > 0).alias("_words"))
    hits = ranked.select("query_id", "document_id", "page_num").join(
        entities.select("document_id", "page_num", "type", "value"), ["document_id", "page_num"]
    ).join(words, "query_id")
    lowered = F.lower("value")
    return hits.filter(F.exists("_words", lambda w: F.contains(lowered, w))).drop("_words")


def retrieve(
    queries: DataFrame, query_vectors: DataFrame, persons: DataFrame, belongs_to: DataFrame,
    page_vectors: DataFrame, documents: DataFrame, pages: DataFrame, k: int = DEFAULT_K,
) -> DataFrame:
    """The whole flow for a table of queries: top-k pages within each query's documents, ranked
    by document and joined back to document and page rows.

    Queries that ask the same thing with the same vector are answered once: popular questions
    would otherwise multiply with the pages of popular persons.
    """
    asked = parse_person_query(queries).join(query_vectors.select("query_id", "query_vector"), "query_id")
    asked = asked.filter(F.col("name").isNotNull() & F.col("dob").isNotNull())
    same = ["name", "dob", "query_vector"]
    questions = asked.groupBy(*same).agg(F.min("query_id").alias("_lead"))
    leads = asked.select("query_id", *same).join(questions, same).select("query_id", "_lead")

    lead = questions.withColumnRenamed("_lead", "query_id")
    scored = score_pages(candidates(lead, persons, belongs_to), lead, page_vectors)
    top = top_per_group(scored, ["query_id"], k, [F.desc("score"), F.asc("document_id"), F.asc("page_num")]).drop("rank")
    ranked = hydrate(rank_documents(top, bounded=True), documents, pages)
    return ranked.withColumnRenamed("query_id", "_lead").join(leads, "_lead").drop("_lead")

"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import anchors, bpe, bwt, cube, jaccard, licenses, periods, quality, spelling, tiff, toolcalls, warc, winnow
from .common import SPACES, read
from .sql import ANCHOR_SQL, JACCARD_SQL, LEAK_SQL, LICENSE_SQL, REPEAT_SQL, SPELLING_SQL, TOOL_SQL, WARC_SQL


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", "quality.*")


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_table(read(spark, sf_dir, "documents"))


def _digested(df: DataFrame, *fields: str) -> DataFrame:
    """The digest columns of a substring deduplicator's result."""
    return df.select("doc_id", *[F.col(f"repeats.{f}") for f in fields], F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(read(spark, sf_dir, "documents"))


def op5_fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(anchors.dedup(read(spark, sf_dir, "documents")), "n_words", "n_removed")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(bwt.dedup(read(spark, sf_dir, "documents")), "n_bytes", "n_removed", "n_spans")


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = winnow.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.encode(F.array_join("leaks.items", ","), "UTF-8"), 256)
    return judged.select(
        "doc_id", "leaks.n_words", "leaks.n_hit", F.size("leaks.items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("leaks.n_hit") > 0).alias("contaminated")
    )


# The conversations hold no tool calls: every assistant turn becomes three calls, of which the
# second waits for the third, and every other turn the results of the turn before.
TOOL_SCHEMAS = (
    ("search", "query", "string", True), ("search", "limit", "integer", False), ("count", "unit", "string", True), ("count", "source", "string", True),
    ("fetch", "id", "integer", True), ("fetch", "deep", "boolean", False),
)
TOOL_CALLS = """array(
  named_struct('id', concat('a', turn), 'name', 'search', 'arguments', concat('{"query": "', w, '", "limit": ', n % 50, '}'), 'after', cast(array() AS array<string>)),
  named_struct('id', concat('b', turn), 'name', 'count', 'arguments', if(n % 5 = 0, '{"unit": 7}', concat('{ "unit" : "word" , "source": "c', turn, '" }')), 'after', array(concat('c', turn))),
  named_struct('id', concat('c', turn), 'name', 'fetch', 'arguments', concat('{"id":', n, ',"deep":true}'), 'after', array(concat('a', turn))))"""
TOOL_RESULTS = "explode(if(turn % 4 = 2, array('a', 'c'), array('a', 'b', 'c')))"


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    worded = turns.filter("role = 'assistant'").selectExpr("conv_id", "turn", "length(coalesce(text, '')) AS n", "regexp_extract(coalesce(text, ''), '[a-z]+', 0) AS w")
    messages = worded.select("conv_id", "turn", F.expr(TOOL_CALLS).alias("calls"))
    answers = turns.filter("role = 'user' AND turn >= 1").select("conv_id", "turn", "text", F.expr(TOOL_RESULTS).alias("kind"))
    results = answers.selectExpr("conv_id", "turn", "concat(kind, turn - 1) AS call_id", "md5(encode(coalesce(text, ''), 'UTF-8')) AS content")
    schemas = spark.createDataFrame(list(TOOL_SCHEMAS), "tool string, parameter string, type string, required boolean")
    return toolcalls.link(messages, results, schemas)


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = bpe.build(docs, public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.decode(bpe.encode(docs, lexicon), lexicon, "tokens")
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


MISSPELT = 31  # one word in so many loses a letter


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(read(spark, sf_dir, "documents"), spelling.misspelt(MISSPELT))
    return spelling.group_variants(words)


# A tenth of the documents is given a periodic end: from word a on, word i is word a + (i - a) mod p.
PERIODIC_END = f"""
SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
  THEN array_join(transform(sequence(0, n - 1), i -> get(words, if(i < a, i, a + (i - a) % p))), ' ') ELSE text END AS text
FROM (SELECT *, 1 + cast(floor((n - a) / (3 + g % 8)) AS int) AS p FROM
  (SELECT *, cast(g % n AS int) AS a FROM
    (SELECT *, floor(h / 10) AS g, size(words) AS n FROM
      (SELECT doc_id, text, h, if(h % 10 = 0, filter(split(coalesce(text, ''), r'[{SPACES}]+'), w -> w <> ''), array('')) AS words FROM
        (SELECT doc_id, text, crc32(encode(cast(doc_id AS string), 'UTF-8')) AS h FROM {{docs}})))))
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(PERIODIC_END, docs=read(spark, sf_dir, "documents"))
    found = periods.find(planted).select("doc_id", "periods.*")
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return found.withColumn("first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("first.s")).alias("start"), F.col("first.length").alias("length"), (-F.col("first.p")).alias("period"),
        F.expr("(1000 * first.length) div -first.p").alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_license_scans, op2_quality_classifier, op3_tiff_media, op4_mix_sources, op5_fixed_block_dedup, op6_suffix_array_dedup, op7_warc_archives, op8_jaccard_join, op9_benchmark_decontamination, op10_tool_call_linking, op11_bpe_transducer, op12_spelling_variants, op13_periodic_runs)}
CHECKS = {
    "op1_license_scans": LICENSE_SQL,
    "op5_fixed_block_dedup": ANCHOR_SQL,
    "op6_suffix_array_dedup": REPEAT_SQL,
    "op7_warc_archives": WARC_SQL,
    "op8_jaccard_join": JACCARD_SQL,
    "op9_benchmark_decontamination": LEAK_SQL,
    "op10_tool_call_linking": TOOL_SQL,
    "op12_spelling_variants": SPELLING_SQL,
}

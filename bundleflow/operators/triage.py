"""Page statistics: script, rotation, typed or handwritten, blank, cut and skew selection.

The inputs are measurement tables (one row per component, sample or row total), never
images.  Every group statistic is an aggregate with a map-side partial step, so one page or
group may hold a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import to_float
from ..functions.plan import once
from ..session import cut_lineage

# --- Fixed values --------------------------------------------------------------------
SCRIPTS = {"Latin": "latin", "Devanagari": "devanagari"}
CONFIDENT_OSD = 5.0
TIERS = {"typed": 1, "handwritten": 2, "unknown": 1}
MIN_COMPONENTS = 12
HEIGHT_CV = 0.35
STROKE_CV = 0.45
HEIGHT_WEIGHT = 0.5
MIN_GLYPH_HEIGHT = 6
MAX_GLYPH_FRACTION = 0.25
MIN_GLYPH_AREA = 4
MIN_STROKES = 50
# -------------------------------------------------------------------------------------

# A script is material from this share of the letters on (ours; the two-way mix is only named).
MIXED_SHARE = 0.2


def osd_confidence(raw: Column) -> Column:
    v = to_float(raw.cast("string")).cast("double")
    return F.when(v > 0, F.least(v / F.lit(CONFIDENT_OSD), F.lit(1.0))).otherwise(F.lit(0.0))


def map_script(name: Column) -> Column:
    expr = F.lit("unknown")
    for raw, script in SCRIPTS.items():
        expr = F.when(F.trim(name) == raw, F.lit(script)).otherwise(expr)
    return expr


def detect_script(text: Column) -> Column:
    """latin, devanagari, mixed or unknown, from the share of letters."""

    def script(n: Column) -> Column:
        share = n["latin"] / (n["latin"] + n["deva"])
        return (
            F.when(n["latin"].isNull() | (n["latin"] + n["deva"] == 0), "unknown")
            .when((share >= MIXED_SHARE) & (share <= 1 - MIXED_SHARE), "mixed")
            .when(share > 0.5, "latin")
            .otherwise("devanagari")
        )

    def letters(t: Column) -> Column:
        return F.struct(F.length(F.regexp_replace(t, r"[^\p{IsLatin}]+", "")).alias("latin"), F.length(F.regexp_replace(t, r"[^\p{IsDevanagari}]+", "")).alias("deva"))

    return once(once(text, letters), script)


def language_of_page(text: Column, hint: Column) -> Column:
    """Language from script; the hint decides where script alone cannot."""

    def guess(script: Column) -> Column:
        return F.when(script == "latin", "eng").when(script == "mixed", "mixed").when(script == "devanagari", "dev")

    return F.coalesce(hint, once(detect_script(text), guess), F.lit("unknown"))


def normalize_rotation(degrees: Column, width: Column, height: Column) -> Column:
    """Struct (rotation, width, height) after turning the page upright."""
    rotation = F.pmod(degrees, F.lit(360))
    turned = rotation.isin(90, 270)
    return F.struct(
        rotation.alias("rotation"),
        F.when(turned, height).otherwise(width).alias("width"),
        F.when(turned, width).otherwise(height).alias("height"),
    )


def tier_for(content_type: Column) -> Column:
    expr = F.lit(1)
    for name, tier in TIERS.items():
        expr = F.when(content_type == name, F.lit(tier)).otherwise(expr)
    return expr


def variation(value: Column) -> Column:
    """Coefficient of variation as an aggregate: population deviation over mean."""
    mean = F.avg(value)
    return F.when(mean <= 1e-9, F.lit(0.0)).otherwise(F.stddev_pop(value) / mean)


def coefficient_of_variation(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(variation(F.col(value)).alias("cv"))


def content_type_vote(components: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, content_type, confidence) from component heights and stroke widths."""
    ceiling = F.greatest(F.lit(MIN_GLYPH_HEIGHT + 1), F.floor(F.col("page_h") * MAX_GLYPH_FRACTION))
    glyph = F.col("height").between(F.lit(MIN_GLYPH_HEIGHT), ceiling) & (F.col("area") >= MIN_GLYPH_AREA)
    height = F.when(glyph, F.col("height").cast("double"))
    stroke = F.when(F.col("stroke") > 0.5, F.col("stroke"))
    stats = components.groupBy(page).agg(
        F.count(height).alias("_n"),
        F.coalesce(variation(height), F.lit(0.0)).alias("_cvh"),
        F.count(stroke).alias("_ns"),
        F.coalesce(variation(stroke), F.lit(0.0)).alias("_cvs"),
    )
    cvs = F.when(F.col("_ns") < MIN_STROKES, F.lit(0.0)).otherwise(F.col("_cvs"))
    score = HEIGHT_WEIGHT * F.col("_cvh") / HEIGHT_CV + (1 - HEIGHT_WEIGHT) * cvs / STROKE_CV
    few = F.col("_n") < MIN_COMPONENTS
    return stats.select(
        page,
        F.when(few, "unknown").when(score >= 1.0, "handwritten").otherwise("typed").alias("content_type"),
        F.when(few, F.lit(0.0)).otherwise(F.least(F.abs(score - 1.0), F.lit(1.0))).alias("confidence"),
    )


def blank_page_by_variance(samples: DataFrame, page: str, value: str, threshold: float) -> DataFrame:
    return samples.groupBy(page).agg(F.var_pop(value).alias("variance")).withColumn(
        "is_blank", F.col("variance") < threshold
    )


def otsu_threshold(samples: DataFrame, group: str, value: str) -> DataFrame:
    """(group, cut): histogram cut of maximal between-class variance; lowest cut on ties.

    ``value`` must be a level (an integer grey level, say).  Samples collapse to a histogram
    before anything is ordered, so the window sees one row per level and group.
    """
    levels = samples.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_level")).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(group).orderBy("_level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(group)
    mass = F.col("_n") * F.col("_level").cast("double")
    cum = levels.select(
        group, "_level",
        F.sum("_n").over(up).cast("double").alias("_w0"),
        F.sum(mass).over(up).alias("_m0"),
        F.sum("_n").over(whole).cast("double").alias("_w"),
        F.sum(mass).over(whole).alias("_m"),
    )
    w1 = F.col("_w") - F.col("_w0")
    between = F.when(
        w1 > 0,
        F.col("_w0") * w1 * F.pow(F.col("_m0") / F.col("_w0") - (F.col("_m") - F.col("_m0")) / w1, F.lit(2.0)),
    ).otherwise(F.lit(0.0))
    # rounded so that equal variances stay equal whatever the order of summation
    return cum.groupBy(group).agg(
        F.max_by("_level", F.struct(F.round(between, 6), -F.col("_level").cast("double"))).alias("cut")
    )


def median_in_band(df: DataFrame, group: str, value: str, band: float) -> DataFrame:
    """Median of values within ±band per group, the mean of the middle two if even; 0.0 when the group has none.

    Distinct values are counted first and dealt by range, which cuts a large group over many
    partitions.  Counts of the partitions tell which one holds the middle ranks, and only those are
    numbered; no task sees all values of a group.
    """
    inside = F.when(F.abs(F.col(value)) <= band, F.col(value))
    counted = df.groupBy(F.col(group).alias("_g"), inside.alias("_v")).agg(F.count("*").alias("_n"))
    placed = cut_lineage(counted.repartitionByRange(F.asc("_g"), F.asc("_v")).withColumn("_part", F.spark_partition_id()))
    good = placed.filter("_v IS NOT NULL")
    sizes = good.groupBy("_g", "_part").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_m").over(Window.partitionBy("_g"))
    shifts = sizes.select(
        F.col("_g").alias("_h"), F.col("_part").alias("_p"), "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
        F.floor((total - 1) / 2).alias("_low"), F.floor(total / 2).alias("_high"),
    ).filter((F.col("_before") <= F.col("_high")) & (F.col("_before") + F.col("_m") > F.col("_low")))
    middle = good.join(shifts, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_part") == F.col("_p")))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    numbered = middle.withColumn("_upto", upto)
    taken = [((F.col("_upto") - F.col("_n") <= F.col(r)) & (F.col(r) < F.col("_upto"))).cast("int") for r in ("_low", "_high")]
    found = numbered.select("_g", (F.col("_v") * (taken[0] + taken[1])).cast("double").alias("_x"))
    both = found.unionByName(placed.select("_g", F.lit(0.0).alias("_x")))
    return both.groupBy(F.col("_g").alias(group)).agg((F.sum("_x") / 2).alias("median"))


def projection_sharpness(
    profile: DataFrame, page: str, candidate: str, row: str, total: str, rows: int | Column
) -> DataFrame:
    """Per page the candidate whose row profile changes most between neighbouring rows.

    ``profile`` holds non-zero row totals, rows numbered 0 … rows-1.  Each total goes to the
    edge above and the edge below it with opposite sign; summing per edge gives the
    difference of neighbours without ordering a page's rows in one task.
    """
    count = rows if isinstance(rows, Column) else F.lit(rows)
    edges = profile.select(
        page, candidate,
        F.explode(
            F.array(
                F.struct(F.col(row).alias("edge"), (-F.col(total)).alias("delta")),
                F.struct((F.col(row) - 1).alias("edge"), F.col(total).alias("delta")),
            )
        ).alias("e"),
    ).filter((F.col("e.edge") >= 0) & (F.col("e.edge") < count - 1))
    diffs = edges.groupBy(page, candidate, F.col("e.edge")).agg(F.sum("e.delta").alias("d"))
    scores = diffs.groupBy(page, candidate).agg(F.sum(F.col("d") * F.col("d")).alias("score"))
    best = scores.groupBy(page).agg(
        F.max(F.struct(F.round("score", 4).alias("score"), (-F.col(candidate)).alias("c"))).alias("b")
    )
    return best.select(page, (-F.col("b.c")).alias(candidate), F.col("b.score").alias("score"))


Detector = Callable[[pd.DataFrame], pd.DataFrame]


def detect_content_type(pages: DataFrame, detector: Detector, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Pluggable detector over page rows, Arrow batch by batch.

    ``detector`` maps a batch with ``columns`` to a frame (content_type, confidence).  A batch
    that fails is halved until the failing pages stand alone; only those become unknown / 0.0.
    ``strict`` lets the error end the job.
    """
    keep = list(dict.fromkeys(["page_id", *columns]))
    schema = "page_id string, content_type string, confidence double"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        found = detector(rows[list(columns)])
        return pd.DataFrame(
            {"page_id": rows["page_id"].to_numpy(), "content_type": found["content_type"].to_numpy(),
             "confidence": found["confidence"].to_numpy(dtype="float64")}
        )

    def tolerant(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield one(rows)
        except Exception:  # noqa: BLE001 - a detector may fail in any way; the page degrades
            if strict:
                raise
            if len(rows) == 1:
                yield pd.DataFrame({"page_id": rows["page_id"].to_numpy(), "content_type": ["unknown"], "confidence": [0.0]})
                return
            half = len(rows) // 2
            yield from tolerant(rows.iloc[:half])
            yield from tolerant(rows.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield from tolerant(rows)

    return pages.select(*keep).mapInPandas(run, schema)

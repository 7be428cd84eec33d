"""Registered queries: page statistics, windows, small scalars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.cleaning import safe_int
from ..operators import triage as T
from ..operators.dedup import dedup_messages, dedup_within
from ..operators.graph import name_variants
from ..operators.merge import last_write_wins
from ..operators.route import list_pages, pages_per_document
from .registry import case

_CV = "CASE WHEN avg({x}) <= 1e-9 THEN 0.0 ELSE stddev_pop({x}) / avg({x}) END"


@case("osd_confidence", "SELECT page_id, round(CASE WHEN osd_conf > 0 THEN least(osd_conf / 5.0, 1.0) ELSE 0.0 END, 6) AS conf FROM bundle_pages", "bundle_pages")
def _(t):
    return t("bundle_pages").select("page_id", F.round(T.osd_confidence(F.col("osd_conf")), 6).alias("conf"))


@case("safe_int", "SELECT page_id, cast(round_even(osd_conf / 2.0, 0) AS bigint) AS n FROM bundle_pages UNION ALL SELECT page_id, 0 FROM bundle_pages WHERE page_type IS NULL", "bundle_pages")
def _(t):
    p = t("bundle_pages")
    texts = p.select("page_id", (F.col("osd_conf") / 2.0).cast("string").alias("s")).union(
        p.filter("page_type IS NULL").select("page_id", F.lit("n/a"))
    )
    return texts.select("page_id", safe_int(F.col("s")).cast("bigint").alias("n"))


@case("map_script", "SELECT page_id, CASE osd_script WHEN 'Latin' THEN 'latin' WHEN 'Devanagari' THEN 'devanagari' ELSE 'unknown' END AS script FROM bundle_pages", "bundle_pages")
def _(t):
    return t("bundle_pages").select("page_id", T.map_script(F.col("osd_script")).alias("script"))


@case("normalize_rotation", """SELECT page_id, cast(r AS bigint) AS rotation, cast(CASE WHEN r IN (90, 270) THEN height ELSE width END AS bigint) AS width,
    cast(CASE WHEN r IN (90, 270) THEN width ELSE height END AS bigint) AS height FROM (SELECT *, osd_rotate % 360 AS r FROM bundle_pages)""", "bundle_pages")
def _(t):
    n = T.normalize_rotation(F.col("osd_rotate"), F.col("width"), F.col("height"))
    return t("bundle_pages").select("page_id", *[n[c].cast("bigint").alias(c) for c in ("rotation", "width", "height")])


_VOTE = f"""stats AS (SELECT page_id, count(*) FILTER (g) AS n, coalesce({_CV.format(x='CASE WHEN g THEN cast(height AS double) END')}, 0.0) AS cvh,
      count(*) FILTER (stroke > 0.5) AS ns, coalesce({_CV.format(x='CASE WHEN stroke > 0.5 THEN stroke END')}, 0.0) AS cvs
    FROM (SELECT *, height BETWEEN 6 AND greatest(7, floor(page_h * 0.25)) AND area >= 4 AS g FROM component_measurements) GROUP BY 1),
    vote AS (SELECT page_id, n, 0.5 * cvh / 0.35 + 0.5 * CASE WHEN ns < 50 THEN 0.0 ELSE cvs END / 0.45 AS score FROM stats),
    typed AS (SELECT page_id, CASE WHEN n < 12 THEN 'unknown' WHEN score >= 1.0 THEN 'handwritten' ELSE 'typed' END AS content_type,
      round(CASE WHEN n < 12 THEN 0.0 ELSE least(abs(score - 1.0), 1.0) END, 6) AS confidence FROM vote)"""


@case("content_type_vote", f"WITH {_VOTE} SELECT page_id, content_type, confidence FROM typed", "component_measurements")
def _(t):
    return T.content_type_vote(t("component_measurements")).withColumn("confidence", F.round("confidence", 6))


@case("tier_for", f"WITH {_VOTE} SELECT page_id, cast(CASE content_type WHEN 'handwritten' THEN 2 ELSE 1 END AS bigint) AS tier FROM typed", "component_measurements")
def _(t):
    return T.content_type_vote(t("component_measurements")).select("page_id", T.tier_for(F.col("content_type")).cast("bigint").alias("tier"))


@case("coefficient_of_variation", f"SELECT page_id, round({_CV.format(x='stroke')}, 6) AS cv FROM component_measurements GROUP BY 1", "component_measurements")
def _(t):
    return T.coefficient_of_variation(t("component_measurements"), "page_id", "stroke").withColumn("cv", F.round("cv", 6))


@case("blank_page_by_variance", "SELECT page_id, round(var_pop(height), 4) AS variance, var_pop(height) < 200.0 AS is_blank FROM component_measurements GROUP BY 1", "component_measurements")
def _(t):
    return T.blank_page_by_variance(t("component_measurements"), "page_id", "height", 200.0).withColumn("variance", F.round("variance", 4))


@case("otsu_threshold", """WITH h AS (SELECT page_id, height AS lv, count(*) AS n FROM component_measurements GROUP BY 1, 2),
    cuts AS (SELECT c.page_id, c.lv, sum(CASE WHEN o.lv <= c.lv THEN o.n ELSE 0 END) AS w0, sum(CASE WHEN o.lv > c.lv THEN o.n ELSE 0 END) AS w1,
      sum(CASE WHEN o.lv <= c.lv THEN o.n * o.lv ELSE 0 END) AS m0, sum(CASE WHEN o.lv > c.lv THEN o.n * o.lv ELSE 0 END) AS m1
      FROM h c JOIN h o ON c.page_id = o.page_id GROUP BY 1, 2),
    v AS (SELECT page_id, lv, round(CASE WHEN w1 > 0 THEN cast(w0 AS double) * w1 * pow(cast(m0 AS double) / w0 - cast(m1 AS double) / w1, 2) ELSE 0.0 END, 6) AS b FROM cuts)
    SELECT page_id, lv AS cut FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY b DESC, lv) AS rn FROM v) WHERE rn = 1""", "component_measurements")
def _(t):
    return T.otsu_threshold(t("component_measurements"), "page_id", "height")


@case("median_in_band", "SELECT page_id, coalesce(median(CASE WHEN abs(a) <= 5.0 THEN a END), 0.0) AS median FROM (SELECT page_id, (height - 25) / 2.0 AS a FROM component_measurements) GROUP BY 1",
      "component_measurements")
def _(t):
    angles = t("component_measurements").select("page_id", ((F.col("height") - 25) / 2.0).alias("angle"))
    return T.median_in_band(angles, "page_id", "angle", 5.0)


_PROFILE = "profile AS (SELECT cast(l_orderkey % 500 AS bigint) AS page, cast(l_linenumber AS bigint) AS angle, cast(l_quantity AS bigint) - 1 AS r, cast(sum(l_partkey) AS double) AS total FROM lineitem GROUP BY 1, 2, 3)"


@case("projection_sharpness", f"""WITH {_PROFILE}, grid AS (SELECT p.page, p.angle, g.r, coalesce(f.total, 0.0) AS total
      FROM (SELECT DISTINCT page, angle FROM profile) p CROSS JOIN (SELECT unnest(range(0, 50)) AS r) g LEFT JOIN profile f ON f.page = p.page AND f.angle = p.angle AND f.r = g.r),
    d AS (SELECT page, angle, lead(total) OVER (PARTITION BY page, angle ORDER BY r) - total AS diff FROM grid),
    s AS (SELECT page, angle, round(sum(diff * diff), 4) AS score FROM d GROUP BY 1, 2)
    SELECT page, angle, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, angle) AS rn FROM s) WHERE rn = 1""")
def _(t):
    profile = t("lineitem").groupBy(
        F.pmod("l_orderkey", F.lit(500)).alias("page"), F.col("l_linenumber").cast("bigint").alias("angle"),
        (F.col("l_quantity").cast("bigint") - 1).alias("r"),
    ).agg(F.sum("l_partkey").cast("double").alias("total"))
    return T.projection_sharpness(profile, "page", "angle", "r", "total", 50)


@case("last_write_wins", "SELECT document_id, page_num, arg_max(payload, seq) AS payload, max(seq) AS seq FROM bundle_pages_raw GROUP BY 1, 2", "bundle_pages_raw")
def _(t):
    return last_write_wins(t("bundle_pages_raw"), ["document_id", "page_num"], "seq")


@case("dedup_within_5_minutes", """WITH RECURSIVE seen AS (SELECT DISTINCT event_type AS k, ts FROM events),
    kept AS (SELECT k, min(ts) AS ts FROM seen GROUP BY k
      UNION ALL SELECT s.k, min(s.ts) FROM kept q JOIN seen s ON s.k = q.k AND s.ts >= q.ts + INTERVAL 5 MINUTE GROUP BY s.k)
    SELECT k AS event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM kept""")
def _(t):
    kept = dedup_within(t("events"), "event_type", "ts")
    return kept.select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@case("dedup_messages", """WITH RECURSIVE seen AS (SELECT DISTINCT event_type AS k, ts FROM events WHERE value >= 5),
    kept AS (SELECT k, min(ts) AS ts FROM seen GROUP BY k
      UNION ALL SELECT s.k, min(s.ts) FROM kept q JOIN seen s ON s.k = q.k AND s.ts >= q.ts + INTERVAL 5 MINUTE GROUP BY s.k)
    SELECT e.event_id, e.event_type, e.user_id FROM events e JOIN (SELECT min(event_id) AS event_id FROM events JOIN kept ON event_type = k AND events.ts = kept.ts WHERE value >= 5 GROUP BY k, kept.ts) USING (event_id)
    UNION ALL SELECT event_id, NULL, user_id FROM events WHERE NOT value >= 5""")
def _(t):
    """Whole messages; those of small value have lost their key."""
    events = t("events").withColumn("event_type", F.when(F.col("value") >= 5, F.col("event_type"))).filter("value IS NOT NULL")
    return dedup_messages(events, "event_type", "ts", "event_id").select("event_id", "event_type", "user_id")


@case("list_pages", "SELECT page_id, page_num, page_type FROM bundle_pages WHERE document_id = '42' ORDER BY page_num", "bundle_pages")
def _(t):
    return list_pages(t("bundle_pages"), "42").select("page_id", "page_num", "page_type")


@case("pages_per_document", "SELECT document_id, count(*) AS page_count FROM bundle_pages GROUP BY 1", "bundle_pages")
def _(t):
    return pages_per_document(t("bundle_pages"))


@case("name_variants", """SELECT registration_no, lower(trim(applicant_name_raw)) AS variant, count(*) AS n FROM applicants a JOIN belongs_to b ON a.document_id = b.document_id
    WHERE applicant_name_raw IS NOT NULL GROUP BY 1, 2""", ("applicants", "belongs_to"))
def _(t):
    named = t("applicants").filter("applicant_name_raw IS NOT NULL").join(t("belongs_to"), "document_id")
    return name_variants(named, "registration_no", "applicant_name_raw")


def _detector(rows: pd.DataFrame) -> pd.DataFrame:
    """A stand-in model: wide pages are typed; it cannot read some pages at all."""
    if ((rows["q"] == 50) & (rows["osd_conf"] >= 8)).any():
        raise ValueError("unreadable page")
    wide = rows["width"] * 2 > rows["height"] * 3 - 6
    return pd.DataFrame({"content_type": wide.map({True: "typed", False: "handwritten"}), "confidence": (rows["q"] / 50.0).round(6)})


@case("pluggable_detector", """SELECT page_id, CASE WHEN q = 50 AND osd_conf >= 8 THEN 'unknown' WHEN width * 2 > height * 3 - 6 THEN 'typed' ELSE 'handwritten' END AS content_type,
    CASE WHEN q = 50 AND osd_conf >= 8 THEN 0.0 ELSE round(q / 50.0, 6) END AS confidence FROM bundle_pages""", "bundle_pages")
def _(t):
    return T.detect_content_type(t("bundle_pages"), _detector, ["q", "width", "height", "osd_conf"])

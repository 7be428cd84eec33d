"""Matching documents against the registry, exactly and by nearness of names and dates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.cleaning import devanagari_digits
from ..functions.plan import before_fan_out, fence, once
from ..session import cut_lineage
from .joins import left_join_spread_nulls
from .partial import letter_bits, nearest

DEFAULT_SCORE = 85.0  # ours: the accept threshold is left open by the design
DATE_LENGTH = 8


def sorted_tokens(c: Column) -> Column:
    """Lower-case words in order, one space between: word order stops mattering."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def token_sort_similarity(a: Column, b: Column) -> Column:
    """0–100: one minus edits over the longer length, on sorted words.

    Levenshtein edits, so the figure is at most that of an insert/delete-only ratio.
    """
    x, y = sorted_tokens(a), sorted_tokens(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(x, y) / longest))


def ratio(a: Column, b: Column) -> Column:
    """0–100: one minus Levenshtein edits over the longer length, case and order kept; 100 for two empty texts."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(x, y) / longest))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shorter text with any stretch of its length in the longer; 0 if only one is empty."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    swap = F.length(x) > F.length(y)
    short, long = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    size = F.length(short)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.length(long) - size + 1), lambda i: 100.0 * (1 - F.levenshtein(short, F.substring(long, i, size)) / size)))
    return F.when((size == 0) & (F.length(long) == 0), F.lit(100.0)).when(size == 0, F.lit(0.0)).otherwise(best)


def weighted_ratio(a: Column, b: Column) -> Column:
    """Best of ratio, 0.95 token sort, and 0.9 partial ratio where one text is 1.5 times as long, 0.6 beyond 8 times.

    The factors are ours; each measure is as documented above.
    """
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    low, high = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    factor = F.when(high < 1.5 * low, F.lit(0.0)).when(high <= 8 * low, F.lit(0.9)).otherwise(F.lit(0.6))
    return F.greatest(ratio(x, y), 0.95 * token_sort_similarity(x, y), factor * partial_ratio(x, y))


def lcs_length(a: str, b: str) -> int:
    """Letters of the longest common subsequence; the states of all places of ``a`` are bits of one number."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for letter in b:
        met = open_ & places.get(letter, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(a) - open_.bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs_length`` of many pairs at once; pairs with more than 62 letters or a zero letter one by one."""
    out = np.zeros(len(a), dtype=np.int32)
    plain = [i for i, (x, y) in enumerate(zip(a, b)) if len(x) <= 62 and len(y) <= 62 and "\0" not in x and "\0" not in y]
    for i in set(range(len(a))) - set(plain):
        out[i] = lcs_length(a[i], b[i])
    size = max((max(len(a[i]), len(b[i])) for i in plain), default=0)
    if not size:
        return out
    points = [np.array([t[i] for i in plain], dtype=f"U{size}").view(np.uint32).reshape(len(plain), size) for t in (a, b)]
    letters = np.unique(np.concatenate(points))
    x, y = (np.searchsorted(letters, p) for p in points)
    rows, one = np.arange(len(plain)), np.uint64(1)
    places = np.zeros((len(plain), len(letters)), dtype=np.uint64)
    for i in range(size):
        places[rows, x[:, i]] |= one << np.uint64(i)
    if letters[0] == 0:  # padding is no letter
        places[:, 0] = 0
    full = (one << (points[0] != 0).sum(axis=1).astype(np.uint64)) - one
    open_ = full.copy()
    for j in range(size):
        met = open_ & places[rows, y[:, j]]
        open_ = ((open_ + met) | (open_ - met)) & full
    out[plain] = np.bitwise_count(full) - np.bitwise_count(open_)
    return out


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(list(a), list(b)), dtype="int32")


def indel_ratio(a: Column, b: Column) -> Column:
    """0–100: twice the longest common subsequence over both lengths; 100 for two empty texts.

    Only insertions and deletions count, so a replaced letter costs two.  Runs in Arrow batches.
    """
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    both = F.length(x) + F.length(y)
    return F.when(both == 0, F.lit(100.0)).otherwise(100.0 * (1 - (both - 2 * _common(x, y)) / both))


def registration_key(text: Column) -> Column:
    """Digits of a registration text as int; null when there are none or too many."""
    digits = F.regexp_replace(devanagari_digits(text), r"[^0-9]", "")
    return F.nullif(digits, F.lit("")).try_cast("int")


def _whole(value: Column) -> Column:
    return F.floor(value + 1e-9).cast("int")


def _cuts(n: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of part i when n letters are cut into edits + 1 parts, the longer ones last."""
    parts = edits + 1
    base, short = F.floor(n / parts).cast("int"), parts - n % parts
    return i * base + F.greatest(i - short, F.lit(0)), base + (i >= short).cast("int")


def _up_to(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


WHOLE = 4_000_000  # pairs of a block up to which it is compared whole
ROWS = 100_000  # texts of a block that one task holds at most


def _large_blocks(left: DataFrame, right: DataFrame, rows: int | None = None) -> DataFrame | None:
    """Blocks of more than ``WHOLE`` pairs or ``rows`` texts; each has thousands of rows, so they are few.  None if there are none."""
    sizes = left.groupBy("block").agg(F.count("*").alias("_a")).join(right.groupBy("block").agg(F.count("*").alias("_b")), "block", "inner" if rows is None else "full")
    over = F.col("_a").cast("double") * F.col("_b") > WHOLE
    if rows is not None:  # also of blocks that only one side has
        over = F.coalesce(over, F.lit(False)) | (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0)) > rows)
    large = cut_lineage(sizes.filter(over).select("block"))
    return None if large.isEmpty() else large


@F.pandas_udf(StructType([StructField("bits0", LongType()), StructField("bits1", LongType())]))
def _letter_bits(texts: pd.Series) -> pd.DataFrame:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    bits = letter_bits(points, texts.str.len().to_numpy(dtype=np.int64))
    return pd.DataFrame(bits.view(np.int64), columns=["bits0", "bits1"])


def _signed(df: DataFrame) -> DataFrame:
    """Rows with the bits of their letters, dealt out by block."""
    signed = before_fan_out(df).withColumn("_bits", _letter_bits("text"))
    signed = signed.select(*df.columns, F.col("_bits.bits0").alias("_bits0"), F.col("_bits.bits1").alias("_bits1"))
    return signed.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").withColumn("_length", F.length("text"))


def _lacking(a: str, b: str) -> Column:
    """Letters of text a that b has not, at least: no fewer edits lead from a to b, or to a stretch of b."""
    return sum((F.bit_count(F.col(f"{a}_bits{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}_bits{i}")))) for i in (0, 1)), F.lit(0))


def _in_blocks(left: DataFrame, right: DataFrame, near: Column) -> DataFrame:
    """Pairs of one block that are ``near``, a bound on columns of the left and, behind ``_r``, of the right."""
    theirs = _signed(right)
    theirs = theirs.select(*[F.col(c).alias(c if c == "block" else f"_r{c}") for c in theirs.columns])
    return _signed(left).join(theirs.hint("merge"), "block").filter(near)


def best_edit_match(left: DataFrame, right: DataFrame, score: float, measure: str = "edits") -> DataFrame:
    """Nearest right text for each left (block, text), if it scores at least ``score``.

    left: distinct (block, text).  right: (block, text, payload).  Either may have a column
    ``weight``: the length that edits are weighed against, the same for a whole block; null or
    absent means the longer of the two texts.  Result: (block, text, payload, edits, score), one
    row per left text with a partner; ties go to the smallest payload.

    measure: ``edits`` (Levenshtein over the longer length) or ``indel`` (insertions and deletions
    over both lengths, see indel_ratio; without weights).

    The score alone decides.  It bounds the edits k of a pair.  A block of at most ``WHOLE`` pairs is
    compared whole: bits of the letters of both texts rule most pairs out before edits are counted.
    In a larger one the right text is cut into k + 1 parts, of which one stands unchanged in any
    left text that near, shifted by no more than the edits around it.  Candidates come from an
    equi-join on (block, length, part number, part), and are then measured.  A text shorter than
    k + 1 letters can lose every part; it is keyed by its length alone.

    Equal texts are settled first by a plain join.  What is left is asked at half the distance to
    the score, and only what finds nothing there at the score itself.
    """
    if not 0 < score <= 100:
        raise ValueError("score must be above 0 and at most 100")
    indel = {"edits": False, "indel": True}[measure]
    if indel and "weight" in {*left.columns, *right.columns}:
        raise ValueError("indel edits are weighed against both lengths only")
    def weighed(df: DataFrame) -> DataFrame:
        return df if "weight" in df.columns else df.withColumn("weight", F.lit(None).cast("int"))

    targets = weighed(right).filter(F.col("text").isNotNull()).groupBy("block", "text", "weight").agg(F.min("payload").alias("payload"))
    equal = targets.groupBy("block", "text").agg(F.min("payload").alias("payload"), F.lit(True).alias("_met"))
    asked = cut_lineage(weighed(left).filter("block IS NOT NULL AND text IS NOT NULL").join(equal.hint("merge"), ["block", "text"], "left"))
    found = asked.filter("_met").select("block", "text", "payload", F.lit(0).alias("edits"), F.lit(100.0).alias("score"))
    rest = asked.filter("_met IS NULL").select("block", "text", "weight")
    if score == 100:
        return found
    large = _large_blocks(rest, targets)
    near = cut_lineage(_at_score(rest, targets, (score + 100) / 2, indel, large))
    rest = rest.join(near.select("block", "text").hint("merge"), ["block", "text"], "left_anti")
    return found.unionByName(near).unionByName(_at_score(rest, targets, score, indel, large))


def _at_score(left: DataFrame, targets: DataFrame, score: float, indel: bool, large: DataFrame | None) -> DataFrame:
    """``best_edit_match`` of what has no equal: left (block, text, weight) and targets (block, text, weight, payload)."""
    share = score / 100
    n, m = F.length("text"), F.length("_rtext")
    longest = n + m if indel else F.coalesce(F.col("weight"), F.greatest(n, m))
    most = _whole((1 - share) * longest)
    apart = _lacking("", "_r") + _lacking("_r", "") if indel else F.greatest(_lacking("", "_r"), _lacking("_r", ""))
    sizes = F.col("_length") + F.col("_r_length") if indel else F.coalesce(F.col("weight"), F.greatest("_length", "_r_length"))
    bound = _whole((1 - share) * sizes)
    columns = ["block", "text", "weight", "_rtext", "_rpayload"]

    small = [df if large is None else df.join(F.broadcast(large), "block", "left_anti") for df in (left, targets)]
    pairs = _in_blocks(*small, (F.abs(F.col("_length") - F.col("_r_length")) <= bound) & (apart <= bound)).select(*columns)
    if large is not None:
        pairs = pairs.unionByName(_by_parts(*[df.join(F.broadcast(large), "block", "left_semi") for df in (left, targets)], score, indel).select(*columns))
    # beyond the most allowed edits the count is -1
    pairs = fence(pairs, _edits=F.call_function("levenshtein", F.col("text"), F.col("_rtext"), most)).filter("_edits >= 0")
    # replacing is allowed to Levenshtein, so it never counts more; a pair met by several parts is
    # measured again, which is cheaper than bringing equal pairs together
    edits = longest - 2 * _common(F.col("text"), F.col("_rtext")) if indel else F.col("_edits")
    scored = pairs.select("block", "text", F.col("_rpayload").alias("payload"), edits.alias("edits"), longest.alias("_len"))
    value = F.when(F.col("_len") == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.col("edits") / F.col("_len")))
    scored = scored.withColumn("score", value).filter(F.col("score") >= score)
    best = scored.groupBy("block", "text").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("payload"), F.col("edits"))).alias("b"))
    return best.select("block", "text", F.col("b.payload").alias("payload"), F.col("b.edits").alias("edits"), (-F.col("b.s")).alias("score"))


def _by_parts(left: DataFrame, targets: DataFrame, score: float, indel: bool) -> DataFrame:
    """Pairs that share a part: (block, text, weight, _rtext, _rpayload), some more than once."""
    share = score / 100
    # how many edits a letter of one text allows, and how much longer the other may be
    per_letter, longer = (2 * (1 - share) / share, (2 - share) / share) if indel else ((1 - share) / share, 1 / share)

    def allowed(n: Column) -> Column:
        return F.when(F.col("weight").isNotNull(), _whole((1 - share) * F.col("weight"))).otherwise(_whole(per_letter * n))

    n, k, i, m = F.col("_n"), F.col("_k"), F.col("_i"), F.col("_m")
    no_parts = F.array(F.lit(-1))

    def key(text: Column) -> Column:
        return F.xxhash64("block", n, i, text)

    r_rows = before_fan_out(targets).withColumn("_n", F.length("text")).withColumn("_k", allowed(n))
    r_rows = r_rows.withColumn("_i", F.explode(F.when(k >= n, no_parts).otherwise(F.sequence(F.lit(0), k))))
    start, size = _cuts(n, k, i)
    part = F.when(i < 0, F.lit("")).otherwise(F.substring(F.col("text"), start + 1, size))
    r_side = r_rows.select(key(part).alias("_key"), F.col("block").alias("_rblock"), F.col("text").alias("_rtext"), F.col("payload").alias("_rpayload"))

    fixed = _whole((1 - share) * F.col("weight"))
    low = F.when(F.col("weight").isNotNull(), F.greatest(m - fixed, F.lit(0))).otherwise(F.ceil(m / longer - 1e-9).cast("int"))
    high = F.when(F.col("weight").isNotNull(), m + fixed).otherwise(_whole(m * longer))
    lengths = targets.agg(F.collect_set(F.length("text")).alias("_lengths"))  # one row; lengths that no target has are not asked for
    l_rows = before_fan_out(left).crossJoin(F.broadcast(lengths)).withColumn("_m", F.length("text"))
    l_rows = l_rows.withColumn("_n", F.explode(F.filter("_lengths", lambda z: z.between(low, high)))).drop("_lengths").withColumn("_k", allowed(n))
    l_rows = l_rows.withColumn("_i", F.explode(F.when(k >= n, no_parts).otherwise(F.sequence(F.lit(0), k))))
    over = m - n
    first = F.greatest(start + F.greatest(-i, over - (k - i)), F.lit(0))
    last = F.least(start + F.least(i, over + (k - i)), m - size)
    l_rows = l_rows.withColumn("_at", F.explode(F.when(i < 0, F.array(F.lit(0))).otherwise(_up_to(first, last))))
    part = F.when(i < 0, F.lit("")).otherwise(F.substring(F.col("text"), F.col("_at") + 1, size))
    l_side = l_rows.select("block", "text", "weight", key(part).alias("_key"))

    # size estimates do not see the fan-out, so broadcasting either side is ruled out
    return l_side.join(r_side.hint("merge"), "_key").filter(F.col("block") == F.col("_rblock"))


PART = 8  # letters of a part that are looked up at most


def _partial_score(a: Column, b: Column, share: float) -> Column:
    """``partial_ratio`` where it is at least 100 * share, else something below."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    size = F.length(short)

    def best(s: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(1), F.length(s["long"]) - s["size"] + 1), lambda i: F.substring(s["long"], i, s["size"]))
        edits = F.transform(stretches, lambda t: F.call_function("levenshtein", s["short"], t, s["most"]))
        return F.array_min(F.filter(edits, lambda e: e >= 0))

    most = _whole((1 - share) * size)
    texts = F.struct(short.alias("short"), long.alias("long"), size.alias("size"), most.alias("most"))
    # what lies beside the stretch adds no more edits than it has letters
    around = F.call_function("levenshtein", short, long, most + F.length(long) - size)
    few = F.length(long) - size <= 3  # stretches that are sooner compared than ruled out
    edits = F.when(F.contains(long, short), 0).when(few, once(texts, best)).when(around >= 0, once(texts, best))
    return F.when((size == 0) & (F.length(long) == 0), F.lit(100.0)).when(size == 0, F.lit(0.0)).otherwise(F.coalesce(100.0 * (1 - edits / size), F.lit(0.0)))


def best_partial_match(left: DataFrame, right: DataFrame, score: float) -> DataFrame:
    """Nearest right text for each left (block, text) by partial_ratio, if it scores at least ``score``.

    left: distinct (block, text).  right: (block, text, payload).  Result: (block, text, payload,
    score), one row per left text with a partner; ties go to the smallest payload.  Null texts have
    no partner; an empty text has only empty ones.

    The score bounds the edits k between the shorter text and a stretch of the longer.  A block of at
    most ``WHOLE`` pairs and ``ROWS`` texts is compared whole, in its task (``nearest``): bits of the letters
    of both texts tell how many edits a pair needs at least, and edits are counted for the most
    promising pairs first, until no other pair of the text can win.
    In a larger one the shorter text is cut into k + 1 parts, of which one stands unchanged in that
    stretch, so every pair at or above the score meets in an equi-join of the parts' first letters
    with all stretches of so many letters of the longer text, either side being the shorter one.
    A text that has an equal one scores 100 and looks only for others that do.
    """
    if not 0 < score <= 100:
        raise ValueError("score must be above 0 and at most 100")
    known = right.filter("text IS NOT NULL AND block IS NOT NULL").groupBy("block", "text").agg(F.min("payload").alias("payload"))
    known = cut_lineage(known)
    asked = cut_lineage(left.select("block", "text").filter("text IS NOT NULL AND block IS NOT NULL").distinct())
    large = _large_blocks(asked, known, ROWS)
    small = [df if large is None else df.join(F.broadcast(large), "block", "left_anti") for df in (asked, known)]
    none = F.lit(None).cast(known.schema["payload"].dataType).alias("payload")
    rows = small[0].select("block", "text", none, F.lit(False).alias("known")).unionByName(small[1].withColumn("known", F.lit(True)))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "payload")
    result = StructType([known.schema["block"], known.schema["text"], known.schema["payload"], StructField("score", DoubleType())])
    best = rows.mapInArrow(lambda batches: nearest(batches, score), result)
    if large is None:
        return best
    share = score / 100
    pairs = _partial_by_parts(*[df.join(F.broadcast(large), "block", "left_semi") for df in (asked, known)], share)
    scored = fence(pairs, score=_partial_score(F.col("text"), F.col("_rtext"), share)).filter(F.col("score") >= score)
    parted = scored.groupBy("block", "text").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_rpayload"))).alias("b"))
    return best.unionByName(parted.select("block", "text", F.col("b._rpayload").alias("payload"), (-F.col("b.s")).alias("score")))


def _partial_by_parts(asked: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """Pairs that share the first letters of a part: distinct (block, text, _rtext, _rpayload)."""
    n, i = F.length("text"), F.col("_i")

    def parts(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_k", _whole((1 - share) * n)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.col("_k"), F.greatest(n - 1, F.lit(0))))))
        start, size = _cuts(n, F.col("_k"), i)
        cut = F.substring(F.col("text"), start + 1, F.least(size, F.lit(PART)))
        return rows.withColumn("_part", F.when(F.col("_k") < n, cut).when(n == 0, F.lit("")).otherwise(F.substring(F.col("text"), i + 1, F.lit(1)))).drop("_k", "_i").distinct()

    def stretches(df: DataFrame) -> DataFrame:
        text = F.col("text")
        of_size = F.transform(_up_to(F.lit(1), F.least(n, F.lit(PART))), lambda z: F.transform(_up_to(F.lit(1), n - z + 1), lambda at: F.substring(text, at, z)))
        return df.withColumn("_part", F.explode(F.when(n == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.flatten(of_size)))))

    def met(ours: DataFrame, theirs: DataFrame, shorter: Column) -> DataFrame:
        theirs = theirs.select(F.col("block").alias("_rblock"), F.col("text").alias("_rtext"), F.col("payload").alias("_rpayload"), F.col("_part").alias("_rpart"))
        same = (F.col("block") == F.col("_rblock")) & (F.col("_part") == F.col("_rpart"))
        return ours.join(theirs.hint("merge"), same).filter(shorter).select("block", "text", "_rtext", "_rpayload")

    ours, theirs = before_fan_out(asked.select("block", "text")), before_fan_out(known)
    a, b = F.length("text"), F.length("_rtext")
    return met(parts(ours), stretches(theirs), a <= b).unionByName(met(stretches(ours), parts(theirs), a > b)).distinct()


def match_registry_names(documents: DataFrame, registry: DataFrame, measure: str, score: float = DEFAULT_SCORE) -> DataFrame:
    """(name, dob) of the documents to the registry row of the same birth date with the nearest name.

    measure: ``partial`` (partial_ratio), ``indel`` or ``edits`` (on word-sorted names all three).
    Result: distinct (_name, dob, reference_data_id, score).
    """
    if measure not in ("partial", "indel", "edits"):
        raise ValueError(f"no measure {measure}")

    def keyed(df: DataFrame, name: str, *more: Column) -> DataFrame:
        rows = df.select(F.date_format("dob", "yyyyMMdd").alias("block"), sorted_tokens(F.col(name)).alias("text"), *more)
        return rows.filter("block IS NOT NULL AND text <> ''")

    contexts, people = keyed(documents, "applicant_name_raw").distinct(), keyed(registry, "full_name", F.col("reference_data_id").alias("payload"))
    found = best_partial_match(contexts, people, score) if measure == "partial" else best_edit_match(contexts, people, score, measure)
    return found.select(F.col("text").alias("_name"), F.col("block").alias("dob"), F.col("payload").alias("reference_data_id"), "score")


def match_registry_exact(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``reference_data_id`` and ``match_status`` from the registration number.

    ``registry``: (registration_no, reference_data_id), one row per number.  Spark broadcasts
    it only while its size statistics allow; beyond that it is a shuffled join with null keys
    spread out and hot keys split by AQE.
    """
    keyed = documents.withColumn("_reg", registration_key(F.col("registration_no_raw")))
    known = registry.select(F.col("registration_no").cast("int").alias("_reg"), "reference_data_id")
    joined = left_join_spread_nulls(keyed, known, ["_reg"], "document_id")
    practitioner = F.col("document_category") == "practitioner"
    return joined.select(
        *documents.columns,
        F.when(practitioner, F.col("reference_data_id")).alias("reference_data_id"),
        F.when(~practitioner, "not_applicable")
        .when(F.col("reference_data_id").isNotNull(), "matched")
        .otherwise("unmatched")
        .alias("match_status"),
    )


def match_registry_fuzzy(documents: DataFrame, registry: DataFrame, score: float = DEFAULT_SCORE) -> DataFrame:
    """(name, dob) of the documents to registry rows with a near name and the same birth date,
    or the same name and a near birth date.

    documents: (applicant_name_raw, dob, …); registry: (full_name, dob, reference_data_id).
    Result: distinct (_name, dob, reference_data_id, score); names are word-sorted.  Edits in a
    name are weighed against the longer name, edits in a birth date against the name they come
    with (eight digits at least).  Work is done on distinct contexts, so a context repeated in
    many documents costs one lookup; both kinds of nearness go through one candidate join.
    """
    name, dob = F.col("_name"), F.col("_dob")
    by_dob = F.struct(F.concat(F.lit("d"), dob).alias("block"), name.alias("text"), F.lit(None).cast("int").alias("weight"))
    by_name = F.struct(F.concat(F.lit("n"), name).alias("block"), dob.alias("text"), F.greatest(F.length(name), F.lit(DATE_LENGTH)).alias("weight"))

    def sides(df: DataFrame, *more: str) -> DataFrame:
        return df.filter((name != "") & dob.isNotNull()).select(*more, F.inline(F.array(by_dob, by_name)))

    def keyed(text: str) -> list[Column]:
        return [sorted_tokens(F.col(text)).alias("_name"), F.date_format("dob", "yyyyMMdd").alias("_dob")]

    contexts = documents.select(*keyed("applicant_name_raw")).distinct()
    people = registry.select(*keyed("full_name"), F.col("reference_data_id").alias("payload"))
    found = best_edit_match(sides(contexts), sides(people, "payload"), score)
    rest, near_name = F.expr("substring(block, 2)"), F.col("block").startswith("d")
    both = found.select(
        F.when(near_name, F.col("text")).otherwise(rest).alias("_name"), F.when(near_name, rest).otherwise(F.col("text")).alias("_dob"), "payload", "score"
    )
    best = both.groupBy("_name", "_dob").agg(F.min(F.struct((-F.col("score")).alias("s"), "payload")).alias("b"))
    return best.select("_name", "_dob", F.col("b.payload").alias("reference_data_id"), (-F.col("b.s")).alias("score"))


def match_registry(documents: DataFrame, registry: DataFrame, score: float = DEFAULT_SCORE) -> DataFrame:
    """Number first, then name and birth date; what stays open goes to manual review.

    registry: (registration_no, full_name, dob, reference_data_id).  Adds reference_data_id,
    match_status and match_method.
    """
    exact = match_registry_exact(documents, registry)
    open_docs = exact.filter(F.col("match_status") == "unmatched")
    found = match_registry_fuzzy(open_docs, registry, score).select(
        "_name", "_dob", F.col("reference_data_id").alias("_fuzzy_id")
    )
    is_open = F.col("match_status") == "unmatched"
    name, dob = sorted_tokens(F.col("applicant_name_raw")), F.date_format("dob", "yyyyMMdd")
    usable = is_open & (name != "") & dob.isNotNull()
    keyed = exact.withColumn("_name", F.when(usable, name)).withColumn("_dob", F.when(usable, dob))
    joined = left_join_spread_nulls(keyed, found, ["_name", "_dob"], "document_id")
    hit = F.col("_fuzzy_id").isNotNull()
    return joined.select(
        *documents.columns,
        F.when(hit, F.col("_fuzzy_id")).otherwise(F.col("reference_data_id")).alias("reference_data_id"),
        F.when(hit, "matched").when(is_open, "manual_review").otherwise(F.col("match_status")).alias("match_status"),
        F.when(hit, "fuzzy").when(F.col("match_status") == "matched", "exact").alias("match_method"),
    )

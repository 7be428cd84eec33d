"""Operators with a hand-made plan, against brute force on small data with hot keys."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bundleflow.operators import dedup, graph, match, retrieve, triage, vectors

T0 = datetime(2024, 1, 1)


def greedy(times, window):
    last, out = None, []
    for t in sorted(set(times)):
        if last is None or t - last >= window:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("chunk,group", [(300, 1), (300, 7), (420, 3), (3600, 1024), (10**6, 2)])
def test_dedup_within_is_exact_for_any_chunk_and_group(spark, chunk, group):
    rng = random.Random(chunk)
    rows = [("hot", T0 + timedelta(seconds=rng.randint(0, 20000))) for _ in range(3000)]  # dense: one long chain
    rows += [(f"k{rng.randint(0, 40)}", T0 + timedelta(seconds=rng.randint(0, 90000), milliseconds=rng.choice([0, 1, 500]))) for _ in range(2000)]
    rows += [("edge", T0 + timedelta(seconds=s)) for s in (0, 299, 300, 599, 600, 601, 900)]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "k string, ts timestamp").repartition(5)
    for r in dedup.dedup_within(df, "k", "ts", 300, chunk, group).collect():
        got[r["k"]].append(r["ts"])
    by_key = defaultdict(list)
    for k, t in rows:
        by_key[k].append(t)
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy(v, timedelta(seconds=300)) for k, v in by_key.items()}


def test_composed_maps_of_many_keys_leave_in_few_frames():
    """A frame for each key costs a thousand times its rows."""
    rows = pd.DataFrame({"k": range(5000), "node": 0, "chunk": 3, "upto": dedup.END_OF_TIME, "leaves": range(5000)})
    frames = list(dedup._group(300)(iter([rows[:1500], rows[1500:]])))
    assert len(frames) <= 2
    got = pd.concat(frames)
    assert got["k"].tolist() == got["leaves"].tolist() == list(range(5000)) and set(got["upto"]) == {dedup.END_OF_TIME}
    assert sum(len(f) for f in dedup._group(300)(iter([]))) == 0


def test_entry_maps_compose_in_any_order():
    rng = random.Random(4)
    window = 10
    for _ in range(300):
        maps = []
        for c in range(6):
            times = sorted(rng.sample(range(20 * c, 20 * c + 20), rng.randint(1, 8)))
            rows = pd.DataFrame({"k": 1, "chunk": c, "us": times})
            maps.append([tuple(r) for r in pd.concat(dedup._entry_maps(window, 20)([rows]))[["upto", "leaves"]].to_numpy().tolist()])
        left = maps[0]
        for m in maps[1:]:
            left = dedup._composed(left, m, window)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = dedup._composed(m, right, window)
        for start in [dedup.BEGIN_OF_TIME, *range(0, 130, 3)]:
            step = start
            for m in maps:
                step = dedup._after(m, step, window)
            assert step == dedup._after(left, start, window) == dedup._after(right, start, window)


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_clusters_chain_hub_and_noise(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1400)]  # long chain
    edges += [(5000, 5001 + i) for i in range(500)]  # hub
    edges += [(rng.randint(8000, 8400), rng.randint(8000, 8400)) for _ in range(250)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["cluster"] for r in graph.entity_clusters(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == components(edges)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("score,longest,weight", [(60.0, 7, None), (85.0, 30, None), (85.0, 30, 24), (30.0, 5, None), (100.0, 3, None)])
def test_edit_match_finds_every_best_partner(spark, score, longest, weight):
    rng = random.Random(longest)
    seeds = ["".join(rng.choice("abc") for _ in range(rng.randint(0, longest))) for _ in range(25)]

    def word():
        w = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        return "".join(w)

    left = {(rng.choice(["hot", "hot", "x"]), word()) for _ in range(150)}
    right = [(rng.choice(["hot", "x"]), word(), i) for i in range(200)]
    out = match.best_edit_match(
        *[df.withColumn("weight", F.lit(weight).cast("int")) for df in (
            spark.createDataFrame(sorted(left), "block string, text string"), spark.createDataFrame(right, "block string, text string, payload int"))], score
    )
    got = {(r["block"], r["text"]): (r["payload"], r["edits"]) for r in out.collect()}
    want = {}
    for b, t in left:
        best = None
        for rb, rt, payload in right:
            d = lev(t, rt) if rb == b else 99
            size = weight or max(len(t), len(rt))
            s = 100.0 * (1 - d / size) if size else 100.0
            if rb == b and s >= score and (best is None or (-s, payload) < best[0]):
                best = ((-s, payload), d)
        if best:
            want[(b, t)] = (best[0][1], best[1])
    assert got == want


def test_match_registry_methods(spark):
    docs = spark.createDataFrame(
        [("1", "practitioner", "I-00005", None, None), ("2", "practitioner", None, "Patil Ashish", "1996-02-26"), ("3", "practitioner", "x", "asish patil", "1996-02-26"),
         ("4", "practitioner", "99999999999", "someone else", "1990-01-01"), ("5", "letter", "5", "Ashish Patil", "1996-02-26"), ("6", "practitioner", "७", None, None),
         ("7", "practitioner", None, "ashish patil", "1996-02-28")],
        "document_id string, document_category string, registration_no_raw string, applicant_name_raw string, d string",
    ).withColumn("dob", F.col("d").cast("date")).drop("d")
    registry = spark.createDataFrame([(5, "ashish patil", "1996-02-26"), (7, "meera joshi", "1980-05-05")], "registration_no int, full_name string, d string").select(
        "registration_no", "full_name", F.col("d").cast("date").alias("dob"), (F.col("registration_no") * 10).alias("reference_data_id")
    )
    got = {r["document_id"]: (r["reference_data_id"], r["match_status"], r["match_method"]) for r in match.match_registry(docs, registry).collect()}
    assert got == {
        "1": (50, "matched", "exact"), "2": (50, "matched", "fuzzy"), "3": (50, "matched", "fuzzy"), "4": (None, "manual_review", None),
        "5": (None, "not_applicable", None), "6": (70, "matched", "exact"), "7": (50, "matched", "fuzzy"),
    }


def test_split_rank_equals_row_number_on_a_hot_group(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("g"), F.round(F.rand(1), 2).alias("score"), F.col("id").cast("string").alias("d")
    ).cache()
    order = [F.desc("score"), F.asc("d")]
    got = retrieve.split_rank(df, "g", order, "rank")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == 6000


@pytest.mark.parametrize("centres", [1, 7, 64, 400])
def test_topk_per_query_is_exact_for_any_cut(spark, centres, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_SLICE", 5)
    monkeypatch.setattr(vectors, "VECTOR_SLICE", 60)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(300, 8)), 1)
    v[17] = 0.0
    q = np.round(rng.normal(size=(12, 8)), 1)
    vdf = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(4)
    qdf = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id bigint, query_vector array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.vector_topk_per_query(vdf, qdf, 5, centres=centres).collect()}
    v32, q32 = v.astype("float32").astype("float64"), q.astype("float32").astype("float64")
    for i in range(12):
        with np.errstate(invalid="ignore"):
            s = np.round(v32 @ q32[i] / (np.linalg.norm(v32, axis=1) * np.linalg.norm(q32[i])), 6)
        best = sorted((x for x in range(300) if x != 17), key=lambda x: (-s[x], x))[:5]
        assert [got[(i, k + 1)][0] for k in range(5)] == best
    assert len(got) == 60


def test_far_cells_are_not_scored(spark):
    rng = np.random.default_rng(6)
    heads = rng.normal(size=(40, 6))
    v = heads[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 6))
    vdf = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(9000, None), (9001, [0.0] * 6)], "vec_id bigint, embedding array<double>").repartition(4)
    qdf = vdf.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    found = vectors.search(vdf, qdf, 10)
    got = {}
    for r in found.hits.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for i in range(0, 4000, 50):
        s = np.round(unit @ unit[i], 6)
        assert [x for _, x in sorted(got[i])] == sorted(range(4000), key=lambda x: (-s[x], x))[:10]
    assert 9000 not in got and len(got) == 80
    assert found.share_scored() < 0.2
    assert vectors.vector_topk_per_query(vdf.limit(0), qdf).count() == 0 and vectors.vector_topk_per_query(vdf, qdf.limit(0)).count() == 0


def test_retrieve_answers_repeated_questions_once_and_for_everyone(spark):
    queries = spark.createDataFrame(
        [(i, "documents of Ashish, DOB 26 Feb 1996") for i in range(40)] + [(90, "documents of Nobody, DOB 26 Feb 1996"), (91, "documents of Ashish"), (92, "all, dob 26 feb 1996")],
        "query_id bigint, query_text string",
    )
    qv = queries.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("query_vector"))
    persons = spark.createDataFrame([(5, "ashish", "1996-02-26")], "registration_no bigint, full_name string, d string").select("registration_no", "full_name", F.col("d").cast("date").alias("dob"))
    belongs = spark.createDataFrame([("a", 5), ("b", 5), ("c", 6)], "document_id string, registration_no bigint")
    pv = spark.createDataFrame([("a", 1, [0.0, 1.0]), ("a", 2, [1.0, 1.0]), ("b", 1, [1.0, 0.0]), ("c", 1, [1.0, 0.0])], "document_id string, page_num bigint, embedding array<double>")
    docs = belongs.select("document_id")
    out = retrieve.retrieve(queries, qv, persons, belongs, pv, docs, pv.select("document_id", "page_num")).collect()
    assert len(out) == 80 and {r["query_id"] for r in out} == set(range(40))
    one = sorted((r["doc_rank"], r["document_id"], r["page_num"], r["score"]) for r in out if r["query_id"] == 7)
    assert one == [(1, "b", 1, 1.0), (2, "a", 2, 0.707107)]


def test_content_type_vote(spark):
    rng = random.Random(1)
    typed = [("typed", 400, 20, 280, 3.0)] * 60
    hand = [("hand", 400, rng.randint(10, 80), 100, rng.uniform(1, 8)) for _ in range(80)]
    few = [("few", 400, 20, 280, 3.0)] * 5
    df = spark.createDataFrame(typed + hand + few, "page_id string, page_h int, height int, area int, stroke double")
    got = {r["page_id"]: (r["content_type"], r["confidence"]) for r in triage.content_type_vote(df).collect()}
    assert got["typed"] == ("typed", 1.0) and got["hand"][0] == "handwritten" and got["few"] == ("unknown", 0.0)


def test_osd_readings(spark):
    df = spark.createDataFrame([("Devanagari", "6.0"), ("Han", "3.0"), ("Latin", "x"), (" Latin ", None), ("Latin", "-1")], "script string, conf string")
    got = df.select(triage.map_script(F.col("script")).alias("s"), triage.osd_confidence(F.col("conf")).alias("c")).collect()
    assert [(r["s"], r["c"]) for r in got] == [("devanagari", 1.0), ("unknown", 0.6), ("latin", 0.0), ("latin", 0.0), ("latin", 0.0)]


def test_otsu_against_brute_force(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(20, 60, 400), rng.integers(150, 220, 300)])
    df = spark.createDataFrame([("p", int(x)) for x in values], "g string, v int")

    def between(t):
        lo, hi = values[values <= t], values[values > t]
        return len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2 if len(lo) and len(hi) else 0.0

    assert triage.otsu_threshold(df, "g", "v").first()["cut"] == max(sorted(set(values.tolist())), key=between)


def test_strict_detector_raises(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "page_id string, x int")

    def detector(rows):
        if (rows["x"] == 2).any():
            raise ValueError("cannot read")
        return rows.assign(content_type="typed", confidence=0.5)

    got = {r["page_id"]: r["content_type"] for r in triage.detect_content_type(df, detector, ["x"]).collect()}
    assert got == {"a": "typed", "b": "unknown"}
    with pytest.raises(Exception, match="cannot read"):
        triage.detect_content_type(df, detector, ["x"], strict=True).collect()


def test_cosine_search_filters_before_vectors_are_joined(spark):
    pages = spark.createDataFrame([(str(i % 20), i, i % 5) for i in range(100)], "document_id string, page_num int, v int")
    stored = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "v int, embedding array<double>")
    wanted = spark.createDataFrame([("3",), ("4",)], "document_id string")
    found = vectors.cosine_search(pages.join(stored, "v"), [1.0, 4.0], wanted, 3, "page_id", F.concat_ws(":", "document_id", "page_num"))
    assert [r.page_id for r in found.collect()] == ["4:24", "4:4", "4:44"]  # ties by the computed id
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") > plan.index("Join Inner")


def test_asked_cells_come_in_bounded_frames():
    rows = pd.DataFrame({"query_id": np.arange(200), "q": [np.ones(2)] * 200})
    row, cell = np.nonzero(np.ones((200, 256), bool))
    frames = list(vectors._asked(rows, row, cell))
    assert max(map(len, frames)) <= vectors.ASKED_ROWS and len(frames) > 1
    whole = pd.concat(frames)
    assert (whole["query_id"].to_numpy() == row).all() and (whole["cell"].to_numpy() == cell).all()


def test_clusters_read_their_edges_once_and_keep_lone_and_null_ends(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rng = random.Random(11)
    edges = [(f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}") for _ in range(200)]
    edges += [(f"p{i:03}", f"p{i + 1:03}") for i in range(99)] + [("hub", f"s{i}") for i in range(200)]
    edges += [("self", "self"), ("half", None), (None, "other")]
    df = spark.createDataFrame(edges, "a string, b string").select(counted("a").alias("a"), "b")
    got = [(r["node"], r["cluster"]) for r in graph.entity_clusters(df).collect()]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    assert sorted(got, key=str) == sorted([*((x, root(x)) for x in parent), (None, None)], key=str)
    assert read.value == len(edges)

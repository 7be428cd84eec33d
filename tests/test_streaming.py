import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bundleflow.operators.merge import PAGE_RANKS, upsert
from bundleflow.sources.changelog import ChangeLog, committed
from bundleflow.sources.tables import versions
from bundleflow.streaming import jobs as J

T0 = datetime(2024, 1, 1)


def brute(times):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= timedelta(minutes=5):
            kept.append(t)
    return kept


def test_arrival_order_and_batches_do_not_matter(spark, tmp_path):
    rng = random.Random(1)
    busy = [("m", T0 + timedelta(seconds=rng.randint(0, 5000)), i) for i in range(12000)]
    rows = busy + [("n", T0 + timedelta(minutes=m), m) for m in (0, 3, 33, 36, 40)]
    rng.shuffle(rows)
    schema = "id string, ts timestamp, n int"
    closing = [("close", T0 + timedelta(days=9), 0)]
    for part in (rows[:3], rows[3:5000], rows[5000:], closing):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.stream_dedup(J.stream_files(spark, f"{tmp_path}/in", files_per_trigger=1), f"{tmp_path}/out", ["id"], lateness="2 hours").awaitTermination()
        held = sum(1 for _ in (tmp_path / "out/state").glob("batch=*"))
        assert held <= 2  # the state does not pile up
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out/data").collect()
    for name in "mn":
        assert sorted(r["ts"] for r in got if r["id"] == name) == brute([t for i, t, _ in rows if i == name])


def test_late_and_timeless_messages_stay(spark, tmp_path):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    schema = "id string, ts timestamp, n int"
    parts = (
        [("a", at(0), 1), ("busy", at(600), 2), ("x", None, 3), ("x", None, 4)],
        [("move", at(601), 5)],
        [("late", at(10), 6), ("late", at(12), 7), ("late", at(30), 8), ("busy", at(599), 9), ("busy", at(20), 10)],
        [("close", T0 + timedelta(days=9), 0)],
    )
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.stream_dedup(J.stream_files(spark, f"{tmp_path}/in", files_per_trigger=1), f"{tmp_path}/out", ["id"]).awaitTermination()
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out/data").filter("id <> 'close'").collect()
    assert sorted(r["n"] for r in got) == [1, 3, 4, 5, 6, 8, 9, 10]


def test_a_batch_delivered_again_decides_the_same(spark, tmp_path):
    """The state of a batch that died before it was committed is not read."""
    schema = "id string, ts timestamp, n int"
    rng = random.Random(2)
    rows = [("m", T0 + timedelta(seconds=60 * k + rng.randint(0, 50)), k) for k in range(300)] + [(None, T0, 1000)]
    for part in (rows[:150], rows[150:], [("close", T0 + timedelta(days=9), 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.stream_dedup(J.stream_files(spark, f"{tmp_path}/in"), f"{tmp_path}/out", ["id"]).awaitTermination()
        last = max((tmp_path / "out/_checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
        (tmp_path / f"out/state/batch={last.name}/_SUCCESS").unlink()
        last.unlink()
        (tmp_path / f"out/_checkpoint/commits/.{last.name}.crc").unlink(missing_ok=True)
        J.stream_dedup(J.stream_files(spark, f"{tmp_path}/in"), f"{tmp_path}/out", ["id"]).awaitTermination()
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out/data").filter("id IS NULL OR id <> 'close'").collect()
    assert sorted(r["ts"] for r in got if r["id"] == "m") == brute([t for i, t, _ in rows if i == "m"])
    assert [r["n"] for r in got if r["id"] is None] == [1000]


def size_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_sink_survives_redelivery_and_compaction(spark, tmp_path):
    rows = spark.createDataFrame([("d:1", "d", 1, "queued"), ("d:1", "d", 1, "queued"), ("d:2", "d", 2, "pending")], "page_id string, document_id string, page_num int, ocr_status string")
    log = J.page_log(f"{tmp_path}/t")
    for _ in range(3):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        J.stream_idempotent_sink(J.stream_files(spark, f"{tmp_path}/in"), f"{tmp_path}/t", T0).awaitTermination()
        table = log.read(spark)
        assert table.count() == 2 and table.select(F.count_distinct("page_id")).first()[0] == 2
        log.compact(spark)
    assert versions(spark, log.root) == [1] and committed(spark, f"{log.root}/changes", "batch") == [2]


PAGE = "page_id string, document_id string, page_num int, ocr_status string, raw_text string"


def random_batches(seed, n=6):
    rng = random.Random(seed)
    some = lambda *v: rng.choice([None, *v])
    return [
        [(f"d:{k}", "d", k, some("pending", "queued", "done", "failed"), some("a", "b", "c")) for k in rng.sample(range(12), rng.randint(1, 8))]
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed,mode", [(1, "forward_only"), (2, "forward_only"), (3, "overwrite")])
def test_log_reads_as_merges_one_after_the_other(spark, tmp_path, seed, mode):
    schema = spark.createDataFrame([], PAGE + ", created_at timestamp, updated_at timestamp").schema
    log = ChangeLog(f"{tmp_path}/t", schema, ("page_id",), mode, PAGE_RANKS)
    table = spark.createDataFrame([], schema)
    show = lambda df: sorted(map(tuple, df.collect()))
    before = []
    for k, rows in enumerate(random_batches(seed)):
        changes, at = spark.createDataFrame(rows, PAGE), T0 + timedelta(minutes=k)
        before.append(show(table))
        table = spark.createDataFrame(upsert(table, changes, ["page_id"], at, mode, PAGE_RANKS).collect(), schema)
        log.append(changes, k, at)
        if k % 2:
            log.append(changes, k, at)  # delivered again
            assert show(log.read(spark, before=k)) == before[k]
        assert show(log.read(spark)) == show(table)
        if k == 3:
            (tmp_path / "t/version=3").mkdir()  # a compaction that died
            (tmp_path / "t/version=3/part-0.parquet").write_text("half")
            assert show(log.read(spark)) == show(table)
        if k in (2, 4):
            stale = list((tmp_path / "t/changes/batch=0").glob("*")) if k == 2 else []
            kept = {p.name: p.read_bytes() for p in stale}
            log.compact(spark)
            if kept:  # died before it dropped what the base covers
                (tmp_path / "t/changes/batch=0").mkdir()
                for name, raw in kept.items():
                    (tmp_path / "t/changes/batch=0" / name).write_bytes(raw)
            assert show(log.read(spark)) == show(table) and show(log.read(spark, before=k)) == before[k]
    assert log.compact(spark, keep_last=0) == 5 and show(log.read(spark)) == show(table)
    assert [p.name for p in (tmp_path / "t").glob("version=*")] == ["version=5"] and not list((tmp_path / "t/changes").glob("batch=*"))


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    log = J.page_log(f"{tmp_path}")
    many = spark.range(60_000).selectExpr("concat('d:', id) AS page_id", "'d' AS document_id", "cast(id AS int) AS page_num", "'queued' AS ocr_status", "sha2(cast(id AS string), 256) AS raw_text")
    log.append(many, 0, T0)
    log.compact(spark, keep_last=0)
    base = size_of(tmp_path)
    log.append(many.limit(20), 1, T0 + timedelta(minutes=1))
    assert base > 2_000_000 and size_of(tmp_path) - base < base / 50
    table = log.read(spark)
    assert table.count() == 60_000 and table.filter("updated_at > created_at").count() == 20


def test_log_refuses_partial_overwrites(spark, tmp_path):
    schema = spark.createDataFrame([], PAGE).schema
    with pytest.raises(ValueError, match="raw_text"):
        ChangeLog(f"{tmp_path}", schema, ("page_id",), "overwrite").append(spark.createDataFrame([("a",)], "page_id string"), 0, T0)
    assert ChangeLog(f"{tmp_path}", schema, ("page_id",)).read(spark).count() == 0
    assert ChangeLog(f"{tmp_path}", schema, ("page_id",)).compact(spark) is None

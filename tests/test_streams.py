"""Streams over several batches against their batch forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from coursemill.streaming import jobs as J

LEDGER = "id long, user_id long, kind string, cost_usd double, created_at timestamp"


def ledger(seed: int, n: int, seconds: int) -> list[tuple]:
    rng, start = random.Random(seed), datetime(2024, 1, 1, 23, 58)
    rows = []
    for i in range(n):
        at = start + timedelta(microseconds=rng.choice([rng.randint(0, seconds * 10**6), rng.randint(0, seconds) * 10**6]))
        rows.append((i, rng.choice([1, 1, 2, None]), rng.choice(["question", "question", "upload", "llm"]), rng.choice([0.0, 0.125]), at))
    return sorted(rows, key=lambda r: r[4])


def written(spark, rows, path, files):
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], LEDGER).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")


def test_minute_rate_of_late_rows_over_batches(spark, tmp_path):
    rows = ledger(1, 400, 900)
    order = random.Random(2)
    late = sorted(rows, key=lambda r: r[4] + timedelta(seconds=order.uniform(0, 100)))
    late.append((9999, None, "heartbeat", 0.0, rows[-1][4] + timedelta(hours=1)))
    stream = written(spark, late, str(tmp_path), 6)
    got = {r.id: r.rate for r in J.run_to_end(J.minute_rate_stream(stream, "200 seconds"), "append", own_state=True).collect()}
    want = {r.id: r.rate for r in J.minute_rate(spark.createDataFrame(rows, LEDGER)).collect()}
    assert len(want) > 100 and got == want
    assert "RocksDB" not in spark.conf.get(J.STORE)


def test_quota_replay_stream_and_a_plain_replay(spark, tmp_path):
    rows, limits = ledger(3, 300, 4000), {"minute": 2, "day": 12, "uploads": 3}
    rows = list({(r[1], r[4]): r for r in rows}.values())  # a user's requests at one time in one batch
    got = {r.id: r.decision for r in J.run_to_end(J.quota_replay(written(spark, rows, str(tmp_path), 5), limits), "append").collect()}
    want, kept = {}, []
    for i, user, kind, _, at in rows:
        if user is None or kind == "llm":
            continue
        own = [(k, t) for u, k, t in kept if u == user]
        recent = sum(k == "question" and t >= at - timedelta(seconds=60) for k, t in own)
        today = sum(k == kind and t.date() == at.date() for k, t in own)
        full = today >= limits["uploads" if kind == "upload" else "day"]
        want[i] = "minute" if kind == "question" and recent >= limits["minute"] else "day" if full else "ok"
        kept += [(user, kind, at)] if want[i] == "ok" else []
    assert got == want and {"minute", "day", "ok"} == set(want.values())
    assert {r.id: r.decision for r in J.quota_replay(spark.createDataFrame(rows, LEDGER), limits).collect()} == want


def test_spending_of_one_busy_minute(spark):
    n = 20_000
    base = spark.range(n).select("id", F.lit(1).cast("long").alias("user_id"), F.lit("llm").alias("kind"), F.lit(0.25).alias("cost_usd"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000).alias("created_at"))
    asked = base.select("id", (F.col("id") + 10).alias("user_id"), F.lit("question").alias("kind"), F.lit(False).alias("admin"), "created_at")
    got = J.quota_decisions(asked, base, {"minute": 5, "day": 30, "uploads": 3, "budget": 1000.0}).groupBy("decision").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    assert {r.decision: (r.n, r.first) for r in got} == {"ok": (3999, 0), "budget": (n - 3999, 3999)}


def test_runs_from_links_download_first(spark):
    rows = [(1, "fetch", "done", "running", True), (1, "probe", "running", "running", True), (2, "fetch", "done", "running", False), (3, "save", "done", "succeeded", True), (4, "save", "done", "succeeded", None)]
    events = spark.createDataFrame(rows, "run_id int, stage string, status string, run_status string, from_link boolean")
    got = {r.run_id: (r.done, r.total, r.percent, r.states.get("fetch"), len(r.states)) for r in J.run_progress(events).collect()}
    assert got == {1: (1, 14, 7, "done", 14), 2: (0, 13, 0, None, 13), 3: (14, 14, 100, "done", 14), 4: (13, 13, 100, None, 13)}


def test_sampling_keeps_its_keys_by_lecture_over_batches(spark, tmp_path):
    """A group of the stream is a lecture; its other keys (null, two kinds) are told apart and come back as they were."""
    from coursemill.operators.slides import sample_per_key

    rng = random.Random(4)
    schema = "lecture_id long, page long, seen timestamp, t_s double, frame long"
    pages, times = [None, 1, 2**60 + 1, 2**60 + 2], [None, datetime(2024, 1, 1, 5, 0, 0, 123456)]
    rows = [(rng.choice([1, 2, None]), rng.choice(pages), rng.choice(times), None if rng.random() < 0.1 else rng.randrange(8) + 8.0 * (i // 250), i) for i in range(1000)]
    for i in range(4):
        spark.createDataFrame(rows[250 * i : 250 * i + 250], schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/*")
    for keys in (["lecture_id", "page", "seen"], ["lecture_id"]):
        sampled = J.sample_per_key_stream(stream, keys, 4, 3.0)
        plan = sampled._jdf.queryExecution().analyzed().toString()
        assert "page" not in plan.split("FlatMapGroupsInPandasWithState")[1].split("\n")[0]
        got = [tuple(r) for r in J.run_to_end(sampled, "append").collect()]
        want = [tuple(r) for r in sample_per_key(spark.createDataFrame(rows, schema), keys, 4, 3.0).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and len(want) >= 12

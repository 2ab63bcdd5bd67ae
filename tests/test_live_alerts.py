"""Events to alerts in micro-batches against the batch operators on all events."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from hostlens import Settings
from hostlens.config import NS
from hostlens.operators import features as FE
from hostlens.operators import funnel as FN
from hostlens.operators import scoring as SC
from hostlens.operators import windows as W
from hostlens.plans import training
from hostlens.streaming import live as L
from hostlens.streaming.alerting import LiveAlerts
from sessions import call, file, frame, net, proc

ST = Settings(window_seconds=20, score_interval_seconds=10, sequence_length=3, high=40.0, dedup_seconds=25, rate_window_seconds=60, max_alerts_per_window=1)
PROC = ["host_id", "pid"]
KEY = [*PROC, "tick"]


def now():
    return F.lit("2024-01-01").cast("timestamp")


def events_of(spark, seed, seconds=200):
    rng, rows = random.Random(seed), []
    for i in range(seconds * 3):
        make = rng.choice([lambda: call(rng.choice([0, 1, 59])), lambda: net("10.0.0.1", rng.choice([22, 80]), 10), lambda: file("/tmp/x", "open"), lambda: proc("bash")])
        host, pid = rng.randrange(2), rng.randrange(3)
        if (i // 90) % 3 == pid:
            continue  # idle for a while
        rows.append(dict(make(), ts_ns=i * NS // 3 + rng.randrange(NS), pid=pid, host_id=host, comm=f"app{pid}" if pid < 2 else rng.choice(["app0", "new"]), event_id=i))
    return frame(spark, rows, base=0)


@pytest.fixture(scope="module")
def case(spark):
    baselines = training.fit(training.training_vectors(events_of(spark, 1), ST), ST).where("comm <> 'new'").cache()
    rules = spark.createDataFrame([("app1", 50.0, None)], "process_name string, max_score_suppress double, expires_at timestamp").cache()
    safe = spark.createDataFrame([(1, 0)], "host_id long, pid long")
    events = events_of(spark, 2).cache()
    snap = W.snapshots(events, PROC, ST)
    scored = SC.score_windows(FE.vectors(events, snap, PROC, ST), baselines, ST, PROC, "tick", safe)
    want = FN.run_funnel(scored, rules, now(), KEY, ST).collect()
    return baselines, rules, safe, events, want


def rounded(rows):
    return sorted(
        (r.host_id, r.pid, r.tick, r.process_name, r.timestamp_ns, round(r.final_score, 6), r.severity, r.outcome, r.explanation) for r in rows
    )


def live(spark, tmp_path, case, **more):
    baselines, rules, safe, *_ = case
    return LiveAlerts(spark, str(tmp_path / "live"), ST, lambda: baselines, lambda: rules, now(), delay_seconds=15, safe_pids=safe, **more)


def arrivals(events, parts, late=12):
    at = F.col("ts_ns") + F.pmod(F.xxhash64("event_id"), F.lit(late)) * NS
    rows = events.withColumn("_at", at)
    span = rows.agg(F.max("_at")).first()[0] + 1
    return [rows.where((F.col("_at") * parts >= i * span) & (F.col("_at") * parts < (i + 1) * span)).drop("_at") for i in range(parts)]


@pytest.mark.parametrize("parts", [3, 9])
def test_micro_batches_equal_one_batch(spark, tmp_path, case, parts):
    *_, events, want = case
    app = live(spark, tmp_path, case, compact_every=4)
    for i, part in enumerate(arrivals(events, parts)):
        app.run(part, i)
    app.finish()
    assert rounded(app.table("verdicts").collect()) == rounded(want)
    assert {r.outcome for r in want} == {"below_threshold", "suppressed", "deduped", "rate_limited", "sent"}
    sent = sorted((r.host_id, r.pid, r.timestamp_ns) for r in want if r.outcome == "sent")
    assert sorted((r.host_id, r.pid, r.timestamp_ns) for r in app.table("alerts").collect()) == sent
    assert app.table("events").count() == events.count()
    last = app._progress(parts)
    assert sum(r.late for r in app.table("progress").collect()) == 0 and len(last.context_batches) <= 4
    assert len(last.event_batches) <= 4 and len(last.alert_batches) <= parts


def test_a_batch_that_fails_or_repeats(spark, tmp_path, case, monkeypatch):
    """The third batch dies before its progress is written, and is run again; the second is repeated."""
    *_, events, want = case
    app, parts = live(spark, tmp_path, case), arrivals(events, 5)
    for i, part in enumerate(parts):
        if i == 2:
            with monkeypatch.context() as m:
                m.setattr(app, "_keep_context", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    app.run(part, i)
        app.run(part, i)
        if i == 1:
            app.run(part, i)
    app.finish()
    assert rounded(app.table("verdicts").collect()) == rounded(want)
    shutil.rmtree(tmp_path / "live" / "progress" / "batch_id=3")
    with pytest.raises(RuntimeError):
        app.run(parts[4], 4)


def test_as_a_stream_and_restarted(spark, tmp_path, case):
    *_, events, want = case
    path, app = str(tmp_path / "in"), live(spark, tmp_path, case)
    for part in arrivals(events, 4):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = L.event_stream(spark, path, events.schema, max_files=1)
        app.start(stream, str(tmp_path / "check"), {"availableNow": True}).awaitTermination()
        app = live(spark, tmp_path, case)
    app.finish()
    assert rounded(app.table("verdicts").collect()) == rounded(want)


def test_late_events_are_stored_and_counted(spark, tmp_path, case):
    app = live(spark, tmp_path, case)
    one = lambda ts, i: frame(spark, [dict(call(1), ts_ns=ts * NS, event_id=i)], base=0)
    for i, ts in enumerate([5, 100, 50, 200]):
        app.run(one(ts, i), i)
    assert [r.late for r in app.table("progress").orderBy("batch_id").collect()] == [0, 0, 1, 0]
    assert app.table("events").count() == 4


def test_earlier_alerts_go_on_counting(spark):
    rows = [(i, 0, "abc"[i % 3], 1, 90.0, i * 7 * NS) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, host_id bigint, process_name string, pid bigint, final_score double, timestamp_ns bigint")
    whole = {r.event_id: r.outcome for r in FN.walk(df, ["event_id"], ST).collect()}
    first = FN.walk(df.where("event_id < 31"), ["event_id"], ST)
    sent = df.join(first.where("outcome = 'sent'").select("event_id"), "event_id")
    second = FN.walk(df.where("event_id >= 31"), ["event_id"], ST, sent)
    assert {r.event_id: r.outcome for r in first.unionByName(second.select(*first.columns)).collect()} == whole

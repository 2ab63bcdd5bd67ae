import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hostlens import Settings
from hostlens.config import NS
from hostlens.operators import alerts as A
from hostlens.operators import funnel as FN
from hostlens.sources import store as S

ST = Settings()
COLS = "event_id bigint, host_id bigint, process_name string, pid bigint, final_score double, severity string, explanation string, timestamp_ns bigint"
def NOW():
    return F.lit(datetime(2024, 1, 1)).cast("timestamp")


def verdicts(spark, rows):
    """rows: (host, process, score, second)"""
    return spark.createDataFrame(
        [(i, h, p, 1, float(s), "HIGH", "x", int(t * NS)) for i, (h, p, s, t) in enumerate(rows)], COLS
    )


def rules(spark, *rows):
    return spark.createDataFrame([(n, "", float(c), e, "user") for n, c, e in rows], S.RULE_SCHEMA)


def outcomes(spark, rows, rule_rows=(), settings=ST):
    out = FN.run_funnel(verdicts(spark, rows), rules(spark, *rule_rows), NOW(), ["event_id"], settings)
    return [r["outcome"] for r in out.orderBy("event_id").collect()]


def brute(rows, settings):
    """One long walk per host in plain Python."""
    result, last, recent = {}, {}, {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][3], rows[i][1])):
        host, process, score, t = rows[i]
        if score < settings.high:
            result[i] = "below_threshold"
            continue
        before = last.get((host, process))
        if before is not None and t - before < settings.dedup_seconds:
            result[i] = "deduped"
        elif sum(1 for s in recent.get(host, []) if s >= t - settings.rate_window_seconds) >= settings.max_alerts_per_window:
            result[i] = "rate_limited"
        else:
            result[i] = "sent"
            last[(host, process)] = t
            recent.setdefault(host, []).append(t)
    return [result[i] for i in range(len(rows))]


def test_fires_once_then_dedups(spark):
    rows = [(0, "evil", 95, 1), (0, "evil", 95, 2), (0, "evil", 50, 3), (0, "a", 95, 4), (0, "b", 95, 5), (0, "evil", 95, 301)]
    assert outcomes(spark, rows) == ["sent", "deduped", "below_threshold", "sent", "sent", "sent"]


def test_rules(spark):
    past, future = datetime(2023, 12, 31, 23), datetime(2024, 6, 1)
    rule_rows = [("backup", 60, None), ("expired", 99, past), ("evil", 100, None), ("kept", 99, future)]
    rows = [(0, "backup", 75, 1), (0, "expired", 80, 2), (0, "evil", 99.9, 3), (0, "evil", 100, 4), (0, "kept", 90, 5), (0, "other", 90, 6)]
    assert outcomes(spark, rows, rule_rows) == ["sent", "sent", "suppressed", "sent", "suppressed", "sent"]


@pytest.mark.parametrize("seed", range(4))
def test_parallel_walk_equals_one_walk(spark, seed):
    """A storm on one host over many chunks, with both limits active all the time."""
    rng = random.Random(seed)
    st = ST.with_(dedup_seconds=rng.choice([5, 30, 90]), rate_window_seconds=rng.choice([10, 60]), max_alerts_per_window=rng.choice([1, 3]))
    rows, t = [], 0.0
    for _ in range(1500):
        t += rng.choice([0.1, 0.5, 2.0, 7.0])
        rows.append((0 if rng.random() < 0.8 else rng.randrange(1, 4), rng.choice("abcdefgh"), rng.choice([60, 90, 95]), round(t, 1)))
    assert t > 8 * 90 * 3
    assert outcomes(spark, rows, settings=st) == brute(rows, st)


def test_a_process_that_never_pauses_is_walked_once(spark, monkeypatch):
    """Over 1000 horizons without a gap, survivors are written once."""
    st = ST.with_(dedup_seconds=5, rate_window_seconds=10, max_alerts_per_window=1)
    rows = [(0, "loud", 95, i * 3) for i in range(3400)] + [(1, "calm", 95, i * 400) for i in range(30)]
    written = []
    monkeypatch.setattr(FN, "materialize", lambda df, label: written.append(label) or S.materialize(df, label))
    assert outcomes(spark, rows, settings=st) == brute(rows, st)
    assert written == ["funnel-survivors"]
    marked = FN.stretches(verdicts(spark, rows), st).groupBy("host_id").agg(F.countDistinct("_stretch").alias("n"))
    assert {r["host_id"]: r["n"] for r in marked.collect()} == {0: 1, 1: 30}


def test_quota_forgets_by_time():
    quota = FN.Quota(ST.with_(dedup_seconds=5, rate_window_seconds=10, max_alerts_per_window=1000))
    for i in range(10_000):
        quota.decide(f"p{i}", i * NS)
        assert len(quota.quiet) == len(quota.ends) <= 6 and len(quota.slots) <= 11


def test_counters_and_metrics(spark):
    from hostlens.plans.reports import metric_lines

    rows = [(0, "evil", 95, 1), (0, "evil", 95, 2), (0, "evil", 50, 3)]
    out = FN.run_funnel(verdicts(spark, rows), rules(spark), NOW(), ["event_id"], ST)
    assert {(r["outcome"], r["n"]) for r in FN.outcome_counts(out).collect()} == {("sent", 1), ("deduped", 1), ("below_threshold", 1)}
    lines = [r["line"] for r in metric_lines(out).collect()]
    assert "hostlens_alerts_sent 1" in lines and "hostlens_alerts_rate_limited 0" in lines


def test_rule_lines(spark):
    lines = spark.createDataFrame(
        [('{"process_name":"a"}',), ('{"process_name":"b","expires_at":"2024-05-01T00:00:00","max_score_suppress":60}',),
         ('{"process_name":"c","expires_at":"soon"}',), ('{"reason":"no name"}',)], "value string")
    got = {r["process_name"]: r for r in S.rules_from_json(lines).collect()}
    assert got["a"]["valid"] and got["a"]["max_score_suppress"] == 100.0 and got["a"]["created_by"] == "user"
    assert got["b"]["expires_at"] == datetime(2024, 5, 1) and not got["c"]["valid"] and not got[None]["valid"]


def test_rule_management(spark, tmp_path):
    base = rules(spark, ("a", 50, None), ("b", 60, datetime(2023, 1, 1)))
    up = S.upsert_rule(base, rules(spark, ("a", 70, None), ("z", 101, None), ("n", -1, None)))
    assert {(r["process_name"], r["max_score_suppress"]) for r in up.collect()} == {("a", 70.0), ("b", 60.0)}
    assert S.expired_rules(up, NOW()).first()["expired"] == 1
    path = str(tmp_path / "rules")
    S.save_rules(up, path)
    assert S.load_rules(spark, path).exceptAll(up).isEmpty()
    assert S.load_rules(spark, str(tmp_path / "none")).isEmpty()


def test_alert_table(spark):
    made = A.build_alerts(verdicts(spark, [(0, "a", 95, 1), (0, "b", 75, 2), (1, "a", 90, 3)]), F.col("event_id"))
    assert [r["alert_id"] for r in A.list_alerts(made, limit=2).collect()] == [2, 1]
    assert [r["alert_id"] for r in A.list_alerts(made, process_name="a", offset=1).collect()] == [0]
    acks = spark.createDataFrame([(1, "seen"), (77, "nothing there")], "alert_id bigint, note string")
    after = A.acknowledge(made, acks)
    assert A.unacknowledged(after).first()[0] == 2
    assert A.get_alert(after, 1).first()["ack_note"] == "seen"
    assert [r["alert_id"] for r in A.acknowledged_ids(made, acks).collect()] == [1]


def test_repeated_acks_and_rules(spark, tmp_path):
    made = spark.createDataFrame([(1, False, "old"), (2, False, "old"), (3, False, "old")], "alert_id bigint, acknowledged boolean, ack_note string")
    acks = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, None, 1)], "alert_id bigint, note string, n int")
    rows = sorted(map(tuple, A.acknowledge(made, acks, "n").collect()))
    assert rows == [(1, True, "a"), (2, True, "old"), (3, False, "old")]
    assert A.acknowledge(made, acks).count() == 3
    two = rules(spark, ("a", 70, None), ("a", 80, None))
    assert S.upsert_rule(two.limit(0), two.withColumn("n", F.col("max_score_suppress").cast("int")), "n").first()["max_score_suppress"] == 80
    lines = [f'{{"process_name":"p{i % 2}","reason":"r{i}"}}' for i in range(6)]
    path = str(tmp_path / "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    assert {(r["process_name"], r["reason"]) for r in S.load_rules(spark, path).collect()} == {("p0", "r4"), ("p1", "r5")}


def test_many_channels(spark):
    made = spark.createDataFrame([(1, 0, "p", 4, 91.0, "HIGH", "x", 5)], "alert_id bigint, host_id bigint, process_name string, pid bigint, score double, severity string, explanation string, timestamp_ns bigint")
    config = spark.createDataFrame([(i, "webhook", f"http://h/{i}", None, None) for i in range(300)], A.CHANNEL_SCHEMA)
    out = A.outbox(made, config)
    assert out.count() == 300 and out.where("deliverable").count() == 300


def test_outbox(spark):
    made = A.build_alerts(verdicts(spark, [(0, "a", 92.25, 1)]), F.col("event_id"))
    config = spark.createDataFrame(
        [(1, "webhook", "", None, None), (2, "syslog", None, None, None), (3, "syslog", None, False, None), (4, "email", None, None, ["x@y"])],
        A.CHANNEL_SCHEMA)
    usable = A.enabled_channels(config)
    rows = {r["channel"]: r for r in A.outbox(made, usable).collect()}
    assert set(rows) == {"syslog", "email"}
    assert rows["syslog"]["body"] == "HIGH alert: a (pid 1) score=92.2 - x"
    assert rows["email"]["subject"] == "[hostlens HIGH] a (pid 1) score 92" and rows["email"]["deliverable"]
    assert A.outbox(made, config.where("position = 1")).first()["detail"] == "no webhook url configured"
    assert A.outbox(made, config.where("position > 9")).isEmpty()

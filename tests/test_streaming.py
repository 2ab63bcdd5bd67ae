import random

import pandas as pd
from pyspark.sql import functions as F

from hostlens import Settings
from hostlens.config import NS
from hostlens.operators import funnel as FN
from hostlens.streaming import live as L
from sessions import call, frame

ST = Settings(window_seconds=30, sequence_length=3)
ONCE = {"availableNow": True}


def feed(spark, tmp_path, parts, df):
    """Files that arrive one after the other, one per micro-batch."""
    path = str(tmp_path / "in")
    out = None
    for i, cond in enumerate(parts):
        df.where(cond).coalesce(1).write.mode("append").parquet(path)
        yield path, str(tmp_path / "checkpoint"), str(tmp_path / "out")


def run(df, out, check):
    L.start_sink(df, out, check, ONCE).awaitTermination()


def test_trailing_state_over_batches(spark, tmp_path):
    L.use_rocksdb(spark)
    rng = random.Random(4)
    rows = [dict(call(1), ts_ns=i * NS * 2 + rng.randrange(NS), pid=rng.choice([1, 2]), event_id=i) for i in range(60)]
    rows = [r for r in rows if not (r["pid"] == 2 and r["ts_ns"] > 40 * NS)]
    events = frame(spark, rows)
    parts = ["ts_ns < 30000000000", "ts_ns >= 30000000000 and ts_ns < 70000000000", "ts_ns >= 70000000000"]
    for path, check, out in feed(spark, tmp_path, parts, events):
        stream = L.with_event_time(L.event_stream(spark, path, events.schema), 5)
        run(L.trailing_state(stream, ST, idle_seconds=20), out, check)
    got = spark.read.parquet(out).toPandas()
    last = got[(got.pid == 1) & ~got.reaped].sort_values("latest_ns").iloc[-1]
    mine = [r["ts_ns"] for r in rows if r["pid"] == 1]
    inside = [t for t in mine if t >= max(mine) - ST.window_ns]
    assert (last.latest_ns, last.event_count, last.span_ns) == (max(mine), len(inside), max(inside) - min(inside))
    assert got[got.reaped].pid.tolist() == [2]


def test_funnel_stream_equals_batch(spark, tmp_path):
    L.use_rocksdb(spark)
    rng, t, rows = random.Random(8), 0, []
    for i in range(400):
        t += rng.choice([1, 3, 40]) * NS // 2
        rows.append((i, rng.randrange(2), rng.choice("abc"), 1, 90.0, t))
    df = spark.createDataFrame(rows, "event_id bigint, host_id bigint, process_name string, pid bigint, final_score double, timestamp_ns bigint")
    st = ST.with_(dedup_seconds=20, rate_window_seconds=60, max_alerts_per_window=3)
    mid = rows[200][5]
    for path, check, out in feed(spark, tmp_path, [f"timestamp_ns < {mid}", f"timestamp_ns >= {mid}"], df):
        run(L.funnel_stream(L.event_stream(spark, path, df.schema), st), out, check)
    key = ["host_id", "timestamp_ns", "process_name"]
    streamed = {tuple(r[k] for k in key): r["outcome"] for r in spark.read.parquet(out).collect()}
    batch = {tuple(r[k] for k in key): r["outcome"] for r in FN.walk(df, ["event_id"], st).collect()}
    assert streamed == batch and set(batch.values()) == {"sent", "deduped", "rate_limited"}


def test_late_verdicts_are_named(spark, tmp_path):
    L.use_rocksdb(spark)
    rows = [(i, 0, p, 1, 90.0, t * NS) for i, (p, t) in enumerate([("a", 1), ("b", 100), ("a", 50), ("b", 101), ("a", 102), ("a", 103)])]
    df = spark.createDataFrame(rows, "event_id bigint, host_id bigint, process_name string, pid bigint, final_score double, timestamp_ns bigint")
    st = ST.with_(dedup_seconds=20, rate_window_seconds=60, max_alerts_per_window=3)
    for path, check, out in feed(spark, tmp_path, ["event_id < 2", "event_id >= 2"], df):
        run(L.funnel_stream(L.event_stream(spark, path, df.schema), st), out, check)
    got = {r["timestamp_ns"] // NS: r["outcome"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "sent", 100: "sent", 50: "late", 101: "deduped", 102: "sent", 103: "deduped"}


def test_pairs_over_batches(spark, tmp_path):
    L.use_rocksdb(spark)
    kinds = ["enter", "exit", "exit", "enter", "enter", "exit"]
    df = spark.createDataFrame([(i, 0, 1, i * 10, k) for i, k in enumerate(kinds)], "event_id bigint, host_id bigint, pid bigint, ts_ns bigint, kind string")
    for path, check, out in feed(spark, tmp_path, ["event_id < 4", "event_id >= 4"], df):
        run(L.pair_stream(L.event_stream(spark, path, df.schema)), out, check)
    assert {(r["enter_id"], r["exit_id"]) for r in spark.read.parquet(out).collect()} == {(0, 1), (4, 5)}


def test_rolling_context_over_batches(spark, tmp_path):
    L.use_rocksdb(spark)
    df = spark.createDataFrame([(0, 1, k, float(k)) for k in range(6)], "host_id bigint, pid bigint, k bigint, value double")
    for path, check, out in feed(spark, tmp_path, ["k < 2", "k >= 2"], df):
        run(L.rolling_context(L.event_stream(spark, path, df.schema), ST), out, check)
    got = {r["k"]: (r["context_size"], r["context_mean"]) for r in spark.read.parquet(out).collect()}
    assert got == {0: (1, None), 1: (2, None), 2: (3, 1.0), 3: (3, 2.0), 4: (3, 3.0), 5: (3, 4.0)}


def test_sliding_windows_equal_batch_on_closed_windows(spark, tmp_path):
    rng = random.Random(1)
    events = frame(spark, [dict(call(i % 4), ts_ns=i * NS + rng.randrange(NS), pid=i % 2) for i in range(200)])
    for path, check, out in feed(spark, tmp_path, ["ts_ns < 90000000000", "ts_ns >= 90000000000"], events):
        stream = L.with_event_time(L.event_stream(spark, path, events.schema), 10)
        run(L.sliding_features(stream, ST, ["n"]), out, check)
    got = {(r["start_us"], r["pid"]): r["n"] for r in spark.read.parquet(out).collect()}
    batch = L.sliding_features(events.withColumn("event_time", F.timestamp_micros(F.expr("ts_ns div 1000"))), ST, ["n"])
    want = {(r["start_us"], r["pid"]): r["n"] for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items())
    closed = events.agg(F.max("ts_ns")).first()[0] // 1_000_000 * 1000 - 10_000_000
    assert set(got) == {k for k in want if k[0] + 30_000_000 <= closed}


def test_rerun_batch_replaces_its_output(spark, tmp_path):
    df = spark.createDataFrame([(i, 80.0 + i) for i in range(10)], "id bigint, final_score double")
    tables = {n: str(tmp_path / n) for n in ("events", "alerts")}
    score = lambda b: {"alerts": b.where("final_score > 85")}
    for path, check, _ in feed(spark, tmp_path, ["id < 5", "id >= 5"], df):
        L.persist_and_score(L.event_stream(spark, path, df.schema), check, tables, score, ONCE).awaitTermination()
    # the whole stream again from the start, as after a lost checkpoint
    L.persist_and_score(L.event_stream(spark, path, df.schema, max_files=1), str(tmp_path / "again"), tables, score, ONCE).awaitTermination()
    assert spark.read.parquet(tables["events"]).count() == 10
    assert spark.read.parquet(tables["alerts"]).count() == 4
    assert isinstance(spark.read.parquet(tables["events"]).toPandas(), pd.DataFrame)


def test_ordered_feed_in_slices_of_rows(spark):
    """Skewed times: slices follow the rows, not the time span, and several tasks write each."""
    from hostlens.catalog import streams as ST_

    df = spark.range(2000, numPartitions=4).selectExpr("id", "IF(id = 0, 0L, 1000000000L + id) AS at")
    sliced, n = ST_._sliced(df, "at", rows=250)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert n == 8 and len(sizes) == 8 and max(sizes) <= 400
    out = ST_._finish_in_order(spark, df, "at", lambda rows: rows.withColumn("file", F.col("_metadata.file_name")), rows=1000)
    assert out.count() == 2000 and out.select("file").distinct().count() > 4


def shuffled(spark, tmp_path, df, time, parts=5, late=30):
    """Files with rows up to ``late`` seconds late, and a last one that moves time on."""
    path = str(tmp_path / "late-in")
    rows = df.withColumn("_at", F.col(time) + F.pmod(F.xxhash64(*df.columns), F.lit(late)) * NS)
    span = rows.agg(F.max("_at")).first()[0] + 1
    for i in range(parts):
        rows.where((F.col("_at") * parts >= i * span) & (F.col("_at") * parts < (i + 1) * span)).drop("_at").coalesce(1).write.mode("append").parquet(path)
    beat = {"host_id": -1, "pid": -1, time: span + 1000 * NS}
    spark.createDataFrame([tuple(beat.get(f.name) for f in df.schema)], df.schema).coalesce(1).write.mode("append").parquet(path)
    return L.with_event_time(L.event_stream(spark, path, df.schema, max_files=1), late + 1, time)


def finished(spark, tmp_path, df):
    run(df, str(tmp_path / "late-out"), str(tmp_path / "late-check"))
    return spark.read.schema(df.schema).parquet(str(tmp_path / "late-out")).collect()


def test_exits_before_entries_in_another_batch(spark, tmp_path):
    """Entries at 10 and 30 arrive in one micro-batch, exits at 20 and 40 in the next."""
    L.use_rocksdb(spark)
    df = spark.createDataFrame(
        [(1, 0, 1, 10 * NS, "enter"), (3, 0, 1, 30 * NS, "enter"), (2, 0, 1, 20 * NS, "exit"), (4, 0, 1, 40 * NS, "exit"), (9, 0, 2, 900 * NS, "enter")],
        "event_id bigint, host_id bigint, pid bigint, ts_ns bigint, kind string",
    )
    for path, check, out in feed(spark, tmp_path, ["event_id in (1, 3)", "event_id in (2, 4)", "event_id = 9"], df):
        run(L.pair_stream(L.with_event_time(L.event_stream(spark, path, df.schema), 60), period_seconds=5), out, check)
    assert sorted((r["enter_id"], r["exit_id"]) for r in spark.read.parquet(out).collect()) == [(1, 2), (3, 4)]


def test_pairs_of_a_shuffled_feed(spark, tmp_path):
    L.use_rocksdb(spark)
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), rng.randrange(3), i * NS + rng.randrange(NS), rng.choice(["enter", "exit"])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, host_id bigint, pid bigint, ts_ns bigint, kind string")
    got = finished(spark, tmp_path, L.pair_stream(shuffled(spark, tmp_path, df, "ts_ns"), period_seconds=7))
    want, waiting = set(), {}
    for i, host, pid, ts, kind in sorted(rows, key=lambda r: r[3]):
        if kind == "enter":
            waiting[host, pid] = i
        elif (host, pid) in waiting:
            want.add((waiting.pop((host, pid)), i))
    assert {(r["enter_id"], r["exit_id"]) for r in got} == want and len(want) > 50


def test_funnel_of_a_shuffled_feed(spark, tmp_path):
    L.use_rocksdb(spark)
    rng, t, rows = random.Random(8), 0, []
    for i in range(300):
        t += rng.choice([1, 3, 40]) * NS // 2 + 1
        rows.append((rng.randrange(2), rng.choice(["a", "b", None]), 1, t, i))
    df = spark.createDataFrame(rows, "host_id bigint, process_name string, pid bigint, timestamp_ns bigint, event_id bigint")
    st = ST.with_(dedup_seconds=20, rate_window_seconds=60, max_alerts_per_window=3)
    got = finished(spark, tmp_path, L.funnel_stream(shuffled(spark, tmp_path, df, "timestamp_ns"), st, period_seconds=3))
    batch = {(r["host_id"], r["timestamp_ns"]): r["outcome"] for r in FN.walk(df, ["event_id"], st).collect()}
    assert {(r["host_id"], r["timestamp_ns"]): r["outcome"] for r in got} == batch


def test_context_of_a_shuffled_feed(spark, tmp_path):
    L.use_rocksdb(spark)
    df = spark.createDataFrame([(0, 1, k, float(k), (k + 1) * 10 * NS) for k in range(60)], "host_id bigint, pid bigint, k bigint, value double, ts_ns bigint")
    got = finished(spark, tmp_path, L.rolling_context(shuffled(spark, tmp_path, df, "ts_ns"), ST, period_seconds=40))
    assert sorted((r["k"], r["context_size"], r["context_mean"]) for r in got) == [
        (k, min(k + 1, 3), float(k - 1) if k > 1 else None) for k in range(60)
    ]


def test_state_needs_no_copy_of_the_package(spark):
    """What travels to the workers names no module of the package."""
    import pickletools

    from pyspark import cloudpickle

    for processor in (L.FunnelState(ST), L.OpenEntry(), L.RollingContext(3), L.InEventTime(L.OpenEntry(), ["ts_ns"], ["ts_ns"], "ts_ns", NS)):
        raw = cloudpickle.dumps(processor)
        strings = [str(arg) for op, arg, _ in pickletools.genops(raw) if op.name in ("SHORT_BINUNICODE", "BINUNICODE", "GLOBAL")]
        code = [c for c in strings if c.startswith("hostlens")]
        # module names may label classes made anew; none may be imported
        assert not any(op.name == "GLOBAL" and str(arg).startswith("hostlens") for op, arg, _ in pickletools.genops(raw))
        assert "import" not in code

"""Vectors of a stream against the batch operator on the same windows."""

import random

import pytest
from pyspark.sql import functions as F

from hostlens import Settings
from hostlens.config import NS
from hostlens.operators import features as FE
from hostlens.operators import windows as W
from hostlens.streaming import live as L
from hostlens.streaming import vectors as V
from sessions import SESSIONS, call, file, frame, net, proc

ST = Settings(window_seconds=30, sequence_length=3)
KEY = ["host_id", "pid", "k"]


def some_events(spark, n=700):
    rng = random.Random(6)
    kinds = [
        lambda: call(rng.choice([0, 1, 59, 105, 400])), lambda: net(rng.choice(["10.0.0.1", "8.8.8.8", None]), rng.choice([22, 9001, None]), 10, rng.choice(["outbound", "inbound"])),
        lambda: file(rng.choice(["/etc/shadow", "/tmp/é😀.sh", "", None]), rng.choice(["open", "write"])), lambda: proc(rng.choice(["bash", "app"])),
    ]
    rows = []
    for i in range(n):
        ts = i * NS // 3 + rng.randrange(NS)
        rows.append(dict(rng.choice(kinds)(), ts_ns=ts, pid=rng.choice([1, 2]), event_id=i, **({"comm": rng.choice(["a", "b"])} if rng.random() < 0.3 else {})))
    for rows_of, _ in SESSIONS.values():
        rows += [dict(r, ts_ns=60 * NS + 7 * j, pid=3, event_id=10_000 + len(rows) + j) for j, r in enumerate(rows_of)]
    rows.append(dict(call(1), ts_ns=rows[0]["ts_ns"], pid=rows[0]["pid"], event_id=99_999))  # equal times
    return frame(spark, rows, base=0)


def batch_vectors(events):
    return {tuple(r[k] for k in KEY): r for r in FE.vectors(events, W.Aligned(["host_id", "pid"], ST), ["host_id", "pid"], ST).collect()}


@pytest.mark.parametrize("cuts", [1, 5, 40])
def test_equal_to_batch_whatever_the_cut(spark, tmp_path, cuts, monkeypatch):
    """Events arrive up to 20 seconds late, in ``cuts`` micro-batches."""
    L.use_rocksdb(spark)
    monkeypatch.setattr(V, "COMPACT", 3)
    events = some_events(spark)
    delay, path = 25, str(tmp_path / "in")
    arrival = F.col("ts_ns") + F.pmod(F.xxhash64("event_id"), F.lit(20)) * NS
    rows = events.withColumn("_at", arrival).persist()
    span = rows.agg(F.max("_at")).first()[0] + 1
    for i in range(cuts):
        part = rows.where((F.col("_at") * cuts >= i * span) & (F.col("_at") * cuts < (i + 1) * span)).drop("_at")
        part.coalesce(1).write.mode("append").parquet(path)
    stream = L.with_event_time(L.event_stream(spark, path, events.schema, max_files=1), delay)
    L.start_sink(V.vector_stream(stream, ST), str(tmp_path / "out"), str(tmp_path / "check"), {"availableNow": True}).awaitTermination()
    got = {tuple(r[k] for k in KEY): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    newest = events.agg(F.max("ts_ns")).first()[0] // 1_000_000 * 1_000_000 - delay * NS
    want = {k: r for k, r in batch_vectors(events).items() if k[2] * ST.stride_ns + ST.window_ns <= newest}
    assert got.keys() == want.keys() and len(want) > 20
    for k, r in want.items():
        assert (got[k].first_ns, got[k].last_ns, got[k].n, got[k].last_comm) == (r.first_ns, r.last_ns, r.n, r.last_comm)
        assert len(got[k].features) == 427 and got[k].features == pytest.approx(r.features, abs=1e-12)


def test_work_of_a_batch_follows_its_rows(spark):
    """Many small batches of one process: parts are merged, and none is read before that."""
    class Map:
        def __init__(self):
            self.d, self.reads = {}, 0

        containsKey = lambda self, k: k in self.d
        updateValue = lambda self, k, v: self.d.__setitem__(k, v)
        removeKey = lambda self, k: self.d.pop(k)

        def getValue(self, k):
            self.reads += 1
            return self.d[k]

    p = V.WindowVectors(ST.stride_ns)
    p.parts, p.data = Map(), Map()
    p.handle = type("Handle", (), {"registerTimer": lambda self, t: None})()
    tokens = V.event_tokens(some_events(spark, 50).withColumn("event_time", F.lit(None).cast("timestamp")), ST).toPandas()
    tokens["pane"] = 7
    for _ in range(64):
        list(p.handleInputRows((0, 1), iter([tokens]), None))
    assert p.data.reads <= 80 and len(p.data.d) < V.COMPACT
    merged, steps = V._merged(p._read(7))
    assert merged[V.MEASURE, None, None] == 64 * (tokens.kind == V.MEASURE).sum()
    assert len(steps) == 64 * (tokens.kind == V.STEP).sum()


def test_windows_must_be_two_panes(spark):
    with pytest.raises(ValueError):
        V.vector_stream(L.with_event_time(some_events(spark, 5), 1), ST.with_(window_seconds=0))

"""Processes of a bucket share one state: what is called follows the buckets, what comes out the rows."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from hostlens import Settings
from hostlens.config import NS
from hostlens.streaming import live as L

ST = Settings(window_seconds=30, sequence_length=3)
MS = 1_000_000


class State:
    """Map and value state in memory; counts the calls."""

    def __init__(self, handle):
        self.d, self.handle = {}, handle

    def _of(name, do):
        def call(self, *args):
            self.handle.calls += 1
            return do(self, *args)

        return call

    containsKey = _of("containsKey", lambda self, k: k in self.d)
    getValue = _of("getValue", lambda self, k: self.d[k])
    updateValue = _of("updateValue", lambda self, k, v: self.d.__setitem__(k, v))
    removeKey = _of("removeKey", lambda self, k: self.d.pop(k))
    keys = _of("keys", lambda self: iter(list(self.d)))
    exists = _of("exists", lambda self: bool(self.d))
    get = _of("get", lambda self: self.d[()])
    update = _of("update", lambda self, v: self.d.__setitem__((), v))
    clear = _of("clear", lambda self: self.d.clear())


class Handle:
    def __init__(self):
        self.calls, self.timers, self.states = 0, set(), {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, State(self))

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def driven(processor, batches, delay_ns):
    """What ``processor`` gives for micro-batches of one bucket, and its handle."""
    handle, out, mark = Handle(), [], 0
    processor.init(handle)
    for batch in [*batches, None]:
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
        if batch is not None:
            out += processor.handleInputRows((0,), iter([batch]), times)
        for at in sorted(t for t in handle.timers if t < mark):
            out += processor.handleExpiredTimer((0,), times, SimpleNamespace(getExpiryTimeInMs=lambda: at))
            handle.timers.discard(at)
        mark = max(mark, (int(batch["ts_ns"].max()) - delay_ns) // MS) if batch is not None else mark
    mark = 1 << 50
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    for at in sorted(handle.timers):
        out += processor.handleExpiredTimer((0,), times, SimpleNamespace(getExpiryTimeInMs=lambda: at))
    return pd.concat(out), handle


def halves(n, pids, seed=4):
    rng = random.Random(seed)
    rows = [(pid % 4, pid, rng.choice(["enter", "exit"]), i, rng.randrange(200 * NS)) for i, pid in ((i, rng.randrange(pids)) for i in range(n))]
    return pd.DataFrame(rows, columns=["host_id", "pid", "kind", "event_id", "ts_ns"])


def paired(df):
    out, waiting = set(), {}
    for r in df.sort_values(["ts_ns", "event_id"]).itertuples():
        if r.kind == "enter":
            waiting[r.pid] = r
        elif r.pid in waiting:
            w = waiting.pop(r.pid)
            out.add((r.host_id, r.pid, w.event_id, r.event_id, w.ts_ns, r.ts_ns))
    return out


def arriving(df, cuts, late_ns, seed=5):
    """Micro-batches in which rows come up to ``late_ns`` late."""
    rng = random.Random(seed)
    at = df["ts_ns"] + [rng.randrange(late_ns) for _ in range(len(df))]
    number = (at * cuts // (at.max() + 1)).astype(int)
    return [df[number == i] for i in range(cuts)]


@pytest.mark.parametrize("rows", [30, 1 << 16])
def test_pairs_of_a_bucket(rows, monkeypatch):
    """Parts of few rows as well: the order holds across the stretches of a bucket."""
    monkeypatch.setattr(L, "PART_ROWS", rows)
    df = halves(900, 40)
    held = L.InEventTime(L.OpenEntry(), L.OpenEntry.columns, L.OpenEntry.order, "ts_ns", 5 * NS)
    got, _ = driven(held, arriving(df, 9, 20 * NS), 21 * NS)
    want = paired(df)
    assert set(got.itertuples(index=False, name=None)) == want and len(got) == len(want) > 100


def test_calls_follow_the_bucket(monkeypatch):
    """3,000 halves of 400 processes over 200 periods: few calls to the state, one timer a batch."""
    df = halves(3000, 400)
    held = L.InEventTime(L.OpenEntry(), L.OpenEntry.columns, L.OpenEntry.order, "ts_ns", NS)
    got, handle = driven(held, [df], 0)
    assert set(got.itertuples(index=False, name=None)) == paired(df)
    assert handle.calls < 30


def test_context_of_a_bucket():
    rng = random.Random(8)
    rows = [(pid % 4, pid, k, float(rng.randrange(50)), k * 15 * NS) for pid in range(60) for k in rng.sample(range(40), rng.randrange(1, 20))]
    df = pd.DataFrame(rows, columns=["host_id", "pid", "k", "value", "ts_ns"])
    columns = ["host_id", "pid", "k", "value", "ts_ns"]
    held = L.InEventTime(L.RollingContext(ST.sequence_length), columns, ["k"], "ts_ns", 20 * NS)
    got, handle = driven(held, arriving(df.sample(frac=1, random_state=1), 6, 90 * NS), 91 * NS)
    want = {}
    for pid, own in df.sort_values("k").groupby("pid"):
        for i, k in enumerate(own["k"]):
            last = own["value"].tolist()[max(0, i - 2): i + 1]
            want[pid, k] = (len(last), sum(last) / 3 if len(last) == 3 else None)
    assert len(got) == len(df)
    for r in got.itertuples():
        size, mean = want[r.pid, r.k]
        assert r.context_size == size and (r.context_mean == mean if mean is not None else r.context_mean != r.context_mean)
    assert handle.calls < 250


def test_a_period_of_many_rows_is_a_stretch(monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 10)
    periods = pd.Series([1] * 3 + [2] * 4 + [3] * 25 + [4] * 2 + [9] * 6 + [10] * 5).sample(frac=1, random_state=2).to_numpy()
    found = {first: sorted(set(periods[own])) for first, own in L.stretches(periods)}
    assert found == {1: [1, 2], 3: [3], 4: [4, 9], 10: [10]}

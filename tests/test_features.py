import math

import pytest
from pyspark.sql import functions as F

from hostlens import Settings
from hostlens.functions.dims import feature_dim, feature_names
from hostlens.operators import features as FE
from hostlens.operators.windows import Whole, hopping

from sessions import MS, SESSIONS, TEMPORAL, call, file, frame, net, proc

ST = Settings()
PROC = ["host_id", "pid"]


def vectors(events, settings=ST):
    return FE.checked(FE.vectors(events, Whole(PROC), PROC, settings))


def named(row):
    return dict(zip(feature_names(), row["features"]))


@pytest.fixture(scope="module")
def session_vectors(spark):
    """All sessions in one table, one pid each, extracted in one job."""
    whole = None
    pids = {}
    for pid, (name, (rows, _)) in enumerate(SESSIONS.items()):
        pids[pid] = name
        df = frame(spark, rows, pid=pid)
        whole = df if whole is None else whole.unionByName(df)
    return {pids[r["pid"]]: named(r) for r in vectors(whole).collect()}


@pytest.mark.parametrize("name", list(SESSIONS))
def test_session_features(session_vectors, name):
    expected = SESSIONS[name][1]
    got = session_vectors[name]
    for feature, value in got.items():
        if feature in TEMPORAL:
            continue
        assert value == pytest.approx(expected.get(feature, 0.0), abs=1e-6), feature


def test_layout(spark):
    names = feature_names()
    assert len(names) == 427 == len(set(names))
    dim = {r["name"]: r for r in feature_dim(spark).collect()}
    assert dim["lolbin_execution_count"]["salience"] == 3.0
    assert dim["lolbin_nc"]["salience"] == 2.5
    assert dim["syscall_59_freq"]["salience"] == 1.0
    assert dim["syscall_0_freq"]["salience"] == 0.2
    assert dim["syscall_bigram_3"]["salience"] == 0.3
    assert dim["syscall_59_freq"]["phrase"] == "elevated use of the execve syscall"
    assert dim["lolbin_nc"]["phrase"] == "executed the LOLBin 'nc'"


def test_benign_session(spark):
    rows = [
        call(0), call(1), call(0),
        file("/var/www/html/index.html", "open"), file("/var/www/html/index.html", "read"), file("/var/www/html/index.html", "write"),
        net("203.0.113.10", 443, 800), proc("python3", exe="/usr/bin/python3", cmdline="python3 app.py"),
    ]
    f = named(vectors(frame(spark, rows, pid=4242, base=1_000_000_000_000)).first())
    assert f["syscall_0_freq"] == pytest.approx(2 / 3)
    assert f["syscall_bigram_1"] == 0.5 and f["syscall_bigram_37"] == 0.5
    assert f["unique_files_opened"] == 0.02 and f["files_written_count"] == 0.02
    assert f["events_per_second"] == pytest.approx(8 / 30000)
    assert f["window_duration_ms"] == pytest.approx(7 / 30000)
    assert f["cpu_time_ratio"] == pytest.approx(1 / 300)
    for quiet in ("is_shell_spawned", "is_connecting_to_rfc1918", "is_using_tor_port", "files_in_system_dirs",
                  "is_injection_target", "pivot_root_attempt", "lolbin_execution_count"):
        assert f[quiet] == 0.0


def test_window_length_moves_rates(spark):
    events = frame(spark, [net("203.0.113.1", 443, 10)] * 10)
    long = named(vectors(events, ST.with_(window_seconds=300)).first())["outbound_connection_rate"]
    short = named(vectors(events, ST.with_(window_seconds=1)).first())["outbound_connection_rate"]
    assert long == pytest.approx(10 / 300 / 20) and short == pytest.approx(0.5)


def test_no_events_no_windows(spark):
    assert vectors(frame(spark, [])).count() == 0


def test_values_out_of_range_and_unicode_paths(spark):
    rows = [call(400), call(-1), call(334), file("/tmp/äöü€", "open"), file("", "read"), file(None, "read")]
    f = named(vectors(frame(spark, rows)).first())
    assert f["syscall_334_freq"] == 1.0
    text = "/tmp/äöü€"
    want = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text)) / 8
    assert f["entropy_of_file_paths"] == pytest.approx(want)


def brute_vector(rows, seconds):
    """The semantic part that is not plain counting, straight from the definition."""
    ts = sorted(r["ts_ns"] for r in rows)
    calls = [r["syscall_nr"] for r in sorted(rows, key=lambda r: (r["ts_ns"], r["event_id"])) if r["fam"] == 1]
    pairs = {}
    for a, b in zip(calls, calls[1:]):
        pairs[(a * 337 + b) % 50] = pairs.get((a * 337 + b) % 50, 0) + 1
    return {
        "n": len(rows),
        "active": len({(t - ts[0]) // 100_000_000 for t in ts}),
        "pairs": {k: v / sum(pairs.values()) for k, v in pairs.items()},
    }


@pytest.mark.parametrize("rows_per_task,chunk", [(2_000_000, 60), (40, 1)])
def test_hopping_windows_against_brute_force(spark, rows_per_task, chunk):
    """Same windows whether or not the key is treated as hot, for any chunk size."""
    import random

    rng = random.Random(3)
    t, rows = 5_000_000_000_000, []
    for i in range(300):
        t += rng.choice([3 * MS, 90 * MS, 700 * MS, 4_000 * MS])
        rows.append(dict(fam=1, syscall_nr=rng.randrange(5), ts_ns=t, event_id=i))
    rows += [dict(fam=1, syscall_nr=7, ts_ns=t + 1, event_id=1000, pid=1)]
    st = ST.with_(window_seconds=30, rows_per_task=rows_per_task, order_chunk_seconds=chunk)
    events = frame(spark, rows)
    got = {
        r["k"]: r
        for r in FE.vectors(events, hopping(events, PROC, st), PROC, st).where("pid = 6606").collect()
    }
    mine = [r for r in rows if r.get("pid") != 1]
    start, k, seen = mine[0]["ts_ns"], 0, 0
    while start + k * st.stride_ns <= mine[-1]["ts_ns"]:
        low = start + k * st.stride_ns
        inside = [r for r in mine if low <= r["ts_ns"] < low + st.window_ns]
        if inside:
            want, f = brute_vector(inside, 30), named(got[k])
            assert got[k]["n"] == want["n"]
            assert f["cpu_time_ratio"] == pytest.approx(want["active"] / 300)
            for b in range(50):
                assert f[f"syscall_bigram_{b}"] == pytest.approx(want["pairs"].get(b, 0.0))
            seen += 1
        else:
            assert k not in got
        k += 1
    assert seen == len(got)


def test_same_timestamps_give_one_window(spark):
    events = frame(spark, [call(1), call(2)], step=0)
    rows = FE.vectors(events, hopping(events, PROC, ST), PROC, ST).collect()
    assert [r["k"] for r in rows] == [0] and rows[0]["n"] == 2


def test_blocks_agree_with_vector(spark):
    rows = SESSIONS["attack_window"][0] + SESSIONS["dns_tunneling"][0]
    events = frame(spark, rows)
    names = ["entropy_of_file_paths", "avg_dns_query_size", "events_per_second", "is_shell_spawned"]
    one = FE.named_features(events, Whole(PROC), PROC, names, ST).first()
    f = named(vectors(events).first())
    assert all(one[n] == pytest.approx(f[n]) for n in names)


def test_vector_bounds_and_repartition(spark):
    from conftest import SF
    from hostlens.catalog.common import ST as CT
    from hostlens.sources.telemetry import telemetry

    t = telemetry(spark, SF)
    a = FE.vectors(t, hopping(t, PROC, CT), PROC, CT)
    bad = a.where(F.exists("features", lambda v: (v < 0) | (v > 1) | F.isnan(v)) | (F.size("features") != 427))
    assert bad.isEmpty()
    t2 = t.repartition(7)
    b = FE.vectors(t2, hopping(t2, PROC, CT), PROC, CT)
    key = lambda r: (r["host_id"], r["pid"], r["k"])
    left, right = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [key(r) for r in left] == [key(r) for r in right]
    for x, y in zip(left, right):
        assert x["features"] == pytest.approx(y["features"], abs=1e-12)

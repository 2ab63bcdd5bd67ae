from hostlens import Settings
from hostlens import constants as C
from hostlens.config import NS
from hostlens.sources import store as S
from hostlens.sources import telemetry as T
from pyspark.sql import functions as F
from sessions import SESSIONS, call, frame

ST = Settings()
DAY = 86_400 * NS


def all_events(spark):
    rows = [dict(r) for name in SESSIONS for r in SESSIONS[name][0]]
    return frame(spark, rows)


def test_envelope_round_trip(spark):
    events = all_events(spark)
    back = S.from_envelope(S.to_envelope(events))
    cols = [f.name for f in T.TELEMETRY_SCHEMA.fields]
    assert {f.name for f in back.schema.fields} == set(cols)
    a = events.select("event_id", "fam", "pid", "comm", "syscall_nr", "dst_ip", "dst_port", "payload_size", "operation", "action", "method", "target_pid")
    b = back.select(a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert '"event_type"' not in S.to_envelope(events).first()["data"]


def test_event_table(spark, tmp_path):
    path = str(tmp_path / "events")
    events = frame(spark, [dict(call(i), ts_ns=i * DAY + 5, pid=i % 3) for i in range(40)])
    S.write_events(events.where("event_id < 20"), path)
    S.write_events(events.where("event_id >= 20"), path)
    table = S.read_events(spark, path)
    assert table.count() == 40
    mine = S.by_pid(table, 0, 1, 4 * DAY, 10 * DAY)
    assert [r["event_id"] for r in mine.collect()] == [4, 7]
    assert [r["event_id"] for r in S.by_process_name(table, "app", limit=3).collect()] == [0, 1, 2]
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(" in plan
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert S.by_pid(table, 1, 1).isEmpty()  # the same pid on another host
    assert S.between(table, 3 * DAY + 5, 3 * DAY + 5).count() == 1 and S.between(table, 0, S.LONG_MAX).count() == 40

    now = 39 * DAY + 6
    assert S.expired_count(table, now, ST).first()["deleted"] == 10
    assert S.retained(table, now, ST).count() == 30
    assert S.apply_retention(spark, path, now, ST) == 10
    left = S.read_events(spark, path)
    assert left.count() == 30 and left.agg(F.min("event_id")).first()[0] == 10
    assert S.apply_retention(spark, path, now, ST) == 0


def test_missing_family_and_union(spark, tmp_path):
    events = all_events(spark)
    parts = T.split_families(events)
    assert len(parts) == 9
    path = str(tmp_path / "calls")
    parts[C.SYSCALL].write.parquet(path)
    loaded = T.load_families(spark, {C.SYSCALL: path, C.FILE: str(tmp_path / "nothing")})
    assert loaded.count() == parts[C.SYSCALL].count()
    assert loaded.columns == T.union_families(spark, {}).columns


def test_malformed_lines(spark):
    lines = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":1,',), ("",), ('{"a":"no"}',), ('{"a":2}',)], "value string")
    parsed, obs = S.observed(S.parse_lines(lines, "a bigint, b string"))
    assert sorted(r["a"] for r in S.good_records(parsed).collect()) == [1, 2]
    assert obs.get == {"records": 5, "dropped": 3}
    assert S.quarantine(S.parse_lines(lines, "a bigint, b string")).count() == 3


def test_registry(spark):
    empty = spark.createDataFrame([], "process_name string, created_unix double, path string, version int")
    new = spark.createDataFrame([("a", 1.0, "p1"), ("a", 2.0, "p2"), ("b", 1.0, "q")], "process_name string, created_unix double, path string")
    one = S.register(empty, new)
    two = S.register(one, spark.createDataFrame([("a", 3.0, "p3")], new.schema))
    assert [(r["version"], r["path"]) for r in S.versions_of(two, "a").collect()] == [(1, "p1"), (2, "p2"), (3, "p3")]
    assert {(r["process_name"], r["version"]) for r in S.latest_versions(two).collect()} == {("a", 3), ("b", 1)}


def test_baseline_table_replaces_one_process(spark, tmp_path):
    path = str(tmp_path / "baselines")
    cols = "host_id bigint, comm string, threshold double, n_windows bigint, n_sequences bigint, window_seconds int, sequence_length int"
    S.save_baselines(spark.createDataFrame([(0, "a", 1.0, 5, 1, 30, 20), (0, "b", 2.0, 5, 1, 30, 20)], cols), path)
    S.save_baselines(spark.createDataFrame([(0, "a", 9.0, 7, 1, 30, 20)], cols), path)
    table = S.load_baselines(spark, path)
    assert {(r["process_name"], r["threshold"]) for r in S.list_baselines(table).collect()} == {("a", 9.0), ("b", 2.0)}
    assert S.baseline_exists(table, "a") and not S.baseline_exists(table, "zzz")
    assert S.delete_baseline(table, "a").count() == 1
    assert S.load_baselines(spark, path, "b").count() == 1
    # the same program on another host is another baseline
    S.save_baselines(spark.createDataFrame([(1, "a", 5.0, 7, 1, 30, 20), (None, "a", 6.0, 7, 1, 30, 20)], cols), path)
    S.save_baselines(spark.createDataFrame([(1, "a", 5.5, 7, 1, 30, 20)], cols), path)
    rows = {(r["host_id"], r["comm"], r["threshold"]) for r in S.load_baselines(spark, path).collect()}
    assert rows == {(0, "a", 9.0), (0, "b", 2.0), (1, "a", 5.5), (None, "a", 6.0)}
    assert S.load_baselines(spark, path, "a", 1).first()["threshold"] == 5.5
    assert S.remove_baseline(spark, path, "a", 1) and not S.remove_baseline(spark, path, "a", 1)
    assert {(r["host_id"], r["comm"]) for r in S.load_baselines(spark, path).collect()} == {(0, "a"), (0, "b"), (None, "a")}


def test_safe_pids_are_kept(spark, tmp_path):
    path = str(tmp_path / "safe")
    assert S.load_safe_pids(spark, path).isEmpty()
    S.save_safe_pids(spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "host_id bigint, pid bigint"), path)
    S.save_safe_pids(S.load_safe_pids(spark, path).where("host_id = 1"), path)
    assert [tuple(r) for r in S.load_safe_pids(spark, path).collect()] == [(1, 1)]


def test_work_folder_is_shared_on_a_cluster():
    import pytest

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        S.work_root(Session())


def test_raw_decoding(spark):
    raw = spark.createDataFrame(
        [(1, 0, 5, 7, bytearray(b"nginx\x00"), 0x0100007F, 0x0500000A, 1, 2, 17, 10, 0),
         (2, 0, 5, 7, bytearray(b"nginx\x00"), 0x0100007F, 0x0500000A, 1, 2, 1, 10, 9)],
        "event_id bigint, host_id bigint, ts_ns bigint, pid bigint, comm binary, src_ip bigint, dst_ip bigint, src_port bigint, dst_port bigint, protocol int, bytes_count bigint, direction int")
    a, b = T.decode(raw, C.NETWORK).orderBy("event_id").collect()
    assert (a["src_ip"], a["dst_ip"], a["protocol"], a["direction"], a["comm"]) == ("127.0.0.1", "10.0.0.5", "UDP", "outbound", "nginx")
    assert (b["protocol"], b["direction"]) == ("1", "9")


def test_one_pass_equals_split_and_union(spark):
    events = all_events(spark)
    one, many = T.own_fields(events), T.union_families(spark, T.split_families(events))
    assert sorted(one.columns) == sorted(many.columns)
    many = many.select(one.columns)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    picked = S.from_envelope(S.to_envelope(events), [C.FILE])
    assert {r["fam"] for r in picked.select("fam").collect()} == {C.FILE}


def test_discarded_tables_are_gone(spark):
    from pyspark.errors import AnalysisException

    kept, gone = (S.materialize(spark.range(3), "some") for _ in range(2))
    S.discard(gone, spark.range(2))
    assert kept.count() == 3 and not S.exists(spark, gone.work_path)
    try:
        assert spark.read.parquet(gone.work_path).count() is None
    except AnalysisException:
        pass

"""Sources, sinks, envelope, retention, rules, baselines, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import constants as C
from hostlens.catalog.common import (
    DAY, NOW, NS, ST, T0, query, rule_entries, sql, stored, tel, verdict_feed,
)
from hostlens.operators import alerts as A
from hostlens.sources import store as S
from hostlens.sources import telemetry as T

SPLIT_SQL = (
    "SELECT event_id, fam, pid, comm, CASE WHEN fam IN (2, 9) THEN dst_ip END AS dst_ip, "
    "CASE WHEN fam IN (3, 8) THEN path END AS path, CASE WHEN fam = 9 THEN payload_size END AS payload_size FROM tel"
)


def _shape(df):
    return df.select("event_id", "fam", "pid", "comm", "dst_ip", "path", "payload_size")


@query("S02_union_families", sql(SPLIT_SQL, "tel"))
def union_families(spark, sf_dir):
    return _shape(T.own_fields(tel(spark, sf_dir)))


@query("U01_union_families", sql("SELECT fam, CAST(count(*) AS BIGINT) AS n, CAST(count(path) AS BIGINT) AS paths FROM tel GROUP BY 1", "tel"))
def u01(spark, sf_dir):
    whole = T.own_fields(tel(spark, sf_dir))
    return whole.groupBy("fam").agg(F.count("*").alias("n"), F.count("path").alias("paths"))


@query("S03_missing_family", sql("SELECT fam, CAST(count(*) AS BIGINT) AS n FROM tel WHERE fam <> 6 GROUP BY 1", "tel"))
def missing_family(spark, sf_dir):
    root = S.work_path(spark, "families")
    paths = {}
    for family, df in T.split_families(tel(spark, sf_dir)).items():
        paths[family] = f"{root}/fam={family}"
        if family != C.CONTAINER:
            df.write.parquet(paths[family])
    return T.load_families(spark, paths).groupBy("fam").agg(F.count("*").alias("n"))


def _lines(spark, sf_dir):
    """Events as JSON lines, every seventh one cut off in the middle."""
    text = F.to_json(F.struct("event_id", "pid", "ts_ns", "comm"))
    broken = F.pmod("event_id", F.lit(7)) == 0
    return tel(spark, sf_dir).select(F.when(broken, F.substring(text, 1, 25)).otherwise(text).alias("value"))


LINE_SCHEMA = "event_id bigint, pid bigint, ts_ns bigint, comm string"


@query("S04_malformed_dropped", sql("SELECT event_id, pid, ts_ns, comm FROM tel WHERE event_id % 7 <> 0", "tel"))
def malformed(spark, sf_dir):
    return S.good_records(S.parse_lines(_lines(spark, sf_dir), LINE_SCHEMA))


@query("S04b_quarantine", sql("SELECT substr('{\"event_id\":' || event_id || ',\"pid\":' || pid || ',\"ts_ns\":' || ts_ns, 1, 25) AS raw_line FROM tel WHERE event_id % 7 = 0", "tel"))
def quarantined(spark, sf_dir):
    return S.quarantine(S.parse_lines(_lines(spark, sf_dir), LINE_SCHEMA))


@query("S05_dropped_count", sql("SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (WHERE event_id % 7 = 0) AS BIGINT) AS dropped FROM tel", "tel"))
def dropped(spark, sf_dir):
    parsed = S.parse_lines(_lines(spark, sf_dir), LINE_SCHEMA)
    return parsed.agg(F.count("*").alias("records"), F.count_if("is_corrupt").alias("dropped"))


def event_store(spark, sf_dir):
    """Path of the events written to the day/family layout."""

    def build():
        path = S.work_path(spark, "events")
        S.write_events(tel(spark, sf_dir), path)
        return spark.createDataFrame([(path,)], "path string")

    return stored(spark, sf_dir, "event-store", build).first()["path"]


@query(
    "S06_append_events",
    sql(
        f"SELECT CAST(to_timestamp(ts_ns // {NS}) AT TIME ZONE 'UTC' AS DATE) AS event_date, fam AS event_type, CAST(count(*) AS BIGINT) AS n, "
        "CAST(sum(pid) AS BIGINT) AS pids FROM tel GROUP BY 1, 2", "tel",
    ),
)
def append_events(spark, sf_dir):
    events = S.read_events(spark, event_store(spark, sf_dir))
    return events.groupBy("event_date", "event_type").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


def _json_sql(fields: list[tuple[str, bool]]) -> str:
    """JSON text as written by the envelope: null fields are left out."""
    parts = ["'{\"timestamp_ns\":' || ts_ns || ',\"pid\":' || pid || ',\"comm\":\"' || comm || '\"'"]
    for name, quoted in fields:
        value = f"'\"' || {name} || '\"'" if quoted else name
        parts.append(f"CASE WHEN {name} IS NULL THEN '' ELSE ',\"{name}\":' || {value} END")
    return " || ".join(parts) + " || '}'"


ENVELOPE_SQL = "CASE fam " + " ".join(
    f"WHEN {k} THEN {_json_sql(v)}"
    for k, v in {
        1: [("syscall_nr", False)],
        2: [("dst_ip", True), ("dst_port", False), ("protocol", True), ("bytes_count", False), ("direction", True)],
        3: [("path", True), ("operation", True), ("bytes_count", False)],
        4: [("exe_path", True), ("cmdline", True), ("action", True)],
        5: [("method", True)],
        6: [("action", True)],
        7: [],
        8: [("action", True), ("path", True)],
        9: [("dst_ip", True), ("dst_port", False), ("payload_size", False)],
    }.items()
) + " END"


@query("S08_envelope", sql(f"SELECT event_id, host_id, ts_ns, fam AS event_type, pid, comm, {ENVELOPE_SQL} AS data FROM tel", "tel"))
def envelope(spark, sf_dir):
    return S.to_envelope(tel(spark, sf_dir))


@query("S09_typed_events", sql("SELECT event_id, fam, pid, comm, syscall_nr, dst_ip, path, action, payload_size FROM tel", "tel"))
def typed(spark, sf_dir):
    events = S.from_envelope(S.to_envelope(tel(spark, sf_dir)))
    return events.select("event_id", "fam", "pid", "comm", "syscall_nr", "dst_ip", "path", "action", "payload_size")


_FROM, _TO = T0 + 5 * DAY * NS, T0 + 25 * DAY * NS


@query("S10_events_of_pid", sql(f"SELECT event_id, ts_ns, fam AS event_type, comm FROM tel WHERE host_id = 3 AND pid = 7 AND ts_ns BETWEEN {_FROM} AND {_TO}", "tel"))
def by_pid(spark, sf_dir):
    events = S.read_events(spark, event_store(spark, sf_dir))
    return S.by_pid(events, 3, 7, _FROM, _TO).select("event_id", "ts_ns", "event_type", "comm")


@query("S11_events_of_process", sql(f"SELECT event_id, ts_ns, fam AS event_type, pid FROM tel WHERE comm = 'nginx' AND ts_ns BETWEEN {_FROM} AND {_TO}", "tel"))
def by_name(spark, sf_dir):
    events = S.read_events(spark, event_store(spark, sf_dir))
    return S.by_process_name(events, "nginx", _FROM, _TO).select("event_id", "ts_ns", "event_type", "pid")


@query("S12_retention", sql(f"SELECT fam AS event_type, CAST(count(*) AS BIGINT) AS n, min(ts_ns) AS oldest FROM tel WHERE ts_ns >= {NOW - 10 * DAY * NS + 3600 * NS} GROUP BY 1", "tel"))
def retention(spark, sf_dir):
    """Rewrites a copy of the event store and reads what is left."""
    path = S.work_path(spark, "retention-events")
    S.write_events(tel(spark, sf_dir), path)
    S.apply_retention(spark, path, NOW + 3600 * NS, ST)
    left = S.read_events(spark, path)
    return left.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts_ns").alias("oldest"))


@query("S12b_retention_count", sql(f"SELECT CAST(count(*) AS BIGINT) AS deleted FROM tel WHERE ts_ns < {NOW - 10 * DAY * NS}", "tel"))
def retention_count(spark, sf_dir):
    return S.expired_count(tel(spark, sf_dir), NOW, ST)


@query("S13_append_alerts", sql("SELECT host_id, process_name, pid, score, severity, timestamp_ns, false AS acknowledged FROM alerts", "alerts"))
def append_alerts(spark, sf_dir):
    path = S.work_path(spark, "alerts")
    made = A.build_alerts(verdict_feed(spark, sf_dir).where(F.col("final_score") >= ST.high))
    A.append_alerts(made, path)
    back = spark.read.schema(made.schema).parquet(path)
    return back.select("host_id", "process_name", "pid", "score", "severity", "timestamp_ns", "acknowledged")


@query("S14_rule_file", sql("SELECT process_name, reason, max_score_suppress, expires_at, created_by FROM rules", "rules"))
def rule_file(spark, sf_dir):
    """Rule lines are parsed, reduced to the last per process, saved and loaded."""
    path = S.work_path(spark, "rules")
    S.save_rules(rules(spark, sf_dir), path)
    return S.load_rules(spark, path)


def rules(spark, sf_dir):
    lines = rule_entries(spark, sf_dir).select(
        "position", F.to_json(F.struct("process_name", "reason", "max_score_suppress", "expires_at")).alias("value")
    )
    parsed = S.rules_from_json(lines).where("valid").drop("valid")
    return S.last_rule_per_process(parsed, "position")


def _registry_rows(spark, sf_dir):
    """Training runs recorded so far, and the ones to be added."""
    t = tel(spark, sf_dir)
    runs = t.groupBy(F.col("comm").alias("process_name"), "host_id").agg(
        F.count("*").alias("num_windows"), (F.max("ts_ns") / F.lit(1e9)).alias("created_unix")
    )
    old = runs.where("host_id = 0").withColumn("version", F.lit(1)).drop("host_id")
    new = runs.where("host_id > 0").drop("host_id")
    return old, new


REGISTRY_SQL = (
    "runs AS (SELECT comm AS process_name, host_id, CAST(count(*) AS BIGINT) AS num_windows, max(ts_ns) / 1e9 AS created_unix FROM tel GROUP BY 1, 2), "
    "reg AS (SELECT process_name, num_windows, created_unix, 1 AS version FROM runs WHERE host_id = 0 UNION ALL "
    "SELECT process_name, num_windows, created_unix, CAST(row_number() OVER (PARTITION BY process_name ORDER BY created_unix) + "
    "(SELECT count(*) FROM runs o WHERE o.host_id = 0 AND o.process_name = r.process_name) AS INT) FROM runs r WHERE host_id > 0) "
)


@query("S17_register_version", sql("--MORE" + REGISTRY_SQL + "SELECT * FROM reg", "tel"))
def register(spark, sf_dir):
    old, new = _registry_rows(spark, sf_dir)
    return S.register(old, new)


@query("S18_latest_version", sql("--MORE" + REGISTRY_SQL + "SELECT process_name, max(version) AS version, arg_max(num_windows, version) AS num_windows, arg_max(created_unix, version) AS created_unix FROM reg GROUP BY 1", "tel"))
def latest(spark, sf_dir):
    old, new = _registry_rows(spark, sf_dir)
    return S.latest_versions(S.register(old, new))


@query("S18b_versions_of_process", sql("--MORE" + REGISTRY_SQL + "SELECT * FROM reg WHERE process_name = 'bash'", "tel"))
def versions(spark, sf_dir):
    old, new = _registry_rows(spark, sf_dir)
    return S.versions_of(S.register(old, new), "bash")


@query("U02_split_families", sql("SELECT event_id, fam, syscall_nr, CASE WHEN fam = 4 THEN action END AS process_action FROM tel WHERE fam IN (1, 4)", "tel"))
def split(spark, sf_dir):
    parts = T.split_families(tel(spark, sf_dir))
    calls = parts[C.SYSCALL].select("event_id", F.lit(1).alias("fam"), "syscall_nr", F.lit(None).cast("string").alias("process_action"))
    procs = parts[C.PROCESS].select("event_id", F.lit(4).alias("fam"), F.lit(None).cast("bigint").alias("syscall_nr"), F.col("action").alias("process_action"))
    return calls.unionByName(procs)


FAMILY_DETAIL = {
    C.SYSCALL: ["syscall_nr"], C.NETWORK: ["dst_ip", "dst_port", "direction", "bytes_count"], C.FILE: ["path", "operation"],
    C.PROCESS: ["action", "exe_path", "cmdline"], C.INJECTION: ["comm"], C.CONTAINER: ["action"], C.LOLBIN: ["comm"],
    C.ANTIFORENSIC: ["action", "path"], C.DNS_TUNNEL: ["dst_ip", "dst_port", "payload_size"],
}
_DETAIL_SQL = " ".join(
    f"WHEN {f} THEN concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})" for f, columns in FAMILY_DETAIL.items()
)


@query("U02b_split_all_families", sql(f"SELECT event_id, fam, pid, CASE fam {_DETAIL_SQL} END AS detail FROM tel", "tel"))
def split_all(spark, sf_dir):
    """All nine families, each with fields of its own, put under each other again."""
    parts, out = T.split_families(tel(spark, sf_dir)), None
    for family, columns in FAMILY_DETAIL.items():
        own = parts[family].select(
            "event_id", F.lit(family).alias("fam"), "pid", F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("detail")
        )
        out = own if out is None else out.unionByName(own)
    return out

"""Predicates, scalar functions, raw decoding and derived threat layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import constants as C
from hostlens.catalog.common import DAY, NS, T0, query, sql, tel, table, verdict_feed, lit_list
from hostlens.catalog.scans import rules
from hostlens.catalog import vector_sql as V
from hostlens.functions import dims
from hostlens.functions import scalars as X
from hostlens.operators import derive as D
from hostlens.operators import scoring
from hostlens.sources import store as S
from hostlens.sources import telemetry as T

# --- capture filters ---------------------------------------------------------


@query("P01_exclude_self", sql("SELECT event_id, pid FROM (SELECT event_id, pid, pid % 10 AS tgid FROM tel) WHERE tgid NOT IN (0, 3, 5)", "tel"))
def p01(spark, sf_dir):
    t = tel(spark, sf_dir).withColumn("tgid", F.pmod("pid", F.lit(10)))
    return D.exclude_self(t, [3, 5]).select("event_id", "pid")


@query("P02_succeeded", sql("SELECT event_id, pid, dst_ip FROM tel WHERE fam = 2 AND k % 4 = 0", "tel"))
def p02(spark, sf_dir):
    t = tel(spark, sf_dir).where("fam = 2").withColumn("ret", -F.pmod("k", F.lit(4)))
    return D.succeeded(t).select("event_id", "pid", "dst_ip")


@query("P03_attach_class", sql("SELECT event_id, pid FROM tel WHERE (k & 2) <> 0", "tel"))
def p03(spark, sf_dir):
    return D.attach_class(tel(spark, sf_dir).withColumn("mode", F.col("k"))).select("event_id", "pid")


def _calls(spark, sf_dir):
    """Telemetry with syscall arguments; every third file write hits a memory file."""
    mem = (F.col("operation") == "write") & (F.pmod("event_id", F.lit(3)) == 0)
    return tel(spark, sf_dir).select(
        "event_id", "host_id", "ts_ns", "pid", "comm", "fam", "operation",
        # spread the calls over the numbers the derivations look at
        F.when(F.col("fam") == 1, F.element_at(
            F.array(*[F.lit(n) for n in (101, 311, 308, 272, 155, 0)]), (F.pmod("k", F.lit(6)) + 1).cast("int")
        )).cast("bigint").alias("syscall_nr"),
        F.array(F.pmod("event_id", F.lit(20)), F.pmod("event_id", F.lit(100)), F.col("k").cast("bigint")).alias("args"),
        F.when(mem, F.concat(F.lit("/proc/"), F.col("pid").cast("string"), F.lit("/mem"))).otherwise(F.col("path")).alias("path"),
    )


CALLS = (
    "calls AS (SELECT event_id, host_id, ts_ns, pid, comm, fam, operation, CASE WHEN fam = 1 THEN CAST([101, 311, 308, 272, 155, 0][k % 6 + 1] AS BIGINT) END AS syscall_nr, "
    "event_id % 20 AS a1, event_id % 100 AS a2, CASE WHEN operation = 'write' AND event_id % 3 = 0 THEN '/proc/' || pid || '/mem' ELSE path END AS path FROM tel) "
)


@query(
    "P04_derive_injection",
    sql(
        "--MORE" + CALLS + "SELECT event_id, pid, 'ptrace' AS method, a2 AS target_pid FROM calls WHERE fam = 1 AND syscall_nr = 101 AND a1 IN (4, 5, 6, 16, 16902) "
        "UNION ALL SELECT event_id, pid, 'process_vm_writev', a1 FROM calls WHERE fam = 1 AND syscall_nr = 311 "
        "UNION ALL SELECT event_id, pid, 'proc_mem', 0 FROM calls WHERE fam = 3 AND operation = 'write' AND regexp_matches(path, '^/proc/[^/]+/mem$')", "tel",
    ),
)
def p04(spark, sf_dir):
    return D.injections(_calls(spark, sf_dir)).select("event_id", "pid", "method", "target_pid")


@query(
    "P05_derive_container",
    sql("--MORE" + CALLS + "SELECT event_id, pid, CASE syscall_nr WHEN 308 THEN 'setns' WHEN 272 THEN 'unshare' ELSE 'pivot_root' END AS action, "
        "CASE syscall_nr WHEN 308 THEN a2 WHEN 272 THEN a1 ELSE 0 END AS flags FROM calls WHERE fam = 1 AND syscall_nr IN (308, 272, 155)", "tel"),
)
def p05(spark, sf_dir):
    return D.container_escapes(_calls(spark, sf_dir)).select("event_id", "pid", "action", "flags")


@query("P06_derive_lolbin", sql(f"SELECT event_id, pid, comm FROM tel WHERE fam = 4 AND action = 'exec' AND comm IN {lit_list(C.LOLBIN_EXEC_WATCHLIST)}", "tel"))
def p06(spark, sf_dir):
    return D.lolbins(tel(spark, sf_dir)).select("event_id", "pid", "comm")


@query("P06b_lolbin_watchlist_table", sql(f"SELECT event_id, pid, comm FROM tel WHERE fam = 4 AND action = 'exec' AND comm IN {lit_list(C.LOLBIN_EXEC_WATCHLIST)}", "tel"))
def p06b(spark, sf_dir):
    return D.lolbins(tel(spark, sf_dir), D.lolbin_watchlist(spark)).select("event_id", "pid", "comm")


@query("P07_derive_log_tamper", sql("SELECT event_id, pid, action, path FROM tel WHERE action IN ('truncate', 'timestomp') AND starts_with(path, '/var/log')", "tel"))
def p07(spark, sf_dir):
    return D.log_tampering(tel(spark, sf_dir)).select("event_id", "pid", "action", "path")


LOGGED = "regexp_replace(path, '^/var/log/app', '/srv/log')"


@query(
    "P08_derive_log_deletion",
    sql(f"SELECT event_id, pid, 'unlink' AS action, 'log/' || {V.base_sql('path')} AS path FROM (SELECT event_id, pid, operation, {LOGGED} AS path FROM tel WHERE fam = 3) "
        "WHERE operation = 'unlink' AND string_split(path, '/')[-2] = 'log'", "tel"),
)
def p08(spark, sf_dir):
    files = tel(spark, sf_dir).where("fam = 3").withColumn("path", F.regexp_replace("path", "^/var/log/app", "/srv/log"))
    return D.log_deletions(files).select("event_id", "pid", "action", "path")


@query("P09_derive_dns_tunnel", sql("SELECT event_id, pid, dst_ip, dst_port, bytes_count AS payload_size FROM tel WHERE fam = 2 AND protocol = 'UDP' AND dst_port = 53 AND bytes_count > 100", "tel"))
def p09(spark, sf_dir):
    return D.dns_tunnels(tel(spark, sf_dir).where("fam = 2")).select("event_id", "pid", "dst_ip", "dst_port", "payload_size")


@query("P10_destination", sql("SELECT event_id, coalesce(CASE WHEN k % 2 = 0 THEN dst_ip END, '203.0.113.' || k) AS dst_ip FROM tel WHERE fam = 2", "tel"))
def p10(spark, sf_dir):
    t = tel(spark, sf_dir).where("fam = 2").withColumn("msg_addr", F.when(F.pmod("k", F.lit(2)) == 0, F.col("dst_ip")))
    return D.destination(t.withColumn("sock_addr", F.concat(F.lit("203.0.113."), F.col("k").cast("string")))).select("event_id", "dst_ip")


# --- value predicates ---------------------------------------------------------------

def _flag(name, column, sql_text, family):
    @query(name, sql(f"SELECT event_id, coalesce({sql_text}, false) AS hit FROM tel WHERE fam = {family}", "tel"))
    def run(spark, sf_dir):
        return tel(spark, sf_dir).where(F.col("fam") == family).select("event_id", F.coalesce(column(), F.lit(False)).alias("hit"))


_flag("P11_sensitive_path", lambda: X.is_sensitive_path(F.col("path")), V.SENSITIVE, 3)
_flag("P12_system_dir", lambda: X.in_system_dir(F.col("path")), V.SYSTEM, 3)
_flag("P13_executable_path", lambda: X.looks_executable(F.col("path")), V.EXECUTABLE, 3)
_flag("P14_shell", lambda: X.is_shell(F.col("comm"), F.col("exe_path"), F.col("cmdline")), V.SHELL, 4)
_flag("P15_priv_esc_syscall", lambda: X.is_priv_esc(F.col("syscall_nr")), f"syscall_nr IN {lit_list(C.PRIV_ESC_SYSCALLS)}", 1)
_flag("P16_tor_port", lambda: X.is_tor_port(F.col("dst_port")), V.TOR, 2)
_flag("P17_rfc1918", lambda: X.is_rfc1918(F.col("dst_ip")), V.PRIVATE, 2)


@query("P18_lolbin_alias", sql("SELECT event_id, " + ", ".join(f"{V.lolbin_sql(n)} AS {n if n != 'at' else 'at_'}" for n in C.LOLBINS) + " FROM tel WHERE fam = 7", "tel"))
def p18(spark, sf_dir):
    bits = X.lolbin_bits(F.col("comm"))
    return tel(spark, sf_dir).where("fam = 7").select(
        "event_id", *[(F.getbit(bits, F.lit(i)) == 1).alias(n if n != "at" else "at_") for i, n in enumerate(C.LOLBINS)]
    )


@query("U03_shell_names", sql(f"SELECT event_id, len(list_intersect([lower(comm), lower({V.base_sql('exe_path')})], {list(C.SHELLS)})) > 0 AS shell_name FROM tel WHERE fam = 4", "tel"))
def u03(spark, sf_dir):
    names = F.array(F.lower("comm"), F.lower(X.basename(F.col("exe_path"))))
    return tel(spark, sf_dir).where("fam = 4").select("event_id", F.arrays_overlap(names, F.array(*[F.lit(s) for s in C.SHELLS])).alias("shell_name"))


@query("P19_anomalous", sql("SELECT event_id, final_score FROM feed WHERE final_score >= 70", "feed"))
def p19(spark, sf_dir):
    return verdict_feed(spark, sf_dir).where(scoring.is_anomalous(F.col("final_score"))).select("event_id", "final_score")


@query("P20_with_baseline", sql("SELECT event_id, final_score FROM feed WHERE model_available", "feed"))
def p20(spark, sf_dir):
    return verdict_feed(spark, sf_dir).where("model_available").select("event_id", "final_score")


NOW_TS = "TIMESTAMP '2024-01-31 00:00:00'"


@query("P21_active_rules", sql(f"SELECT process_name, max_score_suppress FROM rules WHERE expires_at IS NULL OR {NOW_TS} < expires_at", "rules"))
def p21(spark, sf_dir):
    return rules(spark, sf_dir).where(S.rule_is_active(F.expr(NOW_TS))).select("process_name", "max_score_suppress")


@query("P22_alert_filters", sql(f"SELECT alert_id, score FROM alerts WHERE severity = 'CRITICAL' AND process_name = 'bash' AND NOT acknowledged AND created_unix BETWEEN {(T0 + 5 * DAY * NS) / 1e9} AND {(T0 + 28 * DAY * NS) / 1e9} ORDER BY created_unix DESC, alert_id DESC LIMIT 1000", "alerts"))
def p22(spark, sf_dir):
    from hostlens.catalog.common import alert_table
    from hostlens.operators.alerts import list_alerts

    return list_alerts(
        alert_table(spark, sf_dir), severity="CRITICAL", process_name="bash", acknowledged=False,
        from_unix=(T0 + 5 * DAY * NS) / 1e9, to_unix=(T0 + 28 * DAY * NS) / 1e9, limit=1000,
    ).select("alert_id", "score")


@query("P23_training_filter", sql("SELECT host_id, comm, CAST(count(*) AS BIGINT) AS events FROM tel WHERE comm = 'sshd' GROUP BY 1, 2", "tel"))
def p23(spark, sf_dir):
    from hostlens.plans.training import observed_events

    return observed_events(tel(spark, sf_dir), process="sshd").groupBy("host_id", "comm").agg(F.count("*").alias("events"))


# --- scalar functions -------------------------------------------------------------------


@query("X01_c_string", "SELECT doc_id, trim(string_split(text || chr(10), chr(46))[1], chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS head FROM documents")
def x01(spark, sf_dir):
    """Text with a NUL in place of each full stop, as raw bytes."""
    raw = F.replace(F.concat(F.col("text"), F.lit("\n")), F.lit("."), F.lit("\u0000")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", X.c_string(raw).alias("head"))


@query("X02_signed64", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -CAST(event_id AS BIGINT) - 1 ELSE CAST(event_id AS BIGINT) END AS ret FROM events")
def x02(spark, sf_dir):
    big = F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("event_id").cast("decimal(20,0)")
    unsigned = F.when(F.pmod("event_id", F.lit(2)) == 0, big).otherwise(F.col("event_id").cast("decimal(20,0)"))
    return table(spark, sf_dir, "events").select("event_id", X.to_signed64(unsigned.cast("decimal(20,0)")).alias("ret"))


_PACKED = "(event_id * 2654435761) % 4294967296"


@query("X03_ipv4_text", f"SELECT event_id, concat_ws('.', v & 255, (v >> 8) & 255, (v >> 16) & 255, (v >> 24) & 255) AS ip FROM (SELECT event_id, {_PACKED} AS v FROM events)")
def x03(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.ipv4_text(F.expr(_PACKED)).alias("ip"))


def _labels(name, fn, labels, prefix, modulo):
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items())

    @query(name, f"SELECT event_id, CASE c {cases} ELSE '{prefix}' || c END AS label FROM (SELECT event_id, event_id % {modulo} AS c FROM events)")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "events").select("event_id", fn(F.pmod("event_id", F.lit(modulo))).alias("label"))


_labels("X04_protocol", X.protocol_label, C.PROTOCOL_LABELS, "", 20)
_labels("X05_direction", X.direction_label, C.DIRECTION_LABELS, "", 4)
_labels("X06_file_operation", X.file_operation_label, C.FILE_OPERATIONS, "operation_", 10)
_labels("X07_process_action", X.process_action_label, C.PROCESS_ACTIONS, "action_", 5)
_labels("X08_injection_method", X.injection_method_label, C.INJECTION_METHODS, "method_", 5)
_labels("X09_container_action", X.container_action_label, C.CONTAINER_ACTIONS, "action_", 5)
_labels("X10_antiforensic_action", X.antiforensic_action_label, C.ANTIFORENSIC_ACTIONS, "action_", 5)


def raw_records(spark, sf_dir, family):
    """Numeric records of a family, as a capture layer would hand them over."""
    t = tel(spark, sf_dir).where(F.col("fam") == family)
    padded = lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit("\u0000junk")).cast("binary")
    e = F.col("event_id")
    unsigned = F.when(F.pmod("k", F.lit(4)) == 0, F.expr("18446744073709551615BD - k")).otherwise(F.col("k").cast("decimal(20,0)"))
    base = t.select("event_id", "host_id", "ts_ns", "pid", padded(F.col("comm")).alias("comm"), "k", "syscall_nr", "dst_port",
                    "bytes_count", "payload_size", padded(F.col("path")).alias("path"),
                    padded(F.col("exe_path")).alias("exe_path"), padded(F.col("cmdline")).alias("cmdline"))
    return (
        base.withColumn("tgid", F.col("pid")).withColumn("uid", F.pmod(e, F.lit(3))).withColumn("ppid", F.pmod(e, F.lit(50)))
        .withColumn("ret", unsigned.cast("decimal(20,0)")).withColumn("args", F.array(e, F.col("pid"), F.lit(0).cast("bigint")))
        .withColumn("src_ip", F.expr(_PACKED)).withColumn("dst_ip", F.expr(_PACKED)).withColumn("src_port", F.pmod(e, F.lit(65536)))
        .withColumn("protocol", F.when(F.pmod(e, F.lit(3)) == 0, 17).when(F.pmod(e, F.lit(3)) == 1, 6).otherwise(1))
        .withColumn("direction", F.pmod(e, F.lit(3)).cast("int")).withColumn("operation", F.pmod(e, F.lit(6)).cast("int"))
        .withColumn("action", F.pmod(e, F.lit(4)).cast("int")).withColumn("method", F.pmod(e, F.lit(4)).cast("int"))
        .withColumn("flags", F.pmod(e, F.lit(8))).withColumn("exit_code", F.pmod(e, F.lit(256))).withColumn("target_pid", F.pmod(e, F.lit(99)))
    )


def _case(labels, prefix, mod):
    return "CASE event_id % " + str(mod) + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + f" ELSE '{prefix}' || (event_id % {mod}) END"


_IP = f"concat_ws('.', ({_PACKED}) & 255, (({_PACKED}) >> 8) & 255, (({_PACKED}) >> 16) & 255, (({_PACKED}) >> 24) & 255)"
_RET = "CASE WHEN k % 4 = 0 THEN -CAST(k AS BIGINT) - 1 ELSE CAST(k AS BIGINT) END AS ret"


def _names_sql():
    rows = ", ".join(f"({n}, '{name}')" for n, name in sorted(dims.syscall_names().items()))
    return f"(VALUES {rows}) AS d(nr, name)"


NAME_SQL = f"coalesce(d.name, 'syscall_' || syscall_nr)"
DECODED = {
    C.SYSCALL: f"event_id, comm, pid AS tgid, event_id % 3 AS uid, syscall_nr, {NAME_SQL} AS syscall_name, {_RET} FROM tel LEFT JOIN {_names_sql()} ON nr = syscall_nr",
    C.NETWORK: f"event_id, comm, {_IP} AS src_ip, {_IP} AS dst_ip, event_id % 65536 AS src_port, dst_port, CASE event_id % 3 WHEN 0 THEN 'UDP' WHEN 1 THEN 'TCP' ELSE '1' END AS protocol, bytes_count, {_case(C.DIRECTION_LABELS, '', 3)} AS direction FROM tel",
    C.FILE: f"event_id, comm, path, {_case(C.FILE_OPERATIONS, 'operation_', 6)} AS operation, event_id % 8 AS flags, {_RET}, bytes_count FROM tel",
    C.PROCESS: f"event_id, comm, event_id % 50 AS ppid, exe_path, cmdline, {_case(C.PROCESS_ACTIONS, 'action_', 4)} AS action, event_id % 256 AS exit_code FROM tel",
    C.INJECTION: f"event_id, comm, event_id % 3 AS uid, event_id % 99 AS target_pid, {_case(C.INJECTION_METHODS, 'method_', 4)} AS method FROM tel",
    C.CONTAINER: f"event_id, comm, event_id % 3 AS uid, {_case(C.CONTAINER_ACTIONS, 'action_', 4)} AS action, event_id % 8 AS flags FROM tel",
    C.LOLBIN: "event_id, comm, event_id % 50 AS ppid, event_id % 3 AS uid FROM tel",
    C.ANTIFORENSIC: f"event_id, comm, event_id % 3 AS uid, {_case(C.ANTIFORENSIC_ACTIONS, 'action_', 4)} AS action, path FROM tel",
    C.DNS_TUNNEL: f"event_id, comm, event_id % 3 AS uid, {_IP} AS dst_ip, dst_port, payload_size FROM tel",
}


def _decoded(family, text):
    @query(f"X11_decode_{C.FAMILY_NAMES[family]}", sql(f"SELECT {text} WHERE fam = {family}", "tel"))
    def run(spark, sf_dir):
        out = T.decode(raw_records(spark, sf_dir, family), family)
        return out.drop("host_id", "ts_ns", "pid", "args")


for _family, _text in DECODED.items():
    _decoded(_family, _text)


@query("X12_port_swap", "SELECT event_id, CAST(((v >> 8) | (v << 8)) & 65535 AS INTEGER) AS port FROM (SELECT event_id, (event_id * 7919) % 65536 AS v FROM events)")
def x12(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.be16_to_host(F.expr("(event_id * 7919) % 65536")).alias("port"))


@query("X13_exit_status", "SELECT event_id, ((event_id * 77) >> 8) & 255 AS status FROM events")
def x13(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.exit_status(F.expr("event_id * 77")).alias("status"))


@query("X14_flatten_argv", "SELECT doc_id, substr(array_to_string(string_split(text, ' ')[1:16], ' '), 1, 255) AS cmdline FROM documents")
def x14(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.flatten_argv(F.split("text", " ")).alias("cmdline"))


@query("X15_basename", f"SELECT page_id, {V.base_sql('url')} AS base FROM pages")
def x15(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.basename(F.col("url")).alias("base"))


@query("X16_first_token", "SELECT conv_id, turn, regexp_extract(text, '[^ \\t\\n\\r\\f\\v]+') AS token FROM conversations")
def x16(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_token(F.col("text")).alias("token"))


@query("X17_parent_name", "SELECT page_id, CASE WHEN len(p) > 1 THEN p[-2] || '/' ELSE '' END || p[-1] AS short FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)")
def x17(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.parent_slash_name(F.col("url")).alias("short"))


@query("X18_bigram_hash", sql(f"SELECT event_id, CAST(({V.SLOT} * 337 + k) % 50 AS INTEGER) AS bucket FROM tel WHERE fam = 1", "tel"))
def x18(spark, sf_dir):
    return tel(spark, sf_dir).where("fam = 1").select("event_id", X.bigram_bucket(X.syscall_slot(F.col("syscall_nr")), F.col("k")).alias("bucket"))


@query("X19_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 2))), 8) AS p FROM events")
def x19(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(X.sigmoid(F.col("value") - 2.0), 8).alias("p"))


@query("X20_duration", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN n WHEN 1 THEN n * 60 WHEN 2 THEN n * 3600 WHEN 3 THEN n * 86400 END AS seconds FROM (SELECT event_id, event_id % 1000 AS n FROM events)")
def x20(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "M", " h", "d ", "y")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    text = F.concat(F.pmod("event_id", F.lit(1000)).cast("string"), unit)
    return table(spark, sf_dir, "events").select("event_id", X.duration_seconds(text).alias("seconds"))


@query("X21_detail_json", sql("SELECT event_id, '{\"path\":\"' || path || '\",\"operation\":\"' || operation || '\",\"bytes_count\":' || bytes_count || '}' AS detail FROM tel WHERE fam = 3", "tel"))
def x21(spark, sf_dir):
    return tel(spark, sf_dir).where("fam = 3").select("event_id", F.to_json(F.struct("path", "operation", "bytes_count")).alias("detail"))


@query("X22_expiry_parse", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS expires_at, event_id % 4 <> 0 AS valid FROM events")
def x22(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.pmod("event_id", F.lit(4)) == 0, F.concat(F.lit("soon "), iso)).otherwise(iso)
    lines = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.lit("p").alias("process_name"), text.alias("expires_at"))).alias("value"))
    return S.rules_from_json(lines).select("event_id", "expires_at", "valid")


@query("X23_rule_json", sql("SELECT process_name, '{\"process_name\":\"' || process_name || '\",\"reason\":\"' || reason || '\",\"max_score_suppress\":' || CAST(max_score_suppress AS VARCHAR) || ',\"expires_at\":' || coalesce('\"' || strftime(expires_at, '%Y-%m-%dT%H:%M:%S') || '\"', 'null') || ',\"created_by\":\"user\"}' AS value FROM rules", "rules"))
def x23(spark, sf_dir):
    return S.rules_to_json(rules(spark, sf_dir)).select(F.get_json_object("value", "$.process_name").alias("process_name"), "value")



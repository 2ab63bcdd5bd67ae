"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import constants as C
from hostlens.catalog.alerting import outcomes
from hostlens.catalog.common import DAY, NOW, NS, ST, alert_table, query, sql, tel, verdict_feed
from hostlens.catalog.decoding import NAME_SQL, _names_sql
from hostlens.catalog.fitting import NORM, baselines
from hostlens.catalog.joins import SUMMARY, summaries
from hostlens.functions.dims import syscall_dim
from hostlens.plans import reports as R


def _plist(spark, sf_dir):
    return R.processes(tel(spark, sf_dir), ST)


@query("R01_process_list", sql("--MORE" + SUMMARY + "SELECT * FROM plist", "feed"))
def r01(spark, sf_dir):
    return _plist(spark, sf_dir)


@query("R02_process_detail", sql("--MORE" + SUMMARY + "SELECT p.*, timestamp_ns, final_score AS score, severity FROM plist p LEFT JOIN feed f USING (host_id, pid) WHERE host_id = 1 AND pid = 9", "feed"))
def r02(spark, sf_dir):
    return R.process_detail(_plist(spark, sf_dir), verdict_feed(spark, sf_dir), 1, 9)


@query("R02b_score_history", sql("SELECT timestamp_ns, final_score AS score, severity FROM feed WHERE host_id = 1 AND pid = 9", "feed"))
def r02b(spark, sf_dir):
    return R.score_history(verdict_feed(spark, sf_dir), 1, 9)


DETAIL = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '' ELSE ',\"{c}\":' || " + (f"'\"' || {c} || '\"'" if q else c) + " END"
    for c, q in [("syscall_nr", 0), ("dst_ip", 1), ("dst_port", 0), ("path", 1), ("operation", 1), ("action", 1)]
)


@query("R03_event_feed", sql(f"SELECT event_id, ts_ns AS timestamp_ns, fam AS event_type, pid, comm, '{{' || substr({DETAIL}, 2) || '}}' AS detail FROM (SELECT * FROM tel WHERE host_id = 1 AND pid = 9 ORDER BY ts_ns DESC, event_id DESC LIMIT 50)", "tel"))
def r03(spark, sf_dir):
    return R.event_feed(tel(spark, sf_dir), 1, 9, ["syscall_nr", "dst_ip", "dst_port", "path", "operation", "action"], 50)


@query("R04_alert_page", sql("--MORE pg AS (SELECT * FROM alerts WHERE process_name = 'nginx' ORDER BY created_unix DESC, alert_id DESC LIMIT 25) SELECT alert_id, score, CAST((SELECT count(*) FROM pg) AS BIGINT) AS total, CAST((SELECT count(*) FROM alerts WHERE NOT acknowledged) AS BIGINT) AS unacknowledged FROM pg", "alerts"))
def r04(spark, sf_dir):
    page = R.alert_page(alert_table(spark, sf_dir), limit=25, process_name="nginx")
    return page.select("alert_id", "score", "total", "unacknowledged")


@query("R05_syscall_frequency", sql(f"SELECT {NAME_SQL} AS syscall_name, CAST(count(*) AS BIGINT) AS n FROM tel LEFT JOIN {_names_sql()} ON nr = syscall_nr WHERE fam = 1 AND host_id = 1 AND pid = 9 AND ts_ns >= (SELECT max(ts_ns) FROM tel WHERE fam = 1 AND host_id = 1 AND pid = 9) - {10 * DAY * NS} GROUP BY 1", "tel"))
def r05(spark, sf_dir):
    return R.syscall_frequency(tel(spark, sf_dir), syscall_dim(spark), 1, 9, 10 * DAY)


@query("R06_top_syscalls", sql(f"SELECT {NAME_SQL} AS syscall_name, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM tel WHERE host_id = 3 AND pid = 7) LEFT JOIN {_names_sql()} ON nr = syscall_nr WHERE fam = 1 GROUP BY 1 ORDER BY n DESC, syscall_name LIMIT 15", "tel"))
def r06(spark, sf_dir):
    return R.top_syscalls(tel(spark, sf_dir), syscall_dim(spark), 3, 7)


@query("R07_family_breakdown", sql("SELECT CASE fam " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in C.FAMILY_NAMES.items()) + " END AS event_type, CAST(count(*) AS BIGINT) AS n FROM tel GROUP BY 1", "tel"))
def r07(spark, sf_dir):
    return R.family_breakdown(tel(spark, sf_dir))


@query("R08_recent_files", sql("SELECT event_id, ts_ns, operation, path FROM tel WHERE host_id = 3 AND pid = 7 AND fam = 3 ORDER BY ts_ns DESC, event_id DESC LIMIT 15", "tel"))
def r08(spark, sf_dir):
    return R.recent_files(tel(spark, sf_dir), 3, 7)


@query("R09_top_suspicious", sql("--MORE" + SUMMARY + "SELECT host_id, pid, comm, latest_score, latest_severity FROM summaries ORDER BY latest_score DESC, host_id, pid LIMIT 10", "feed"))
def r09(spark, sf_dir):
    return R.top_processes(summaries(spark, sf_dir)).select("host_id", "pid", "comm", "latest_score", "latest_severity")


@query("R10_overview", sql("SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT host_id, pid FROM tel)) AS BIGINT) AS processes, CAST((SELECT count(*) FROM alerts WHERE NOT acknowledged) AS BIGINT) AS unacknowledged, CAST((SELECT count(*) FROM fitted) AS BIGINT) AS models", "alerts", "fitted"))
def r10(spark, sf_dir):
    return R.overview(_plist(spark, sf_dir), alert_table(spark, sf_dir), baselines(spark, sf_dir))


@query("R11_max_severity", sql("--MORE" + SUMMARY + "SELECT arg_max(latest_severity, CASE latest_severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS max_severity FROM summaries", "feed"))
def r11(spark, sf_dir):
    return R.max_severity(summaries(spark, sf_dir))


@query("R12_score_matrix", sql("--MORE" + SUMMARY + "SELECT host_id, comm || ':' || pid AS label, latest_score FROM summaries", "feed"))
def r12(spark, sf_dir):
    return R.score_matrix(summaries(spark, sf_dir))


@query("R13_alerts_by_severity", sql("SELECT alert_id, severity, score FROM alerts WHERE severity = 'HIGH' ORDER BY created_unix DESC, alert_id DESC LIMIT 100", "alerts"))
def r13(spark, sf_dir):
    return R.alerts_of_severity(alert_table(spark, sf_dir), "HIGH").select("alert_id", "severity", "score")


@query("R14_recent_alerts", sql(f"SELECT alert_id, severity, process_name FROM alerts WHERE created_unix >= {NOW / 1e9} - 7 * 86400 AND severity = 'CRITICAL' ORDER BY created_unix DESC, alert_id DESC LIMIT 200", "alerts"))
def r14(spark, sf_dir):
    return R.recent_alerts(alert_table(spark, sf_dir), "7d", NOW / 1e9, "CRITICAL").select("alert_id", "severity", "process_name")


@query("R15_baseline_table", sql("SELECT host_id, comm AS process_name, round(threshold, 3) AS threshold, n_windows FROM fitted", "fitted"))
def r15(spark, sf_dir):
    return R.baseline_table(baselines(spark, sf_dir))


_METRICS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '# TYPE hostlens_{m} counter' AS type_line, 'hostlens_{m} ' || count(*) FILTER (WHERE outcome = '{o}') AS line FROM outcomes"
    for o, m in R.METRIC_NAMES.items()
)


@query("R16_metric_lines", sql(_METRICS, "outcomes", recursive=True))
def r16(spark, sf_dir):
    return R.metric_lines(outcomes(spark, sf_dir))


@query(
    "R17_explain_process",
    sql(
        f"SELECT host_id, pid, last_comm AS process_name, last_ns AS timestamp_ns, round(100 / (1 + exp(-(error - wm) / ws)), 5) AS final_score FROM (SELECT d.host_id, d.pid, last_comm, last_ns, avg(({NORM.format(v='v')} - {NORM.format(v='tm')}) * ({NORM.format(v='v')} - {NORM.format(v='tm')})) AS error "
        "FROM e_dense d JOIN e_sem m USING (host_id, pid) JOIN b_stats s ON s.host_id = d.host_id AND s.comm = last_comm AND s.idx = d.idx GROUP BY ALL) q JOIN fitted f ON f.host_id = q.host_id AND f.comm = last_comm",
        "e_dense", "e_sem", "fitted", "b_stats",
    ).replace("SELECT host_id, pid, last_comm AS process_name", "SELECT q.host_id, q.pid, last_comm AS process_name"),
)
def r17(spark, sf_dir):
    v = R.explain_process(tel(spark, sf_dir), baselines(spark, sf_dir), 3, 7, ST)
    return v.select("host_id", "pid", "process_name", "timestamp_ns", F.round("final_score", 5).alias("final_score"))


@query("R18_process_selector", sql("--MORE" + SUMMARY + "SELECT DISTINCT host_id, comm || ' (pid ' || pid || ')' AS label, pid AS value FROM plist", "feed"))
def r18(spark, sf_dir):
    return R.selector(_plist(spark, sf_dir))

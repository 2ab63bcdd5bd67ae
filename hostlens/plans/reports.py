"""Report queries over events, verdicts, alerts and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostlens import constants as C
from hostlens.config import NS, Settings
from hostlens.functions import scalars as X
from hostlens.operators import alerts as A
from hostlens.operators import features as FE
from hostlens.operators import scoring as S
from hostlens.operators.windows import Whole, trailing

PROCESS = ["host_id", "pid"]


def latest_scores(verdicts: DataFrame) -> DataFrame:
    """Newest score and severity of each process."""
    return (
        verdicts.groupBy(*PROCESS)
        .agg(F.max_by(F.struct("final_score", "severity"), "timestamp_ns").alias("_l"))
        .select(*PROCESS, F.col("_l.final_score").alias("latest_score"), F.col("_l.severity").alias("latest_severity"))
    )


def processes(events: DataFrame, settings: Settings) -> DataFrame:
    """Monitored processes with what is in their trailing window."""
    return trailing(events, PROCESS, settings).groupBy(*PROCESS).agg(
        F.max_by("comm", F.struct("ts_ns", "event_id")).alias("comm"),
        F.count("*").alias("event_count"),
        F.max("ts_ns").alias("last_seen_ns"),
    )


def process_summaries(process_list: DataFrame, verdicts: DataFrame) -> DataFrame:
    return process_list.join(latest_scores(verdicts), PROCESS, "left").withColumn(
        "latest_score", F.coalesce("latest_score", F.lit(0.0))
    ).withColumn("latest_severity", F.coalesce("latest_severity", F.lit("LOW")))


def score_history(verdicts: DataFrame, host_id: int, pid: int) -> DataFrame:
    return (
        verdicts.where((F.col("host_id") == host_id) & (F.col("pid") == pid))
        .select("timestamp_ns", F.col("final_score").alias("score"), "severity")
        .orderBy("timestamp_ns")
    )


def process_detail(process_list: DataFrame, verdicts: DataFrame, host_id: int, pid: int) -> DataFrame:
    """One row per point of the score history, with the summary of the process."""
    mine = (F.col("host_id") == host_id) & (F.col("pid") == pid)
    points = verdicts.where(mine).select(
        *PROCESS, "timestamp_ns", F.col("final_score").alias("score"), "severity"
    )
    return process_list.where(mine).join(points, PROCESS, "left").orderBy("timestamp_ns")


def last_events(events: DataFrame, n: int) -> DataFrame:
    """The newest n events, oldest first."""
    return events.orderBy(F.desc("ts_ns"), F.desc("event_id")).limit(n).orderBy("ts_ns", "event_id")


def event_feed(events: DataFrame, host_id: int, pid: int, detail: list[str], limit: int = 1000) -> DataFrame:
    """Newest events of a process with their remaining fields as a JSON map."""
    mine = events.where((F.col("host_id") == host_id) & (F.col("pid") == pid))
    return last_events(mine, limit).select(
        "event_id", F.col("ts_ns").alias("timestamp_ns"), F.col("fam").alias("event_type"), "pid", "comm",
        F.to_json(F.struct(*detail)).alias("detail"),
    )


def alert_page(alerts: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """A page of alerts; every row also carries the size of the page and the
    number of unacknowledged alerts overall."""
    page = A.list_alerts(alerts, limit=limit, offset=offset, **filters)
    return page.withColumn("total", page.agg(F.count("*")).scalar()).withColumn(
        "unacknowledged", A.unacknowledged(alerts).scalar()
    )


def syscall_frequency(events: DataFrame, dim: DataFrame, host_id: int, pid: int, seconds: int = 60) -> DataFrame:
    """Calls by name in the last seconds before the newest call of the process."""
    mine = events.where((F.col("host_id") == host_id) & (F.col("pid") == pid) & (F.col("fam") == C.SYSCALL))
    newest = mine.agg(F.max("ts_ns")).scalar()
    recent = mine.where(F.col("ts_ns") >= newest - seconds * NS)
    return named_calls(recent, dim).groupBy("syscall_name").agg(F.count("*").alias("n"))


def named_calls(calls: DataFrame, dim: DataFrame) -> DataFrame:
    from hostlens.operators.derive import with_syscall_names

    return with_syscall_names(calls, dim)


def top_syscalls(events: DataFrame, dim: DataFrame, host_id: int, pid: int, k: int = 15) -> DataFrame:
    """Most frequent calls of a process, over all events given."""
    calls = events.where((F.col("host_id") == host_id) & (F.col("pid") == pid) & (F.col("fam") == C.SYSCALL))
    return (
        named_calls(calls, dim).groupBy("syscall_name").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "syscall_name").limit(k)
    )


def family_breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy("fam").agg(F.count("*").alias("n")).select(
        X.family_name(F.col("fam")).alias("event_type"), "n"
    )


def recent_files(events: DataFrame, host_id: int, pid: int, k: int = 15) -> DataFrame:
    """The last k file operations of a process, over all events given."""
    files = events.where((F.col("host_id") == host_id) & (F.col("pid") == pid) & (F.col("fam") == C.FILE))
    return last_events(files, k).select("event_id", "ts_ns", "operation", "path")


def top_processes(summaries: DataFrame, k: int = 10) -> DataFrame:
    return summaries.orderBy(F.desc("latest_score"), *PROCESS).limit(k)


def process_label() -> Column:
    return F.concat(F.col("comm"), F.lit(":"), F.col("pid").cast("string"))


def selector_label() -> Column:
    return F.concat(F.col("comm"), F.lit(" (pid "), F.col("pid").cast("string"), F.lit(")"))


def score_matrix(summaries: DataFrame) -> DataFrame:
    return summaries.select("host_id", process_label().alias("label"), "latest_score")


def selector(process_list: DataFrame) -> DataFrame:
    return process_list.select("host_id", selector_label().alias("label"), F.col("pid").alias("value")).distinct()


def overview(process_list: DataFrame, alerts: DataFrame, baselines: DataFrame) -> DataFrame:
    """Three counters in one row."""
    return (
        process_list.agg(F.count("*").alias("processes"))
        .withColumn("unacknowledged", A.unacknowledged(alerts).scalar())
        .withColumn("models", baselines.agg(F.count("*")).scalar())
    )


def max_severity(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.coalesce(F.max_by("latest_severity", X.severity_rank(F.col("latest_severity"))), F.lit("LOW")).alias("max_severity")
    )


def alerts_of_severity(alerts: DataFrame, severity: str, newest: int = 100) -> DataFrame:
    """The newest alerts of one severity."""
    return A.list_alerts(alerts, severity=None if severity == "ALL" else severity, limit=newest)


def recent_alerts(alerts: DataFrame, duration: str, now_unix: float, severity: str | None = None, limit: int = 200) -> DataFrame:
    """Alerts of the last ``30m``, ``1h``, ``7d``..."""
    since = F.lit(now_unix) - X.duration_seconds(F.lit(duration))
    return A.list_alerts(alerts.where(F.col("created_unix") >= since), severity=severity, limit=limit)


def baseline_table(baselines: DataFrame) -> DataFrame:
    return baselines.select(
        "host_id", F.col("comm").alias("process_name"), F.round("threshold", 3).alias("threshold"), "n_windows"
    )


METRIC_NAMES = {
    "sent": "alerts_sent",
    "suppressed": "alerts_suppressed",
    "deduped": "alerts_deduplicated",
    "rate_limited": "alerts_rate_limited",
    "below_threshold": "scores_below_threshold",
}


def metric_lines(outcomes: DataFrame, prefix: str = "hostlens") -> DataFrame:
    """Funnel counters as text lines ``name value``; absent outcomes are 0."""
    counts = outcomes.agg(
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in METRIC_NAMES.items()]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in METRIC_NAMES.values()]
    )
    return counts.select(F.inline(rows)).select(
        "metric",
        F.format_string("# TYPE %s_%s counter", F.lit(prefix), F.col("metric")).alias("type_line"),
        F.format_string("%s_%s %d", F.lit(prefix), F.col("metric"), F.col("value")).alias("line"),
    )


def detection_matrix(vectors: DataFrame, keys: list[str]) -> DataFrame:
    return S.detections(vectors, keys)


def explain_process(events: DataFrame, baselines: DataFrame, host_id: int, pid: int, settings: Settings) -> DataFrame:
    """Verdict and explanation of one process over all its stored events."""
    mine = events.where((F.col("host_id") == host_id) & (F.col("pid") == pid))
    window = FE.vectors(mine, Whole(PROCESS), PROCESS, settings).withColumn("tick", F.lit(0))
    return S.score_windows(window, baselines, settings, PROCESS, "tick").drop("tick")

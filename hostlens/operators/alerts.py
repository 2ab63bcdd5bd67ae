"""Alert rows, their table, and the messages made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostlens.functions import scalars as X

SOURCE_NAME = "hostlens"


def build_alerts(verdicts: DataFrame, alert_id: Column | None = None) -> DataFrame:
    """Alerts from verdicts; the id only depends on the verdict, so a repeated
    run gives the same alerts."""
    ident = alert_id if alert_id is not None else F.xxhash64("host_id", "process_name", "pid", "timestamp_ns")
    return verdicts.select(
        ident.alias("alert_id"),
        "host_id",
        "process_name",
        "pid",
        F.col("final_score").alias("score"),
        "severity",
        "explanation",
        "timestamp_ns",
        F.lit(False).alias("acknowledged"),
        F.lit("").alias("ack_note"),
        (F.col("timestamp_ns") / F.lit(1e9)).alias("created_unix"),
    )


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").parquet(path)


def list_alerts(
    alerts: DataFrame,
    severity: str | None = None,
    process_name: str | None = None,
    from_unix: float | None = None,
    to_unix: float | None = None,
    acknowledged: bool | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Newest first, with every filter that is given."""
    filters = [
        (severity, lambda v: F.col("severity") == v),
        (process_name, lambda v: F.col("process_name") == v),
        (from_unix, lambda v: F.col("created_unix") >= v),
        (to_unix, lambda v: F.col("created_unix") <= v),
        (acknowledged, lambda v: F.col("acknowledged") == v),
    ]
    for value, cond in filters:
        if value is not None:
            alerts = alerts.where(cond(value))
    page = alerts.orderBy(F.desc("created_unix"), F.desc("alert_id"))
    return (page.offset(offset) if offset else page).limit(limit)


def get_alert(alerts: DataFrame, alert_id: int) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def acknowledge(alerts: DataFrame, acks: DataFrame, order: str | None = None) -> DataFrame:
    """``acks(alert_id, note)``: the last note by ``order`` counts (without it, the
    largest); an acknowledgement without a note keeps the note there is."""
    last = F.max_by(F.struct("note"), F.col(order)) if order else F.max(F.struct("note"))
    notes = acks.groupBy("alert_id").agg(last.alias("_ack"))
    return (
        alerts.join(notes, "alert_id", "left")
        .withColumn("acknowledged", F.col("acknowledged") | F.col("_ack").isNotNull())
        .withColumn("ack_note", F.coalesce("_ack.note", "ack_note"))
        .drop("_ack")
    )


def acknowledged_ids(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """The acknowledgements that met an alert."""
    return acks.join(alerts.select("alert_id"), "alert_id", "left_semi")


def unacknowledged(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("acknowledged")).alias("unacknowledged"))


# --- delivery -------------------------------------------------------------------------

CHANNEL_SCHEMA = "position int, type string, url string, enabled boolean, to_addrs array<string>"


def enabled_channels(configured: DataFrame, fallback_url: str | None = None) -> DataFrame:
    """Webhooks with an address of their own or the fallback one, syslog unless
    it is switched off, and every mail channel."""
    url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.lit(fallback_url or ""), F.lit("")))
    usable = (
        F.when(F.col("type") == "webhook", url.isNotNull())
        .when(F.col("type") == "syslog", F.coalesce("enabled", F.lit(True)))
        .when(F.col("type") == "email", True)
        .otherwise(False)
    )
    return configured.withColumn("url", url).where(usable)


def webhook_payload() -> Column:
    return F.to_json(
        F.struct(
            F.lit(SOURCE_NAME).alias("source"), "process_name", "pid", "score", "severity",
            "explanation", "timestamp_ns",
        )
    )


def syslog_line() -> Column:
    return F.format_string(
        "%s alert: %s (pid %d) score=%s - %s",
        F.col("severity"), F.col("process_name"), F.col("pid"), X.fixed_text(F.col("score"), 1), F.col("explanation"),
    )


def mail_subject() -> Column:
    return F.format_string(
        f"[{SOURCE_NAME} %s] %s (pid %d) score %s",
        F.col("severity"), F.col("process_name"), F.col("pid"), X.fixed_text(F.col("score"), 0),
    )


def mail_body() -> Column:
    return F.format_string(
        "Process : %s (pid %d)\nSeverity: %s\nScore   : %s/100\nReason  : %s\n",
        F.col("process_name"), F.col("pid"), F.col("severity"), X.fixed_text(F.col("score"), 1), F.col("explanation"),
    )


def alert_json() -> Column:
    return F.to_json(
        F.struct(
            "alert_id", "process_name", "pid", "score", "severity", "explanation", "timestamp_ns",
            "acknowledged", "created_unix",
        )
    )


def outbox(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per alert and channel: what to deliver, or why it cannot be.

    All channels become one array inside the plan, which stands next to each
    alert, so the alerts are neither shuffled nor joined.
    """
    configured = channels.agg(
        F.array_sort(F.collect_list(F.struct("position", "type", "url", F.col("to_addrs").isNotNull() & (F.size("to_addrs") > 0))))
        .cast("array<struct<position:int,type:string,url:string,mails:boolean>>").alias("channels")
    ).scalar()
    kind, missing_url = F.col("_c.type"), F.coalesce(F.col("_c.url"), F.lit("")) == ""
    problem = (
        F.when((kind == "webhook") & missing_url, "no webhook url configured")
        .when((kind == "email") & ~F.coalesce(F.col("_c.mails"), F.lit(False)), "no recipients configured")
        .otherwise("")
    )
    body = F.when(kind == "webhook", webhook_payload()).when(kind == "syslog", syslog_line()).when(kind == "email", mail_body())
    return alerts.withColumn("_c", F.explode(configured)).select(
        "alert_id", "host_id", "_c.position", kind.alias("channel"),
        F.when(kind == "email", mail_subject()).otherwise("").alias("subject"),
        F.coalesce(body, F.lit("")).alias("body"), (problem == "").alias("deliverable"), problem.alias("detail"),
    )


def default_channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(1, "webhook", "", None, None), (2, "syslog", None, True, None)], CHANNEL_SCHEMA
    )

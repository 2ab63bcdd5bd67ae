"""Alert funnel, alert table, rules, channels and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.catalog.common import DAY, NS, ST, T0, alert_table, cte, query, sql, stored, table, tel, verdict_feed
from hostlens.catalog.decoding import NOW_TS
from hostlens.catalog.scans import rules
from hostlens.operators import alerts as A
from hostlens.operators import funnel as FN
from hostlens.sources import store as S

_OUT = (
    f"CASE WHEN len(list_filter(w.sent, lambda x: x.p = s.process_name AND s.timestamp_ns - x.t < {DAY // 4 * NS})) > 0 THEN 'deduped' "
    f"WHEN len(list_filter(w.sent, lambda x: x.t >= s.timestamp_ns - {DAY * NS})) >= 10 THEN 'rate_limited' ELSE 'sent' END"
)


def funnel_ctes(source: str, key: str, pre: str = "") -> None:
    """The funnel over the common table ``source``, whose rows ``key`` tells apart."""
    staged, surv, walk = f"{pre}staged", f"{pre}surv", f"{pre}walk"
    cte(
        staged,
        f"SELECT f.*, CASE WHEN final_score < 70 THEN 'below_threshold' WHEN coalesce(final_score < max_score_suppress, false) THEN 'suppressed' END AS first_outcome "
        f"FROM {source} f LEFT JOIN (SELECT * FROM rules WHERE expires_at IS NULL OR {NOW_TS} < expires_at) r USING (process_name)",
        source, "rules",
    )
    cte(surv, f"SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY timestamp_ns, process_name, pid) AS rn FROM {staged} WHERE first_outcome IS NULL", staged)
    cte(
        walk,
        f"SELECT host_id, rn, {key}, 'sent' AS outcome, [{{'p': process_name, 't': timestamp_ns}}] AS sent FROM {surv} WHERE rn = 1 UNION ALL "
        f"SELECT host_id, rn, {key}, outcome, CASE WHEN outcome = 'sent' THEN list_append(list_filter(sent, lambda x: x.t >= timestamp_ns - {DAY * NS}), {{'p': process_name, 't': timestamp_ns}}) ELSE sent END "
        f"FROM (SELECT s.host_id, s.rn, s.{key}, s.process_name, s.timestamp_ns, w.sent, {_OUT} AS outcome FROM {walk} w JOIN {surv} s ON s.host_id = w.host_id AND s.rn = w.rn + 1)",
        surv,
    )
    cte(
        f"{pre}outcomes",
        f"SELECT s.* EXCLUDE (first_outcome), coalesce(first_outcome, outcome) AS outcome FROM {staged} s LEFT JOIN {walk} w USING ({key})", staged, walk,
    )


funnel_ctes("feed", "event_id")


def outcomes(spark, sf_dir):
    return stored(
        spark, sf_dir, "outcomes",
        lambda: FN.run_funnel(verdict_feed(spark, sf_dir), rules(spark, sf_dir), F.expr(NOW_TS), ["event_id"], ST),
    )


def _outcome(name, kinds):
    listed = ", ".join(f"'{k}'" for k in kinds)

    @query(name, sql(f"SELECT event_id, outcome FROM outcomes WHERE outcome IN ({listed})", "outcomes", recursive=True))
    def run(spark, sf_dir):
        return outcomes(spark, sf_dir).where(F.col("outcome").isin(*kinds)).select("event_id", "outcome")


_outcome("A01_below_threshold", ["below_threshold"])
_outcome("A02_suppressed", ["suppressed"])
_outcome("A03_deduplicated", ["deduped"])
_outcome("A04_rate_limited", ["rate_limited"])


@query("A07_alert_funnel", sql("SELECT event_id, host_id, process_name, outcome FROM outcomes", "outcomes", recursive=True))
def a07(spark, sf_dir):
    out = FN.run_funnel(verdict_feed(spark, sf_dir), rules(spark, sf_dir), F.expr(NOW_TS), ["event_id"], ST)
    return out.select("event_id", "host_id", "process_name", "outcome")


@query("A06_funnel_counters", sql("SELECT host_id, outcome, CAST(count(*) AS BIGINT) AS n FROM outcomes GROUP BY 1, 2", "outcomes", recursive=True))
def a06(spark, sf_dir):
    return FN.outcome_counts(outcomes(spark, sf_dir))


@query("A05_build_alerts", sql("SELECT event_id AS alert_id, process_name, pid, final_score AS score, severity, explanation, timestamp_ns, false AS acknowledged, timestamp_ns / 1e9 AS created_unix FROM outcomes WHERE outcome = 'sent'", "outcomes", recursive=True))
def a05(spark, sf_dir):
    sent = outcomes(spark, sf_dir).where("outcome = 'sent'")
    return A.build_alerts(sent, F.col("event_id")).drop("host_id", "ack_note")


CONFIGURED = (
    "SELECT s_suppkey AS position, CASE s_suppkey % 4 WHEN 0 THEN 'webhook' WHEN 1 THEN 'syslog' WHEN 2 THEN 'email' ELSE 'pager' END AS type, "
    "CASE WHEN s_nationkey % 2 = 0 THEN 'http://hook/' || s_nationkey ELSE '' END AS url, CASE WHEN s_nationkey % 3 < 2 THEN s_nationkey % 3 = 0 END AS enabled FROM supplier"
)


def configured_channels(spark, sf_dir):
    """One channel per supplier: webhooks, syslog, mail and unknown ones."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("webhook", "syslog", "email", "pager")]), (F.pmod(key, F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        key.alias("position"), kind.alias("type"),
        F.when(F.pmod(nation, F.lit(2)) == 0, F.concat(F.lit("http://hook/"), nation.cast("string"))).otherwise("").alias("url"),
        F.when(F.pmod(nation, F.lit(3)) < 2, F.pmod(nation, F.lit(3)) == 0).alias("enabled"),
    )


@query("A08_enabled_channels", f"SELECT CAST(position AS BIGINT) AS position, type, coalesce(nullif(url, ''), 'http://fallback') AS url FROM ({CONFIGURED}) WHERE type = 'webhook' OR type = 'email' OR (type = 'syslog' AND coalesce(enabled, true))")
def a08(spark, sf_dir):
    used = A.enabled_channels(configured_channels(spark, sf_dir), "http://fallback")
    return used.select(F.col("position").cast("bigint"), "type", "url")


@query("A08b_channels_without_fallback", f"SELECT CAST(position AS BIGINT) AS position, type FROM ({CONFIGURED}) WHERE (type = 'webhook' AND url <> '') OR type = 'email' OR (type = 'syslog' AND coalesce(enabled, true))")
def a08b(spark, sf_dir):
    return A.enabled_channels(configured_channels(spark, sf_dir)).select(F.col("position").cast("bigint"), "type")


JSON_HEAD = "'\"process_name\":\"' || process_name || '\",\"pid\":' || pid || ',\"score\":' || CAST(score AS VARCHAR) || ',\"severity\":\"' || severity || '\",\"explanation\":\"' || explanation || '\",\"timestamp_ns\":' || timestamp_ns"


@query("A09_webhook_payload", sql("SELECT alert_id, '{\"source\":\"hostlens\",' || " + JSON_HEAD + " || '}' AS payload FROM alerts", "alerts"))
def a09(spark, sf_dir):
    return alert_table(spark, sf_dir).select("alert_id", A.webhook_payload().alias("payload"))


SYSLOG = "printf('%s alert: %s (pid %d) score=%.1f - %s', severity, process_name, pid, score, explanation)"


@query("A10_syslog_line", sql(f"SELECT alert_id, {SYSLOG} AS line FROM alerts", "alerts"))
def a10(spark, sf_dir):
    return alert_table(spark, sf_dir).select("alert_id", A.syslog_line().alias("line"))


@query("A11_mail", sql("SELECT alert_id, printf('[hostlens %s] %s (pid %d) score %.0f', severity, process_name, pid, score) AS subject, printf('Process : %s (pid %d)\nSeverity: %s\nScore   : %.1f/100\nReason  : %s\n', process_name, pid, severity, score, explanation) AS body FROM alerts", "alerts"))
def a11(spark, sf_dir):
    return alert_table(spark, sf_dir).select("alert_id", A.mail_subject().alias("subject"), A.mail_body().alias("body"))


def channels(spark):
    return spark.createDataFrame(
        [(1, "webhook", "http://hook/1", None, None), (2, "syslog", None, True, None), (3, "email", None, None, []), (4, "webhook", "", None, None)],
        A.CHANNEL_SCHEMA,
    )


@query(
    "A12_delivery_results",
    sql("SELECT alert_id, position, channel, deliverable, detail FROM alerts CROSS JOIN (VALUES (1, 'webhook', true, ''), (2, 'syslog', true, ''), (3, 'email', false, 'no recipients configured'), (4, 'webhook', false, 'no webhook url configured')) c(position, channel, deliverable, detail)", "alerts"),
)
def a12(spark, sf_dir):
    return A.outbox(alert_table(spark, sf_dir), channels(spark)).select("alert_id", "position", "channel", "deliverable", "detail")


@query("J09_outbox", sql(f"SELECT alert_id, channel, CASE channel WHEN 'syslog' THEN {SYSLOG} ELSE '{{\"source\":\"hostlens\",' || {JSON_HEAD} || '}}' END AS body FROM alerts CROSS JOIN (VALUES ('webhook'), ('syslog')) c(channel)", "alerts"))
def j09(spark, sf_dir):
    enabled = A.enabled_channels(channels(spark)).where("type <> 'email'")
    return A.outbox(alert_table(spark, sf_dir), enabled).select("alert_id", "channel", "body")


RULE_COLS = "process_name, reason, max_score_suppress, expires_at, created_by"


def _added(spark, sf_dir):
    """A new rule per program of host 3, some with a ceiling that is not allowed."""
    t = tel(spark, sf_dir).where("host_id = 3").groupBy("comm").agg(F.count("*").alias("n"))
    return t.select(
        F.col("comm").alias("process_name"), F.lit("added").alias("reason"),
        (F.pmod("n", F.lit(150)) - 10).cast("double").alias("max_score_suppress"),
        F.lit(None).cast("timestamp").alias("expires_at"), F.lit("user").alias("created_by"),
    )


cte("added", "SELECT comm AS process_name, 'added' AS reason, CAST(count(*) % 150 - 10 AS DOUBLE) AS max_score_suppress, CAST(NULL AS TIMESTAMP) AS expires_at, 'user' AS created_by FROM tel WHERE host_id = 3 GROUP BY 1", "tel")


@query("A13_upsert_rules", sql(f"--MORE ok AS (SELECT * FROM added WHERE max_score_suppress BETWEEN 0 AND 100) SELECT {RULE_COLS} FROM rules ANTI JOIN ok USING (process_name) UNION ALL SELECT {RULE_COLS} FROM ok", "rules", "added"))
def a13(spark, sf_dir):
    return S.upsert_rule(rules(spark, sf_dir), _added(spark, sf_dir))


@query("A13b_remove_rule", sql(f"SELECT {RULE_COLS} FROM rules WHERE process_name <> 'nginx'", "rules"))
def a13b(spark, sf_dir):
    return S.remove_rule(rules(spark, sf_dir), "nginx")


@query("A14_clear_expired", sql(f"SELECT {RULE_COLS} FROM rules WHERE expires_at IS NULL OR {NOW_TS} < expires_at", "rules"))
def a14(spark, sf_dir):
    return S.clear_expired(rules(spark, sf_dir), F.expr(NOW_TS))


@query("A14b_expired_count", sql(f"SELECT CAST(count(*) AS BIGINT) AS expired FROM rules WHERE NOT (expires_at IS NULL OR {NOW_TS} < expires_at)", "rules"))
def a14b(spark, sf_dir):
    return S.expired_rules(rules(spark, sf_dir), F.expr(NOW_TS))


@query("A15_alert_json", sql("SELECT alert_id, '{\"alert_id\":' || alert_id || ',' || " + JSON_HEAD + " || ',\"acknowledged\":' || acknowledged || '}' AS json FROM alerts", "alerts"))
def a15(spark, sf_dir):
    """The created time is left out of the comparison: engines print doubles differently."""
    cut = F.regexp_replace(A.alert_json(), ',"created_unix":[^}]*', "")
    return alert_table(spark, sf_dir).select("alert_id", cut.alias("json"))


@query("A16_list_alerts", sql(f"SELECT alert_id, process_name, severity, created_unix FROM alerts WHERE severity = 'HIGH' AND created_unix >= {(T0 + 3 * DAY * NS) / 1e9} ORDER BY created_unix DESC, alert_id DESC LIMIT 100 OFFSET 20", "alerts"))
def a16(spark, sf_dir):
    page = A.list_alerts(alert_table(spark, sf_dir), severity="HIGH", from_unix=(T0 + 3 * DAY * NS) / 1e9, limit=100, offset=20)
    return page.select("alert_id", "process_name", "severity", "created_unix")


@query("A17_get_alert", sql("SELECT alert_id, process_name, score FROM alerts WHERE alert_id = (SELECT max(alert_id) FROM alerts)", "alerts"))
def a17(spark, sf_dir):
    alerts = alert_table(spark, sf_dir)
    newest = alerts.agg(F.max("alert_id")).scalar()
    return A.get_alert(alerts, newest).select("alert_id", "process_name", "score")


@query("A18_acknowledge", sql("SELECT alert_id, true AS acknowledged, 'ok' AS ack_note FROM alerts WHERE score >= 95", "alerts"))
def a18(spark, sf_dir):
    alerts = alert_table(spark, sf_dir)
    acks = alerts.where("score >= 95").select("alert_id", F.lit("ok").alias("note"))
    return A.acknowledge(alerts, acks).where("ack_note = 'ok'").select("alert_id", "acknowledged", "ack_note")


@query("A19_unacknowledged", sql("SELECT CAST(count(*) AS BIGINT) AS unacknowledged FROM alerts WHERE NOT acknowledged", "alerts"))
def a19(spark, sf_dir):
    return A.unacknowledged(alert_table(spark, sf_dir))

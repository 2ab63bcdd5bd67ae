"""From events to messages: scoring, funnel, alerts and outbox in one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.catalog.alerting import channels, funnel_ctes
from hostlens.catalog.common import ST, cte, query, sql
from hostlens.catalog.decoding import NOW_TS
from hostlens.catalog.scans import rules
from hostlens.catalog.scoring import verdicts
from hostlens.operators import alerts as A
from hostlens.operators import funnel as FN

cte(
    "scored_feed",
    "SELECT host_id, pid, tick, host_id || '/' || pid || '/' || tick AS verdict_id, comm AS process_name, coalesce(last_ns, 0) AS timestamp_ns, final_score FROM v_all",
    "v_all",
)
funnel_ctes("scored_feed", "verdict_id", "scored_")


@query(
    "A20_events_to_outbox",
    sql(
        "SELECT host_id, process_name, pid, timestamp_ns, position, channel, deliverable, detail FROM scored_outcomes CROSS JOIN "
        "(VALUES (1, 'webhook', true, ''), (2, 'syslog', true, ''), (3, 'email', false, 'no recipients configured'), (4, 'webhook', false, 'no webhook url configured')) "
        "c(position, channel, deliverable, detail) WHERE outcome = 'sent'", "scored_outcomes", recursive=True,
    ),
)
def a20(spark, sf_dir):
    """Events are scored, verdicts pass the funnel, alerts are made and prepared for delivery."""
    scored = verdicts(spark, sf_dir).select("host_id", "pid", "tick", "process_name", "timestamp_ns", "final_score", "severity", "explanation")
    passed = FN.run_funnel(scored, rules(spark, sf_dir), F.expr(NOW_TS), ["host_id", "pid", "tick"], ST)
    alerts = A.build_alerts(passed.where("outcome = 'sent'"))
    sent = A.outbox(alerts, channels(spark)).join(alerts.select("alert_id", "process_name", "pid", "timestamp_ns"), "alert_id")
    return sent.select("host_id", "process_name", "pid", "timestamp_ns", "position", "channel", "deliverable", "detail")

"""Pairing, lookups, semi and anti joins, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import constants as C
from hostlens.catalog.common import (
    DAY, NOW, NS, PROC, ST, TICK, W, alert_table, query, sql, stored, table, tel, verdict_feed,
)
from hostlens.catalog.decoding import NAME_SQL, NOW_TS, _names_sql
from hostlens.catalog.scans import rules
from hostlens.functions.dims import feature_dim, feature_names, phrase, salience, syscall_dim, syscall_names
from hostlens.operators import alerts as A
from hostlens.operators import baseline as B
from hostlens.operators import derive as D
from hostlens.operators import features as FE
from hostlens.operators import funnel
from hostlens.operators import scoring
from hostlens.operators import windows as Wd
from hostlens.plans import reports as R


def half_calls(spark, sf_dir, family):
    """Entry and exit records of the calls of one family."""
    return tel(spark, sf_dir).where(F.col("fam") == family).select(
        "event_id", "host_id", "pid", "ts_ns", "syscall_nr", "dst_ip",
        F.when(F.pmod("event_id", F.lit(3)) == 0, "exit").otherwise("enter").alias("kind"),
        (-F.pmod("k", F.lit(4))).cast("bigint").alias("ret"),
    )


PAIRS = (
    "half AS (SELECT event_id, host_id, pid, ts_ns, syscall_nr, dst_ip, CASE WHEN event_id % 3 = 0 THEN 'exit' ELSE 'enter' END AS kind, CAST(-(k % 4) AS BIGINT) AS ret FROM tel WHERE fam = {f}), "
    "linked AS (SELECT *, lead(kind) OVER w AS nk, lead(event_id) OVER w AS exit_id, lead(ts_ns) OVER w AS exit_ns, lead(ret) OVER w AS nret FROM half WINDOW w AS (PARTITION BY host_id, pid ORDER BY ts_ns, event_id)) "
)


@query("J01_enter_exit", sql("--MORE" + PAIRS.format(f=1) + "SELECT host_id, pid, event_id AS enter_id, exit_id, ts_ns AS enter_ns, exit_ns, syscall_nr, nret AS ret FROM linked WHERE kind = 'enter' AND nk = 'exit'", "tel"))
def j01(spark, sf_dir):
    return D.enter_exit(half_calls(spark, sf_dir, C.SYSCALL), PROC, ["syscall_nr"], ["ret"], ST)


@query("J02_connect_return", sql("--MORE" + PAIRS.format(f=2) + "SELECT host_id, pid, event_id AS enter_id, exit_id, ts_ns AS enter_ns, exit_ns, dst_ip, nret AS ret FROM linked WHERE kind = 'enter' AND nk = 'exit' AND nret = 0", "tel"))
def j02(spark, sf_dir):
    return D.succeeded(D.enter_exit(half_calls(spark, sf_dir, C.NETWORK), PROC, ["dst_ip"], ["ret"], ST))


@query("J03_baseline_lookup", sql("SELECT event_id, f.host_id, b.n_windows, b.n_windows IS NOT NULL AS model_available FROM feed f LEFT JOIN (SELECT host_id, comm, CAST(count(*) AS BIGINT) AS n_windows FROM tel WHERE comm <> 'sshd' GROUP BY 1, 2) b ON f.host_id = b.host_id AND f.process_name = b.comm", "feed"))
def j03(spark, sf_dir):
    from hostlens.operators.skew import attach_per_key

    known = tel(spark, sf_dir).where("comm <> 'sshd'").groupBy("host_id", "comm").agg(F.count("*").alias("n_windows"))
    feed = verdict_feed(spark, sf_dir).withColumn("comm", F.col("process_name"))
    return attach_per_key(feed, known, ["host_id", "comm"], "n_windows", ["event_id"], ST).select(
        "event_id", "host_id", "n_windows", F.col("n_windows").isNotNull().alias("model_available")
    )


@query("J04_suppression_rules", sql(f"SELECT event_id, coalesce(final_score < max_score_suppress, false) AS is_suppressed FROM feed f LEFT JOIN (SELECT * FROM rules WHERE expires_at IS NULL OR {NOW_TS} < expires_at) r USING (process_name)", "feed", "rules"))
def j04(spark, sf_dir):
    return funnel.suppressed_by_rule(verdict_feed(spark, sf_dir), rules(spark, sf_dir), F.expr(NOW_TS)).select("event_id", "is_suppressed")


def safe_pids(spark, sf_dir):
    return tel(spark, sf_dir).where("pid % 13 = 0").select("host_id", "pid").distinct()


@query("J05_safe_pids", sql("SELECT event_id, pid % 13 = 0 AS is_safe FROM feed", "feed"))
def j05(spark, sf_dir):
    return scoring.flag_safe(verdict_feed(spark, sf_dir), safe_pids(spark, sf_dir)).select("event_id", "is_safe")


def process_vectors(spark, sf_dir):
    """Hopping-window vectors per process, stored."""

    def build():
        t = tel(spark, sf_dir)
        return FE.checked(FE.vectors(t, Wd.hopping(t, PROC, ST), PROC, ST))

    return stored(spark, sf_dir, "process-vectors", build)


def _dim_sql():
    names = syscall_names()
    rows = ", ".join(
        "({}, '{}', {}, '{}')".format(i, n, salience(n), phrase(n, names).replace("'", "''"))
        for i, n in enumerate(feature_names())
    )
    return f"(VALUES {rows}) AS d(idx, name, salience, phrase)"


RANKED = (
    "m AS (SELECT idx, avg(v) AS mean FROM p_dense GROUP BY 1), "
    "con AS (SELECT host_id, pid, k, x.idx, v AS value, abs(v - mean) * CAST(salience AS DOUBLE) AS contribution, name, phrase FROM p_dense x JOIN m USING (idx) JOIN "
    + _dim_sql() + " ON d.idx = x.idx), "
    "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY host_id, pid, k ORDER BY contribution DESC, idx) AS INT) AS rank FROM con WHERE contribution > 0) "
)


#: windows whose contributions are added up by one task
VECTORS_PER_TASK = 10_000


def _by_process(v):
    """The vectors of a process in one task, and few in each: what is added up per
    process then needs no shuffle of contributions, of which a vector has hundreds."""
    tasks = max(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-v.count() // VECTORS_PER_TASK))
    return v.repartition(tasks, *PROC)


def _against_mean(spark, sf_dir, dealt=lambda v: v):
    """Vectors next to the mean vector of the whole fleet."""
    v = process_vectors(spark, sf_dir)
    mean = (
        v.select(F.posexplode("features").alias("idx", "v")).groupBy("idx").agg(F.avg("v").alias("m"))
        .agg(F.sort_array(F.collect_list(F.struct("idx", "m"))).alias("s"))
    )
    return dealt(v).withColumn("norm_mean", mean.select("s.m").scalar())


@query("J06_contribution_zip", sql("--MORE" + RANKED + "SELECT host_id, pid, CAST(idx AS INT) AS idx, name, CAST(count(*) AS BIGINT) AS windows, round(sum(value), 6) AS value, round(sum(contribution), 6) AS contribution FROM ranked GROUP BY ALL", "p_dense"))
def j06(spark, sf_dir):
    rows = scoring.contribution_rows(_against_mean(spark, sf_dir, _by_process), [*PROC, "k"], feature_dim(spark))
    return rows.groupBy(*PROC, "idx", "name").agg(
        F.count("*").alias("windows"), F.round(F.sum("value"), 6).alias("value"), F.round(F.sum("contribution"), 6).alias("contribution")
    )


@query("T07_ranked_contributions", sql("--MORE" + RANKED + "SELECT host_id, pid, rank, CAST(count(*) AS BIGINT) AS windows, round(sum(contribution), 6) AS contribution FROM ranked GROUP BY ALL", "p_dense"))
def t07(spark, sf_dir):
    rows = scoring.contribution_rows(_against_mean(spark, sf_dir, _by_process), [*PROC, "k"], feature_dim(spark))
    return rows.groupBy(*PROC, "rank").agg(F.count("*").alias("windows"), F.round(F.sum("contribution"), 6).alias("contribution"))


@query("T08_notable_contributions", sql("--MORE" + RANKED + "SELECT host_id, pid, k, CAST(count(*) AS INT) AS notable FROM ranked WHERE contribution >= 0.05 AND rank <= 3 GROUP BY ALL", "p_dense"))
def t08(spark, sf_dir):
    rows = scoring.contribution_rows(_against_mean(spark, sf_dir), [*PROC, "k"], feature_dim(spark), C.MIN_CONTRIBUTION)
    notable = rows.where((F.col("contribution") >= C.MIN_CONTRIBUTION) & (F.col("rank") <= C.TOP_PHRASES))
    return notable.groupBy(*PROC, "k").agg(F.count("*").cast("int").alias("notable"))


@query("T09_top_features", sql("--MORE" + RANKED + "SELECT host_id, pid, k, rank, round(contribution, 4) AS contribution FROM ranked WHERE rank <= 5", "p_dense"))
def t09(spark, sf_dir):
    v = _against_mean(spark, sf_dir)
    ranked = scoring.top_ranked(F.col("w"), C.TOP_FEATURES)
    top = v.withColumn("w", scoring.contributions(F.col("features"), F.col("norm_mean"))).withColumn("r", ranked).select(*PROC, "k", F.posexplode(scoring.top_features(F.col("features"), F.col("r"))).alias("p", "f"))
    return top.select(*PROC, "k", (F.col("p") + 1).alias("rank"), F.col("f.contribution").alias("contribution"))


@query("J07_syscall_names", sql(f"SELECT event_id, {NAME_SQL} AS syscall_name FROM tel LEFT JOIN {_names_sql()} ON nr = syscall_nr WHERE fam = 1", "tel"))
def j07(spark, sf_dir):
    return D.with_syscall_names(tel(spark, sf_dir).where("fam = 1"), syscall_dim(spark)).select("event_id", "syscall_name")


def _active(spark, sf_dir):
    return Wd.alive_keys(tel(spark, sf_dir), PROC, NOW - DAY * NS, ST)


ALIVE = f"alive AS (SELECT DISTINCT host_id, pid FROM tel WHERE ts_ns >= {NOW - DAY * NS - W}), windows AS (SELECT host_id, pid, CAST(count(*) AS BIGINT) AS event_count FROM tel GROUP BY 1, 2) "


def _event_counts(spark, sf_dir):
    return tel(spark, sf_dir).groupBy(*PROC).agg(F.count("*").alias("event_count"))


@query("J08_drop_dead", sql("--MORE" + ALIVE + "SELECT * FROM windows SEMI JOIN alive USING (host_id, pid)", "tel"))
def j08(spark, sf_dir):
    return Wd.drop_dead(_event_counts(spark, sf_dir), _active(spark, sf_dir), PROC)


@query("U04_dead_windows", sql("--MORE" + ALIVE + "SELECT * FROM windows ANTI JOIN alive USING (host_id, pid)", "tel"))
def u04(spark, sf_dir):
    return Wd.dead(_event_counts(spark, sf_dir), _active(spark, sf_dir), PROC)


@query("U05_labelled_union", "SELECT doc_id, n_chars, CAST(toxic AS INTEGER) AS label FROM documents JOIN labels USING (doc_id)")
def u05(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "toxic")
    return B.label_union(docs.where("toxic = 0").drop("toxic"), docs.where("toxic = 1").drop("toxic"))


@query("J10_acknowledge", sql("SELECT alert_id, acknowledged OR alert_id % 5 = 0 AS acknowledged, CASE WHEN alert_id % 5 = 0 THEN 'seen by ' || pid ELSE ack_note END AS ack_note FROM alerts", "alerts"))
def j10(spark, sf_dir):
    alerts = alert_table(spark, sf_dir)
    return A.acknowledge(alerts, _acks(spark, sf_dir)).select("alert_id", "acknowledged", "ack_note")


def _acks(spark, sf_dir):
    """Acknowledgements for every fifth event, whether it became an alert or not."""
    return tel(spark, sf_dir).where("event_id % 5 = 0").select(
        F.col("event_id").alias("alert_id"), F.concat(F.lit("seen by "), F.col("pid").cast("string")).alias("note")
    )


@query("J10b_acknowledged_ids", sql("SELECT alert_id, 'seen by ' || pid AS note FROM alerts WHERE alert_id % 5 = 0", "alerts"))
def j10b(spark, sf_dir):
    return A.acknowledged_ids(alert_table(spark, sf_dir), _acks(spark, sf_dir))


@query("J11_tick_snapshots", sql("SELECT host_id, pid, tick, max(ts_ns) AS latest_ns, CAST(count(*) AS BIGINT) AS events, min(ts_ns) AS oldest_ns FROM tt_win GROUP BY ALL", "tt_win"))
def j11(spark, sf_dir):
    t = tel(spark, sf_dir)
    snap = Wd.snapshots(t, PROC, ST)
    return snap.assign(t.select(*PROC, "ts_ns", "event_id")).groupBy(*snap.keys).agg(
        F.max("ts_ns").alias("latest_ns"), F.count("*").alias("events"), F.min("ts_ns").alias("oldest_ns")
    )


LAST_TICK = NOW // TICK


@query(
    "J11b_idle_snapshots",
    sql(f"SELECT host_id, pid, CAST(unnest(range(tick, greatest(coalesce(lead(tick) OVER (PARTITION BY host_id, pid ORDER BY tick), {LAST_TICK + 1}), tick + 1))) AS BIGINT) AS tick, latest_ns FROM tt_latest", "tt_latest"),
)
def j11b(spark, sf_dir):
    snap = Wd.snapshots(tel(spark, sf_dir), PROC, ST)
    return Wd.repeat_idle(snap.latest, PROC, LAST_TICK).select(*PROC, "tick", "latest_ns")


SUMMARY = (
    f"lst AS (SELECT host_id, pid, max(ts_ns) AS latest_ns FROM tel GROUP BY 1, 2), "
    f"plist AS (SELECT t.host_id, t.pid, arg_max(comm, ts_ns) AS comm, CAST(count(*) AS BIGINT) AS event_count, max(ts_ns) AS last_seen_ns FROM tel t JOIN lst USING (host_id, pid) WHERE ts_ns >= latest_ns - {W} GROUP BY 1, 2), "
    "last_score AS (SELECT host_id, pid, arg_max(final_score, timestamp_ns) AS latest_score, arg_max(severity, timestamp_ns) AS latest_severity FROM feed WHERE model_available GROUP BY 1, 2), "
    "summaries AS (SELECT p.*, coalesce(latest_score, 0.0) AS latest_score, coalesce(latest_severity, 'LOW') AS latest_severity FROM plist p LEFT JOIN last_score USING (host_id, pid)) "
)


def summaries(spark, sf_dir):
    return R.process_summaries(R.processes(tel(spark, sf_dir), ST), verdict_feed(spark, sf_dir).where("model_available"))


@query("J12_process_summaries", sql("--MORE" + SUMMARY + "SELECT * FROM summaries", "feed"))
def j12(spark, sf_dir):
    return summaries(spark, sf_dir)



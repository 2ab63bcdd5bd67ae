"""Verdicts, severity, explanation, detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import constants as C
from hostlens.catalog.common import PROC, SEVERITY_SQL, ST, TRAIN_END, cte, query, sql, stored, tel, verdict_feed
from hostlens.catalog.fitting import NORM, baselines
from hostlens.catalog.joins import _dim_sql, process_vectors, safe_pids
from hostlens.functions import scalars as X
from hostlens.operators import features as FE
from hostlens.operators import scoring as SC
from hostlens.operators import windows as Wd
from hostlens.sources.store import delete_baseline

KEY = [*PROC, "tick"]


def scoring_vectors(spark, sf_dir):
    def build():
        t = tel(spark, sf_dir).where(F.col("ts_ns") >= TRAIN_END)
        return FE.checked(FE.vectors(t, Wd.snapshots(t, PROC, ST), PROC, ST))

    return stored(spark, sf_dir, "scoring-vectors", build)


def live_baselines(spark, sf_dir):
    """All baselines but that of one program, so that some windows have none."""
    return delete_baseline(baselines(spark, sf_dir), "node")


def verdicts(spark, sf_dir):
    return stored(
        spark, sf_dir, "verdicts",
        lambda: SC.score_windows(
            scoring_vectors(spark, sf_dir), live_baselines(spark, sf_dir), ST, PROC, "tick", safe_pids(spark, sf_dir)
        ),
    )


cte("v_key", "SELECT host_id, pid, tick, last_comm AS comm, last_ns FROM t_sem", "t_sem")
cte(
    "v_x",
    f"SELECT d.host_id, d.pid, d.tick, d.idx, d.v, mean, {NORM.format(v='d.v')} AS x, {NORM.format(v='tm')} AS c FROM t_dense d JOIN (SELECT * FROM v_key WHERE comm <> 'node') w USING (host_id, pid, tick) "
    "JOIN b_stats s ON s.host_id = d.host_id AND s.comm = w.comm AND s.idx = d.idx",
    "t_dense", "v_key", "b_stats",
)
cte("v_err", "SELECT host_id, pid, tick, avg((x - c) * (x - c)) AS error, avg((x - p) * (x - p)) AS step_error FROM (SELECT *, lag(x) OVER (PARTITION BY host_id, pid, idx ORDER BY tick) AS p FROM v_x) GROUP BY ALL", "v_x")
cte("v_seq", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY host_id, pid ORDER BY tick) >= 5 THEN avg(step_error) OVER (PARTITION BY host_id, pid ORDER BY tick ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS sequence_error FROM v_err", "v_err")
cte(
    "v_raw",
    "SELECT k.*, f.comm IS NOT NULL AS model_available, k.pid % 13 = 0 AS safe, f.threshold, e.error, CASE WHEN f.comm IS NULL THEN 0.0 ELSE 100 / (1 + exp(-(e.error - wm) / ws)) END AS vae_score, "
    "100 / (1 + exp(-(e.sequence_error - sm) / ss)) AS lstm_score FROM v_key k LEFT JOIN (SELECT * FROM fitted WHERE comm <> 'node') f ON f.host_id = k.host_id AND f.comm = k.comm LEFT JOIN v_seq e ON e.host_id = k.host_id AND e.pid = k.pid AND e.tick = k.tick",
    "v_key", "fitted", "v_seq",
)
cte(
    "v_all",
    "SELECT *, CASE WHEN NOT model_available OR safe THEN 0.0 WHEN lstm_score IS NULL THEN vae_score ELSE 0.6 * lstm_score + 0.4 * vae_score END AS final_score FROM v_raw",
    "v_raw",
)
SCORES = "round(final_score, 5) AS final_score, round(vae_score, 5) AS vae_score, round(lstm_score, 5) AS lstm_score"


def _scores(v):
    return [F.round(c, 5).alias(c) for c in ("final_score", "vae_score", "lstm_score")]


@query(
    "C14_verdicts",
    sql(f"SELECT host_id, pid, tick, comm AS process_name, last_ns AS timestamp_ns, {SCORES}, {SEVERITY_SQL.format(s='final_score')} AS severity, model_available, model_available AND safe AS suppressed FROM v_all", "v_all"),
)
def c14(spark, sf_dir):
    return verdicts(spark, sf_dir).select(*KEY, "process_name", "timestamp_ns", *_scores(None), "severity", "model_available", "suppressed")


@query("C01_weights", sql("SELECT event_id, CASE WHEN NOT s THEN 0.0::DOUBLE WHEN NOT w THEN 1.0 ELSE 0.6 END AS ws, CASE WHEN NOT s THEN 1.0::DOUBLE WHEN NOT w THEN 0.0 ELSE 0.4 END AS ww, 0.5::DOUBLE AS even FROM (SELECT event_id, event_id % 3 <> 0 AS s, event_id % 5 <> 0 AS w FROM events)"))
def c01(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    has_s, has_w = F.pmod("event_id", F.lit(3)) != 0, F.pmod("event_id", F.lit(5)) != 0
    ws, ww = SC.weights(has_s, has_w, ST)
    even, _ = SC.weights(F.lit(True), F.lit(True), ST.with_(sequence_weight=0.0, window_weight=0.0))
    return e.select("event_id", ws.alias("ws"), ww.alias("ww"), even.alias("even"))


def _two_scores(spark, sf_dir):
    """Two component scores per event; every fourth has no sequence yet."""
    t = tel(spark, sf_dir)
    return t.select(
        "event_id", F.col("k").cast("double").alias("w"),
        F.when(F.pmod("event_id", F.lit(4)) != 0, F.pmod("event_id", F.lit(101)).cast("double")).alias("s"),
    )


TWO = "SELECT event_id, CAST(k AS DOUBLE) AS w, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 101 AS DOUBLE) END AS s FROM tel"


@query("C02_fused_score", sql(f"SELECT event_id, round(CASE WHEN s IS NULL THEN w ELSE 0.6 * s + 0.4 * w END, 6) AS final_score FROM ({TWO})", "tel"))
def c02(spark, sf_dir):
    ws, ww = SC.weights(F.lit(True), F.lit(True), ST)
    return _two_scores(spark, sf_dir).select("event_id", F.round(SC.fuse(F.col("w"), F.col("s"), ws, ww), 6).alias("final_score"))


@query("C03_dominant", sql(f"SELECT event_id, CASE WHEN s IS NOT NULL AND 0.6::DOUBLE * s >= 0.4::DOUBLE * w THEN 'lstm' ELSE 'vae' END AS dominant FROM ({TWO})", "tel"))
def c03(spark, sf_dir):
    ws, ww = SC.weights(F.lit(True), F.lit(True), ST)
    return _two_scores(spark, sf_dir).select("event_id", SC.dominant(F.col("w"), F.col("s"), ws, ww).alias("dominant"))


@query("C04_no_baseline", sql("SELECT host_id, pid, tick, final_score, 'No trained baseline for ''' || comm || '''; cannot score yet.' AS explanation FROM v_all WHERE NOT model_available", "v_all"))
def c04(spark, sf_dir):
    return verdicts(spark, sf_dir).where("NOT model_available").select(*KEY, "final_score", "explanation")


@query("C05_normalized_vectors", sql("SELECT host_id, pid, tick, round(sum(x), 6) AS total FROM v_x GROUP BY ALL", "v_x"))
def c05(spark, sf_dir):
    from hostlens.operators import baseline as B

    v = scoring_vectors(spark, sf_dir).withColumn("comm", F.col("last_comm"))
    x = B.attach_stats(v, live_baselines(spark, sf_dir).select("host_id", "comm", "n_windows", "norm_min", "norm_max"), ["host_id", "comm"], KEY, ST)
    total = F.aggregate(B.normalized(), F.lit(0.0), lambda a, e: a + e)
    return x.where("norm_min IS NOT NULL").select(*KEY, F.round(total, 6).alias("total"))


@query("C06_safe_pids", sql("SELECT host_id, pid, tick, final_score, 'PID ' || pid || ' is on the known-safe list; alert suppressed.' AS explanation FROM v_all WHERE model_available AND safe", "v_all"))
def c06(spark, sf_dir):
    return verdicts(spark, sf_dir).where("suppressed").select(*KEY, "final_score", "explanation")


@query("C07_verdict_time", sql("SELECT host_id, pid, tick, coalesce(last_ns, 0) AS timestamp_ns FROM v_key", "v_key"))
def c07(spark, sf_dir):
    return verdicts(spark, sf_dir).select(*KEY, "timestamp_ns")


WILD = "(k * 3 - 60) + (event_id % 2) / 2.0"


@query("C08_severity", sql(f"SELECT event_id, {SEVERITY_SQL.format(s='(' + WILD + ')')} AS severity FROM tel", "tel"))
def c08(spark, sf_dir):
    return tel(spark, sf_dir).select("event_id", X.severity(F.expr(WILD), ST).alias("severity"))


@query("C09_severity_rank", sql("SELECT event_id, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS rank FROM feed", "feed"))
def c09(spark, sf_dir):
    return verdict_feed(spark, sf_dir).select("event_id", X.severity_rank(F.col("severity")).alias("rank"))


cte(
    "v_rank",
    "SELECT *, row_number() OVER (PARTITION BY host_id, pid, tick ORDER BY contribution DESC, idx) AS rank FROM (SELECT x.host_id, x.pid, x.tick, x.idx, x.v AS value, name, phrase, abs(x.v - mean) * CAST(salience AS DOUBLE) AS contribution "
    f"FROM v_x x JOIN {_dim_sql()} ON d.idx = x.idx) WHERE contribution > 0",
    "v_x",
)


@query("C10_contributions", sql("SELECT host_id, pid, tick, CAST(rank AS INT) AS rank, round(contribution, 6) AS contribution FROM v_rank WHERE rank <= 5", "v_rank"))
def c10(spark, sf_dir):
    from hostlens.operators import baseline as B

    v = scoring_vectors(spark, sf_dir).withColumn("comm", F.col("last_comm"))
    means = live_baselines(spark, sf_dir).select("host_id", "comm", "n_windows", "norm_mean")
    based = B.attach_stats(v, means, ["host_id", "comm"], KEY, ST).where("norm_mean IS NOT NULL")
    weighed = based.withColumn("w", SC.contributions(F.col("features"), F.col("norm_mean")))
    ranked = SC.top_ranked(F.col("w"), C.TOP_FEATURES)
    return weighed.select(*KEY, F.posexplode(ranked).alias("p", "r")).select(
        *KEY, (F.col("p") + 1).alias("rank"), F.round(-F.col("r.neg"), 6).alias("contribution")
    )


@query("C11_salience", sql(f"SELECT name, CAST(salience AS DOUBLE) AS salience, CAST(count(*) AS BIGINT) AS windows FROM p_vec p JOIN {_dim_sql()} ON d.idx = p.idx WHERE v > 0 GROUP BY ALL", "p_vec"))
def c11(spark, sf_dir):
    return _used(spark, sf_dir).select("name", "salience", "windows")


@query("C12_phrases", sql(f"SELECT name, phrase, CAST(count(*) AS BIGINT) AS windows FROM p_vec p JOIN {_dim_sql()} ON d.idx = p.idx WHERE v > 0 GROUP BY ALL", "p_vec"))
def c12(spark, sf_dir):
    return _used(spark, sf_dir).select("name", "phrase", "windows")


def _used(spark, sf_dir):
    from hostlens.functions.dims import feature_dim

    used = (
        process_vectors(spark, sf_dir).select(F.posexplode("features").alias("idx", "v")).where("v > 0")
        .groupBy("idx").agg(F.count("*").alias("windows"))
    )
    return used.join(F.broadcast(feature_dim(spark)), "idx")


@query(
    "C13_explanation",
    sql(
        "SELECT host_id, pid, tick, CASE len(cl) WHEN 0 THEN 'Process ' || comm || ' shows only mild deviations from its baseline.' WHEN 1 THEN 'Process ' || comm || ' ' || cl[1] || '.' "
        "WHEN 2 THEN 'Process ' || comm || ' ' || cl[1] || ' and ' || cl[2] || '.' ELSE 'Process ' || comm || ' ' || cl[1] || ', ' || cl[2] || ', and ' || cl[3] || '.' END AS explanation "
        "FROM (SELECT k.host_id, k.pid, k.tick, k.comm, coalesce(list(phrase || ' (' || name || '=' || printf('%.2f', value) || ')' ORDER BY rank) FILTER (WHERE contribution >= 0.05 AND rank <= 3), []) AS cl "
        "FROM v_all k LEFT JOIN v_rank r USING (host_id, pid, tick) WHERE model_available AND NOT safe GROUP BY ALL)", "v_all", "v_rank",
    ),
)
def c13(spark, sf_dir):
    return verdicts(spark, sf_dir).where("model_available AND NOT suppressed").select(*KEY, "explanation")


@query("C15_over_threshold", sql("SELECT host_id, pid, tick, error >= threshold AS over_threshold FROM v_all WHERE model_available", "v_all"))
def c15(spark, sf_dir):
    return verdicts(spark, sf_dir).where("model_available").select(*KEY, "over_threshold")


def _signature_sql():
    rules = {}
    for threat, feature, test, ids in C.SIGNATURES:
        rules.setdefault((threat, ids), []).append(f"{feature} {'> 0' if test == 'gt0' else '= 1'}")
    return " UNION ALL ".join(
        f"SELECT host_id, pid, k, '{threat}' AS threat, '{ids}' AS techniques FROM p_sem WHERE {' AND '.join(conds)}"
        for (threat, ids), conds in rules.items()
    )


@query("R19_detection_matrix", sql(_signature_sql(), "p_sem"))
def r19(spark, sf_dir):
    return SC.detections(process_vectors(spark, sf_dir), [*PROC, "k"])

"""Time windows, sequences, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import constants as C
from hostlens.catalog.common import DAY, NOW, NS, PROC, ST, STRIDE, TICK, W, alert_table, query, sql, table, tel
from hostlens.catalog.decoding import NAME_SQL, _names_sql
from hostlens.catalog.joins import SUMMARY, summaries
from hostlens.functions.dims import syscall_dim
from hostlens.operators import alerts as A
from hostlens.operators import ordered as O
from hostlens.operators import windows as Wd
from hostlens.plans import reports as R

LATEST = "lst AS (SELECT host_id, pid, max(ts_ns) AS latest_ns FROM tel GROUP BY 1, 2), tw AS (SELECT t.* FROM tel t JOIN lst USING (host_id, pid) WHERE ts_ns >= latest_ns - {w}) ".format(w=W)


@query("W01_trailing_window", sql("--MORE" + LATEST + "SELECT event_id, host_id, pid FROM tw", "tel"))
def w01(spark, sf_dir):
    return Wd.trailing(tel(spark, sf_dir), PROC, ST).select("event_id", *PROC)


@query("W01b_trailing_per_event", sql(f"SELECT event_id, CAST(count(*) OVER (PARTITION BY host_id, pid ORDER BY ts_ns RANGE BETWEEN {W} PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM tel", "tel"))
def w01b(spark, sf_dir):
    return Wd.trailing_counts(tel(spark, sf_dir), PROC, ST).select("event_id", "in_window")


@query("W02_window_at_now", sql(f"SELECT event_id, host_id, pid FROM tel WHERE ts_ns >= {NOW - DAY * NS - W}", "tel"))
def w02(spark, sf_dir):
    return Wd.trailing(tel(spark, sf_dir), PROC, ST, NOW - DAY * NS).select("event_id", *PROC)


@query("W03_window_summary", sql("--MORE" + LATEST + "SELECT host_id, pid, CAST(count(*) AS BIGINT) AS event_count, (max(ts_ns) - min(ts_ns)) / 1e6 AS duration_ms FROM tw GROUP BY 1, 2", "tel"))
def w03(spark, sf_dir):
    return Wd.window_summary(Wd.trailing(tel(spark, sf_dir), PROC, ST), PROC)


@query("W04_windows_per_process", sql("SELECT host_id, pid, CAST(count(*) AS BIGINT) AS events, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM tel GROUP BY 1, 2", "tel"))
def w04(spark, sf_dir):
    return tel(spark, sf_dir).groupBy(*PROC).agg(F.count("*").alias("events"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


@query("W05_one_window", sql("--MORE" + LATEST + "SELECT event_id, ts_ns, comm FROM tw WHERE host_id = 3 AND pid = 11", "tel"))
def w05(spark, sf_dir):
    mine = tel(spark, sf_dir).where("host_id = 3 AND pid = 11")
    return Wd.trailing(mine, PROC, ST).select("event_id", "ts_ns", "comm")


@query("W05b_all_pids", sql("SELECT DISTINCT host_id, pid FROM tel", "tel"))
def w05b(spark, sf_dir):
    return tel(spark, sf_dir).select(*PROC).distinct()


@query("W06_prune", sql(f"SELECT DISTINCT host_id, pid FROM tel WHERE ts_ns >= {NOW - DAY * NS - W}", "tel"))
def w06(spark, sf_dir):
    return Wd.alive_keys(tel(spark, sf_dir), PROC, NOW - DAY * NS, ST)


@query("W07_hopping_windows", sql("SELECT host_id, pid, k, CAST(count(*) AS BIGINT) AS events, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM p_win GROUP BY ALL", "p_win"))
def w07(spark, sf_dir):
    return _windows(spark, sf_dir)


def _windows(spark, sf_dir):
    t = tel(spark, sf_dir)
    hop = Wd.hopping(t, PROC, ST)
    return hop.assign(t.select(*PROC, "ts_ns", "event_id")).groupBy(*hop.keys).agg(
        F.count("*").alias("events"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )


RUNS = (
    "w AS (SELECT host_id, pid, k, CAST(count(*) AS BIGINT) AS events FROM p_win GROUP BY ALL), "
    "r AS (SELECT *, list(k) OVER nxt AS ks, list(events) OVER nxt AS es, row_number() OVER (PARTITION BY host_id, pid ORDER BY k) AS rn, count(*) OVER (PARTITION BY host_id, pid) AS n "
    "FROM w WINDOW nxt AS (PARTITION BY host_id, pid ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) "
)


@query("W08_sequences", sql("--MORE" + RUNS + "SELECT host_id, pid, k, array_to_string(es, ',') AS run FROM r WHERE len(es) = 5", "p_win"))
def w08(spark, sf_dir):
    return _runs(spark, sf_dir).where("NOT padded").drop("padded")


@query("W09_padded_sequences", sql("--MORE" + RUNS + "SELECT host_id, pid, k, repeat(es[1] || ',', 5 - len(es)) || array_to_string(es, ',') AS run FROM r WHERE len(es) = 5 OR (n < 5 AND rn = 1)", "p_win"))
def w09(spark, sf_dir):
    return _runs(spark, sf_dir).drop("padded")


def _runs(spark, sf_dir):
    w = _windows(spark, sf_dir)
    n = w.groupBy(*PROC).agg((F.count("*") < ST.sequence_length).alias("padded"))
    out = Wd.sequences(w, PROC, ST, "events").join(n, PROC)
    return out.select(*PROC, "k", F.array_join(F.transform("sequence", lambda x: x.cast("string")), ",").alias("run"), "padded")


@query("W10_rolling_context", sql("--MORE w AS (SELECT host_id, pid, k, CAST(count(*) AS BIGINT) AS events FROM p_win GROUP BY ALL) SELECT host_id, pid, k, CASE WHEN len(es) = 5 THEN array_to_string(es, ',') END AS context FROM (SELECT *, list(events) OVER (PARTITION BY host_id, pid ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS es FROM w)", "p_win"))
def w10(spark, sf_dir):
    out = Wd.rolling_context(_windows(spark, sf_dir), PROC, "k", ST, "events")
    return out.select(*PROC, "k", F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"))


@query("W11_active_slices", sql("SELECT host_id, pid, k, CAST(count(DISTINCT (ts_ns - f) // 100000000) AS BIGINT) AS active_slices FROM (SELECT host_id, pid, k, ts_ns, min(ts_ns) OVER (PARTITION BY host_id, pid, k) AS f FROM p_win) GROUP BY ALL", "p_win"))
def w11(spark, sf_dir):
    from hostlens.operators import features as FE

    t = tel(spark, sf_dir)
    hop = Wd.hopping(t, PROC, ST)
    rows = hop.assign(t.select(*PROC, *[c for c in FE.COUNTER_COLUMNS if c not in PROC]))
    return FE.counter_block(rows, hop.keys).select(*hop.keys, "active_slices")


@query("W12_recent_syscalls", sql(f"--MORE lst AS (SELECT host_id, pid, max(ts_ns) AS l FROM tel WHERE fam = 1 GROUP BY 1, 2) SELECT t.host_id, t.pid, syscall_nr, CAST(count(*) AS BIGINT) AS n FROM tel t JOIN lst USING (host_id, pid) WHERE fam = 1 AND ts_ns >= l - {W} GROUP BY ALL", "tel"))
def w12(spark, sf_dir):
    calls = tel(spark, sf_dir).where(F.col("fam") == C.SYSCALL)
    return Wd.trailing(calls, PROC, ST).groupBy(*PROC, "syscall_nr").agg(F.count("*").alias("n"))


@query("W13_ticks", sql(f"SELECT host_id, pid, (ts_ns + {TICK - 1}) // {TICK} AS tick, CAST(count(*) AS BIGINT) AS events FROM tel GROUP BY ALL", "tel"))
def w13(spark, sf_dir):
    return tel(spark, sf_dir).groupBy(*PROC, Wd.tick_of(ST).alias("tick")).agg(F.count("*").alias("events"))


@query("W14_mid_ranks", "SELECT lang, n_chars AS value, CAST(count(*) AS BIGINT) AS n, avg(r) AS mid_rank FROM (SELECT lang, CAST(n_chars AS DOUBLE) AS n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r FROM documents) GROUP BY 1, 2")
def w14(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("n_chars"))
    return O.mid_ranks(docs, ["lang"], "n_chars")


# --- order and top-k ------------------------------------------------------------------


@query("T01_ordered_events", sql("SELECT host_id, pid, k, event_id, CAST(row_number() OVER (PARTITION BY host_id, pid, k ORDER BY ts_ns, event_id) AS BIGINT) AS position FROM p_win", "p_win"))
def t01(spark, sf_dir):
    """Position of each event in its window: neighbours are linked chunk-wise,
    positions are counts of earlier rows of the chunk plus those of earlier chunks."""
    t = tel(spark, sf_dir)
    hop = Wd.hopping(t, PROC, ST)
    rows = hop.assign(t.select(*PROC, "ts_ns", "event_id"))
    return O.positions(rows, hop.keys, ["ts_ns", "event_id"], F.expr(f"ts_ns div {STRIDE // 12}L")).select(*hop.keys, "event_id", "position")


@query("T02_alert_paging", sql("SELECT alert_id, created_unix FROM alerts ORDER BY created_unix DESC, alert_id DESC LIMIT 50 OFFSET 100", "alerts"))
def t02(spark, sf_dir):
    return A.list_alerts(alert_table(spark, sf_dir), limit=50, offset=100).select("alert_id", "created_unix")


@query("T03_last_events", sql("SELECT event_id, ts_ns FROM tel WHERE host_id = 1 AND pid = 9 ORDER BY ts_ns DESC, event_id DESC LIMIT 40", "tel"))
def t03(spark, sf_dir):
    return R.last_events(tel(spark, sf_dir).where("host_id = 1 AND pid = 9"), 40).select("event_id", "ts_ns")


@query("T04_top_processes", sql("--MORE" + SUMMARY + "SELECT host_id, pid, latest_score FROM summaries ORDER BY latest_score DESC, host_id, pid LIMIT 10", "feed"))
def t04(spark, sf_dir):
    return R.top_processes(summaries(spark, sf_dir)).select(*PROC, "latest_score")


@query("T05_top_syscalls", sql(f"SELECT {NAME_SQL} AS syscall_name, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM tel WHERE host_id = 1 AND pid = 9) LEFT JOIN {_names_sql()} ON nr = syscall_nr WHERE fam = 1 GROUP BY 1 ORDER BY n DESC, syscall_name LIMIT 15", "tel"))
def t05(spark, sf_dir):
    return R.top_syscalls(tel(spark, sf_dir), syscall_dim(spark), 1, 9)


@query("T06_last_file_operations", sql("SELECT event_id, ts_ns, operation, path FROM tel WHERE host_id = 1 AND pid = 9 AND fam = 3 ORDER BY ts_ns DESC, event_id DESC LIMIT 15", "tel"))
def t06(spark, sf_dir):
    return R.recent_files(tel(spark, sf_dir), 1, 9)

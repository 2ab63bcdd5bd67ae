import pytest
from pyspark.sql import functions as F

from hostlens import Settings
from hostlens.functions.dims import feature_names
from hostlens.operators import features as FE
from hostlens.operators import scoring as SC
from hostlens.operators.windows import Whole
from hostlens.plans import reports as R
from hostlens.plans import training
from sessions import MS, call, file, frame, net, proc

ST = Settings(sequence_length=3)
PROC = ["host_id", "pid"]

EXPLAIN = [proc("bash", exe="/bin/bash", cmdline="bash"), file("/etc/shadow", "read"), net("203.0.113.5", 9050, 200)]


def explained(spark, rows, name="evil"):
    v = FE.vectors(frame(spark, rows), Whole(PROC), PROC, ST).withColumn("base", F.array().cast("array<double>"))
    ranked = v.withColumn("w", SC.contributions(F.col("features"), F.col("base"))).withColumn("r", SC.top_ranked(F.col("w"), 5))
    return ranked.withColumn("c", SC.clauses(spark, F.col("features"), F.col("r"))).select(
        SC.sentence(F.lit(name), F.col("c")).alias("text"), SC.top_features(F.col("features"), F.col("r")).alias("top")
    ).first()


def test_explanation_order_and_text(spark):
    r = explained(spark, EXPLAIN)
    # two features tie at 1.0: the lower index comes first
    assert [t["name"] for t in r["top"]][:2] == ["is_using_tor_port", "is_shell_spawned"]
    assert r["text"] == (
        "Process evil connected to a Tor port (is_using_tor_port=1.00), spawned a shell process "
        "(is_shell_spawned=1.00), and accessed files with high-entropy paths (entropy_of_file_paths=0.41)."
    )
    assert len(r["top"]) == 5


def test_explanation_fallback_and_short_forms(spark):
    quiet = explained(spark, [proc("app", action="exit", exe="/opt/app", cmdline="app")], "calm")
    assert quiet["text"] == "Process calm shows only mild deviations from its baseline."
    one = explained(spark, [dict(fam=5, method="ptrace")], "p")
    assert one["text"] == "Process p is a Process Injection Target (a foreign process is writing its memory) (is_injection_target=1.00)."
    two = explained(spark, [dict(fam=6, action="setns"), dict(fam=6, action="pivot_root")], "p")
    assert two["text"].count(" and ") == 1 and two["text"].startswith("Process p made a Container Escape Attempt")


def fleet(spark):
    """Steady traffic of one program on two pids, then a burst on one of them."""
    rows = []
    for pid in (1, 2):
        for i in range(120):
            ts = (i * 5_000 + pid) * MS
            rows.append(dict(call(i % 3), pid=pid, comm="web", ts_ns=ts, event_id=len(rows)))
            if i % 7 == 0:
                rows.append(dict(net("203.0.113.1", 443, 100 + i), pid=pid, comm="web", ts_ns=ts + 1, event_id=len(rows)))
    return frame(spark, rows)


def test_training_and_scoring(spark):
    normal = fleet(spark)
    vectors = training.training_vectors(normal, ST)
    fitted = training.fit(vectors, ST)
    row = fitted.first()
    assert row["comm"] == "web" and row["n_windows"] == vectors.count()
    assert row["n_sequences"] == row["n_windows"] - 2
    assert row["threshold"] > 0 and row["window_error_std"] > 0
    assert len(row["norm_min"]) == len(row["center"]) == 427

    later = frame(spark, [dict(call(101), pid=1, comm="web", ts_ns=10**13 + i * MS, event_id=10_000 + i) for i in range(50)]
                  + [dict(call(0), pid=9, comm="ghost", ts_ns=10**13 + 7, event_id=20_000)])
    hot = {r["pid"]: r for r in R.explain_process(later, fitted, 0, 1, ST).collect()}
    assert hot[1]["final_score"] > 90 and hot[1]["severity"] == "CRITICAL" and hot[1]["over_threshold"]
    assert hot[1]["lstm_score"] is None and hot[1]["dominant"] == "vae"
    assert hot[1]["timestamp_ns"] == 10**13 + 49 * MS
    ghost = R.explain_process(later, fitted, 0, 9, ST).first()
    assert ghost["final_score"] == 0.0 and not ghost["model_available"] and ghost["severity"] == "LOW"
    assert ghost["explanation"] == "No trained baseline for 'ghost'; cannot score yet."
    assert ghost["top_features"] == []


def test_safe_pid(spark):
    normal = fleet(spark)
    fitted = training.fit(training.training_vectors(normal, ST), ST)
    v = FE.vectors(normal, Whole(PROC), PROC, ST).withColumn("tick", F.lit(0))
    safe = spark.createDataFrame([(0, 2)], "host_id bigint, pid bigint")
    rows = {r["pid"]: r for r in SC.score_windows(v, fitted, ST, PROC, "tick", safe).collect()}
    assert rows[2]["suppressed"] and rows[2]["final_score"] == 0.0 and rows[2]["vae_score"] > 0
    assert rows[2]["explanation"] == "PID 2 is on the known-safe list; alert suppressed."
    assert not rows[1]["suppressed"]


def test_fusion(spark):
    ws, ww = SC.weights(F.lit(True), F.lit(True), ST)
    one = spark.range(1).select(
        SC.fuse(F.lit(80.0), F.lit(None).cast("double"), ws, ww).alias("alone"),
        SC.fuse(F.lit(80.0), F.lit(40.0), ws, ww).alias("both"),
        SC.dominant(F.lit(60.0), F.lit(40.0), ws, ww).alias("tie"),
        SC.is_anomalous(F.lit(70.0)).alias("edge"),
    ).first()
    assert one["alone"] == 80.0 and one["both"] == pytest.approx(56.0) and one["tie"] == "lstm" and one["edge"]


def test_detections_need_the_whole_signature(spark):
    events = frame(spark, [dict(fam=6, action="setns")], pid=1).unionByName(
        frame(spark, [dict(fam=6, action="setns"), dict(fam=6, action="pivot_root")], pid=2)
    )
    v = FE.vectors(events, Whole(PROC), PROC, ST)
    found = {(r["pid"], r["threat"]) for r in SC.detections(v, PROC).collect()}
    assert (2, "container_escape") in found and (1, "container_escape") not in found


def test_feature_names_are_stable():
    assert feature_names()[385] == "unique_remote_ips" and feature_names()[-1] == "cpu_time_ratio"

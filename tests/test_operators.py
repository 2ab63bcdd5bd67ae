import random

import pytest
from pyspark.sql import functions as F

from hostlens import Settings
from hostlens.functions import scalars as X
from hostlens.operators import baseline as B
from hostlens.operators import ordered as O
from hostlens.operators import windows as Wd
from hostlens.operators.skew import attach_per_key
from sessions import call, frame

ST = Settings()


def test_attach_per_key_hot_and_cold(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50).alias("key"), F.col("id").alias("event_id")
    )
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("event_id").alias("m")).where("key <> 3")
    for limit in (10, 10_000):
        st = ST.with_(rows_per_task=limit)
        out = attach_per_key(rows, per_key, ["key"], "n", ["event_id"], st)
        plain = rows.join(per_key, ["key"], "left").select(*out.columns)
        assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()


def test_hot_key_is_spread_by_salt(spark):
    """The join key of a hot key is salted, so its rows do not share a partition."""
    rows = spark.range(10_000).select(F.lit(1).alias("key"), F.col("id").alias("event_id"))
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = attach_per_key(rows, per_key, ["key"], "n", ["event_id"], ST.with_(rows_per_task=100))
        sizes = [r["c"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
        assert len(sizes) == 4 and max(sizes) < 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_consecutive_pairs_and_positions(spark, chunk):
    rng = random.Random(chunk)
    data = [(rng.randrange(3), rng.randrange(200), i) for i in range(300)]
    df = spark.createDataFrame(data, "key int, ts bigint, id int")
    c = F.expr(f"ts div {chunk}L")
    got = {
        (r["prev"]["id"], r["cur"]["id"])
        for r in O.consecutive_pairs(df, ["key"], ["ts", "id"], [], c).collect()
    }
    want, places = set(), {}
    for k in range(3):
        line = sorted((t, i) for kk, t, i in data if kk == k)
        want |= {(a[1], b[1]) for a, b in zip(line, line[1:])}
        places.update({i: p + 1 for p, (_, i) in enumerate(line)})
    assert got == want
    assert {r["id"]: r["position"] for r in O.positions(df, ["key"], ["ts", "id"], c).collect()} == places


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantile_against_percentile(spark, q):
    rng = random.Random(1)
    data = [(i % 4, rng.choice([0.0, rng.gauss(0, 1), 1e6 * rng.random(), -3.5])) for i in range(400)]
    df = spark.createDataFrame(data + [(9, 2.5)], "key int, v double")
    got = {r["key"]: r["q"] for r in O.quantile(df, ["key"], "v", q, "q").collect()}
    want = {r["key"]: r["q"] for r in df.groupBy("key").agg(F.percentile("v", q).alias("q")).collect()}
    assert got == pytest.approx(want)


def test_value_bin_keeps_order(spark):
    values = sorted([0.0, -0.0, 1e-9, 1e-3, 0.42, 0.4200001, 1.0, 5e5, 1e300, -1e-9, -2.0, -1e12])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", O.value_bin(F.col("v")).alias("b")).collect()
    bins = [r["b"] for r in sorted(rows, key=lambda r: r["v"])]
    assert bins == sorted(bins)


def test_threshold_edge_cases(spark):
    data = [("one", 0.42)] + [("many", v) for v in (0.10, 0.12, 0.11, 0.13, 0.10, 0.14, 0.09, 0.12)]
    got = {r["p"]: r["threshold"] for r in B.tune_threshold(spark.createDataFrame(data, "p string, e double"), ["p"], "e", ST).collect()}
    assert got["one"] == 0.42
    assert got["many"] > 0.14
    assert B.tune_threshold(spark.createDataFrame([], "p string, e double"), ["p"], "e", ST).isEmpty()


def test_evaluation(spark):
    rows = [(v, 0) for v in (0.05, 0.06, 0.07)] + [(v, 1) for v in (0.8, 0.9, 0.95)]
    df = spark.createDataFrame(rows, "e double, y int")
    r = B.rates(df, [], "e", "y", F.lit(0.5)).first()
    assert (r["true_positive_rate"], r["false_positive_rate"], r["f1_score"]) == (1.0, 0.0, 1.0)
    assert B.roc_auc(df, [], "e", "y").first()["roc_auc"] == 1.0
    assert B.roc_auc(df.where("y = 0"), [], "e", "y").first()["roc_auc"] == 0.0
    tied = spark.createDataFrame([(1.0, 0), (1.0, 1)], "e double, y int")
    assert B.roc_auc(tied, [], "e", "y").first()["roc_auc"] == 0.5


def test_auc_against_pairs(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(200)]
    pos, neg = [v for v, y in rows if y], [v for v, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    got = B.roc_auc(spark.createDataFrame(rows, "e double, y int"), [], "e", "y").first()["roc_auc"]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n,train", [(1, 1), (2, 1), (3, 2), (5, 4), (12, 10), (13, 10), (100, 80)])
def test_split_sizes(spark, n, train):
    assert spark.range(1).select(B.train_size(F.lit(n), 0.2).alias("t")).first()["t"] == train


def test_normalizer_constant_feature(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("a", [1.0, 7.0])], "p string, features array<double>")
    packed = B.pack_normalizer(B.fit_normalizer(df, ["p"]), ["p"])
    r = packed.first()
    assert r["norm_std"] == [1.0, 1.0] and r["norm_min"] == [1.0, 5.0]
    x = df.join(packed, "p").select(B.normalized("minmax").alias("x"), B.normalized("zscore").alias("z")).collect()
    assert sorted(v["x"] for v in x) == [[0.0, 0.0], [0.0, 1.0]]
    assert all(0 <= e <= 1 for v in x for e in v["z"])
    with pytest.raises(ValueError):
        B.normalized("robust")


def test_calibration_defaults(spark):
    df = spark.createDataFrame([("flat", 0.3), ("flat", 0.3), ("none", None)], "p string, e double")
    got = {r["p"]: (r["c_mean"], r["c_std"]) for r in B.calibration(df, ["p"], "e", "c").collect()}
    assert got["flat"] == (pytest.approx(0.3), 1e-6) and got["none"] == (0.0, 1.0)


def test_short_session_gives_one_padded_sequence(spark):
    st = ST.with_(sequence_length=4)
    df = spark.createDataFrame([(1, k, float(k)) for k in (0, 1, 5)] + [(2, k, 0.0) for k in range(6)], "p int, k bigint, v double")
    runs = [tuple(r["sequence"]) for r in Wd.sequences(df, ["p"], st, "v").where("p = 1").collect()]
    assert runs == [(0.0, 0.0, 1.0, 5.0)]
    assert Wd.sequences(df, ["p"], st, "v").where("p = 2").count() == 3
    steps = spark.createDataFrame([(1, 0, None), (1, 1, 0.3), (1, 5, 0.6)], "p int, k bigint, step_error double")
    r = B.padded_sequence_errors(steps, ["p"], "k", st).collect()
    assert len(r) == 1 and r[0]["sequence_error"] == pytest.approx(0.3)


def test_trailing_window_edges(spark):
    w = ST.window_ns
    events = frame(spark, [dict(call(1), ts_ns=t) for t in (10, 10 + w, 11, 5 + 2 * w)])
    kept = sorted(r["ts_ns"] for r in Wd.trailing(events, ["host_id", "pid"], ST).collect())
    assert kept == [10 + w, 5 + 2 * w]
    exact = frame(spark, [dict(call(1), ts_ns=t) for t in (10, 10 + w)])
    assert Wd.trailing(exact, ["host_id", "pid"], ST).count() == 2
    summary = Wd.window_summary(Wd.trailing(exact, ["host_id", "pid"], ST), ["host_id", "pid"]).first()
    assert summary["event_count"] == 2 and summary["duration_ms"] == w / 1e6


def test_scalars(spark):
    one = spark.createDataFrame(
        [(bytearray(b"  bash\x00junk"), bytearray(b"a\xff b"), "/opt/app/", "", "172.31.0.1", "172.32.0.1", "10.0.0.01")],
        "a binary, b binary, p string, e string, i string, j string, l string",
    )
    r = one.select(
        X.c_string(F.col("a")).alias("a"), X.c_string(F.col("b")).alias("b"), X.basename(F.col("p")).alias("p"),
        X.basename(F.col("e")).alias("e"), X.is_rfc1918(F.col("i")).alias("i"), X.is_rfc1918(F.col("j")).alias("j"),
        X.is_rfc1918(F.col("l")).alias("l"), X.is_rfc1918(F.lit("fe80::1")).alias("v6"),
        X.duration_seconds(F.lit(" 15M ")).alias("d"), X.duration_seconds(F.lit("x")).alias("bad"),
    ).first()
    assert r.asDict() == dict(a="bash", b="a� b", p="app", e="", i=True, j=False, l=False, v6=False, d=900, bad=None)


def test_rounding_like_printf(spark):
    rng = random.Random(2)
    values = [0.125, 2.675, 0.145, 0.615, 1.005, 0.375, 0.0, 1.0, 0.285] + [rng.random() for _ in range(300)]
    values += [round(rng.random(), 2) + 0.005 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.fixed_text(F.col("v"), 2).alias("t"), X.round_half_even(F.col("v"), 4).alias("r")).collect()
    for r in rows:
        assert r["t"] == f"{r['v']:.2f}"
        assert r["r"] == round(r["v"], 4)


def test_severity_bands(spark):
    got = [r["s"] for r in spark.createDataFrame([(float(v),) for v in (95, 90, 75, 70, 50, 40, 10, 0, 1000, -50)], "v double").select(X.severity(F.col("v"), ST).alias("s")).collect()]
    assert got == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "CRITICAL", "LOW"]


def test_events_without_a_program_are_trained(spark):
    from hostlens.plans import training
    from sessions import call, frame

    rows = [dict(call(i % 3), comm=None if i % 2 else "app") for i in range(60)]
    vectors = training.training_vectors(frame(spark, rows), Settings(window_seconds=30))
    assert sorted({r["comm"] for r in vectors.select("comm").collect()}) == ["", "app"]

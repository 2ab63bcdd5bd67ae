"""Learned detectors: directions of the window detector, slopes of the sequence detector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens import Settings
from hostlens.operators import baseline as B
from hostlens.operators import scoring as SC
from hostlens.operators import windows as W
from hostlens.operators import features as FE
from hostlens.plans import training
from sessions import call, frame, net, proc

ST = Settings(window_seconds=30, sequence_length=3, latent_dims=2, power_steps=200, predict_steps=True)


def rows_of(rng, n, size=12):
    """Windows near a plane, with positions that are always 0 and one that never changes."""
    basis, at = rng.normal(size=(2, size)), rng.normal(size=(n, 2)) * [3, 1]
    x = at @ basis + 0.05 * rng.normal(size=(n, size)) + 5
    x[:, 3], x[:, 4] = 0, 0.5
    x[rng.random(n) < 0.2, 7] = 0
    return x / 12


def vectors(spark, parts):
    rows = [(0, p, k, v.tolist()) for p, x in parts.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "host_id long, comm string, k long, features array<double>")


def test_comoments_merge_and_count(spark):
    x = rows_of(np.random.default_rng(1), 30)
    df = vectors(spark, {"a": x})
    key = ["comm"]
    whole = {(r.i, r.j): r.s for r in B.comoments(df, key, "features").collect()}
    halves = B.comoments(df.where("k < 11"), key, "features").unionByName(B.comoments(df.where("k >= 11"), key, "features"))
    merged = {(r.i, r.j): r.s for r in halves.groupBy("comm", "i", "j").agg(F.sum("s").alias("s")).collect()}
    full = np.column_stack([x, np.ones(30)])
    want = full.T @ full
    assert whole.keys() == merged.keys()
    for (i, j), s in whole.items():
        assert s == pytest.approx(want[i, j]) and merged[i, j] == pytest.approx(s) and i <= j
    assert whole[12, 12] == 30 and not any(3 in p for p in whole)


def test_errors_against_numpy(spark):
    rng = np.random.default_rng(2)
    parts = {"a": rows_of(rng, 60), "b": rows_of(rng, 25), "one": rows_of(rng, 1), "same": np.repeat(rows_of(rng, 1), 9, 0)}
    packed, errors = training.window_errors(vectors(spark, parts), ST)
    got = {(r.comm, r.k): r for r in errors.collect()}
    learned = {r.comm: r for r in packed.collect()}
    for name, x in parts.items():
        span = x.max(0) - x.min(0)
        z = (x - x.min(0)) / np.where(span == 0, 1, span)
        held = min(max(round(len(x) * 0.2), 1), len(x) - 1) if len(x) > 1 else 0
        train = z[: len(x) - held]
        c = train.mean(0)
        _, sizes, v = np.linalg.svd(train - c, full_matrices=False)
        v = v[:2][sizes[:2] > 1e-9]
        y = z - c
        want = ((y**2).sum(1) - ((y @ v.T) ** 2).sum(1)) / 12
        assert [got[name, k].error for k in range(len(x))] == pytest.approx(want, abs=1e-6)
        if name in "ab":
            assert learned[name].explained == pytest.approx((sizes[:2] ** 2).sum() / (sizes**2).sum(), abs=1e-6)
            a, b = train[:-1], train[1:]
            var = ((a - a.mean(0)) ** 2).sum(0)
            slope = np.where(var > 1e-15, ((a - a.mean(0)) * (b - b.mean(0))).sum(0) / np.where(var > 1e-15, var, 1), 1.0)
            step = ((z[1:] - c - slope * (z[:-1] - c)) ** 2).mean(1)
            assert [got[name, k].step_error for k in range(1, len(x))] == pytest.approx(step, abs=1e-9)
    assert got["one", 0].step_error is None and learned["same"].explained == 0.0


def test_plane_explains_what_the_mean_does_not(spark):
    x = rows_of(np.random.default_rng(3), 80)
    df = vectors(spark, {"a": x})
    plain = training.window_errors(df, ST.with_(latent_dims=0, predict_steps=False))[1].agg(F.avg("error")).first()[0]
    plane = training.window_errors(df, ST)[1].agg(F.avg("error")).first()[0]
    assert plane < plain / 5


def test_fit_and_score(spark):
    import random

    rng = random.Random(1)
    make = lambda: rng.choice([call(rng.choice([0, 1, 59])), net("10.0.0.1", 22, 10), proc("bash")])
    events = frame(spark, [dict(make(), pid=i % 2, comm=f"app{i % 2}") for i in range(900)], step=300_000_000)
    vecs = training.training_vectors(events, ST)
    fitted = training.fit(vecs, ST).cache()
    assert {"directions", "explained", "slopes"} <= set(fitted.columns) and fitted.count() == 2
    snap = W.snapshots(events, ["host_id", "pid"], ST)
    ticks = FE.vectors(events, snap, ["host_id", "pid"], ST).cache()
    learned = SC.score_windows(ticks, fitted, ST, ["host_id", "pid"], "tick")
    by_mean = SC.score_windows(ticks, fitted.drop("directions", "slopes"), ST, ["host_id", "pid"], "tick")
    key = ["host_id", "pid", "tick"]
    a = {tuple(r[k] for k in key): r for r in learned.collect()}
    b = {tuple(r[k] for k in key): r for r in by_mean.collect()}
    assert a.keys() == b.keys() and any(abs(a[k].vae_score - b[k].vae_score) > 1 for k in a)
    # the score of a window is its own error against the calibration of its baseline
    one = {r.comm: r for r in fitted.collect()}
    for r in ticks.collect():
        base = one[r.last_comm]
        lo, hi = np.array(base.norm_min), np.array(base.norm_max)
        z = np.clip((np.array(r.features) - lo) / np.where(hi == lo, 1, hi - lo), 0, 1)
        y, v = z - np.array(base.center), np.array(base.directions).reshape(-1, 427)
        error = max(0.0, (y @ y - ((v @ y) ** 2).sum()) / 427)
        want = 100 / (1 + np.exp(-(error - base.window_error_mean) / base.window_error_std))
        assert a[r.host_id, r.pid, r.tick].vae_score == pytest.approx(want, abs=1e-4)

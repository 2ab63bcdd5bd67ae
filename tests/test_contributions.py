"""Contributions as rows: no shuffle of them per process, and nothing but the row's own value beside them."""

import random
from collections import defaultdict

import pytest

from hostlens import constants as C
from hostlens.catalog import joins as J
from hostlens.functions.dims import NUM_FEATURES, feature_dim, feature_names, salience
from hostlens.operators import scoring as SC


@pytest.fixture
def few(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(pid % 2, pid, k, [rng.random() if rng.random() < 0.05 else 0.0 for _ in range(NUM_FEATURES)]) for pid in range(4) for k in range(5)]
    table = spark.createDataFrame(rows, "host_id bigint, pid bigint, k bigint, features array<double>")
    monkeypatch.setattr(J, "process_vectors", lambda *_: table)
    return rows


def ranked(rows):
    """(host, pid, k) -> [(idx, value, contribution)], largest first."""
    mean = [sum(r[3][i] for r in rows) / len(rows) for i in range(NUM_FEATURES)]
    out = {}
    for h, p, k, f in rows:
        found = [(i, f[i], abs(f[i] - mean[i]) * salience(n)) for i, n in enumerate(feature_names())]
        out[h, p, k] = sorted((x for x in found if x[2] > 0), key=lambda x: (-x[2], x[0]))
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_sums_per_process(spark, few):
    idx, rank = defaultdict(lambda: [0, 0.0, 0.0]), defaultdict(lambda: [0, 0.0])
    for (h, p, _), found in ranked(few).items():
        for r, (i, value, c) in enumerate(found, 1):
            for sums, add in ((idx[h, p, i], (1, value, c)), (rank[h, p, r], (1, c))):
                sums[:] = [a + b for a, b in zip(sums, add)]
    got = {(r.host_id, r.pid, r.idx): [r.windows, r.value, r.contribution] for r in J.j06(spark, "").collect()}
    assert got.keys() == idx.keys() and all(got[key] == pytest.approx(idx[key], abs=2e-6) for key in idx)
    got = {(r.host_id, r.pid, r["rank"]): [r.windows, r.contribution] for r in J.t07(spark, "").collect()}
    assert got.keys() == rank.keys() and all(got[key] == pytest.approx(rank[key], abs=2e-6) for key in rank)


@pytest.mark.parametrize("query", [J.j06, J.t07])
def test_contributions_of_a_process_are_not_shuffled(spark, few, query):
    plan = plan_of(query(spark, ""))
    made = next(i for i, line in enumerate(plan) if "Generate posexplode" in line)
    assert not any("Exchange hashpartitioning" in line for line in plan[:made])
    assert any("Exchange hashpartitioning" in line for line in plan[made:])


def test_notable_ones_keep_their_ranks(spark, few):
    vectors = J._against_mean(spark, "")
    keys = ["host_id", "pid", "k"]
    rows = lambda **kw: {tuple(r) for r in SC.contribution_rows(vectors, keys, feature_dim(spark), **kw).select(*keys, "rank", "idx", "value", "contribution").collect()}
    every = rows()
    assert len(every) == sum(map(len, ranked(few).values()))
    assert rows(least=C.MIN_CONTRIBUTION) == {r for r in every if r[-1] >= C.MIN_CONTRIBUTION} != every
    assert {r[:5] for r in every} == {(*key, rank, i) for key, found in ranked(few).items() for rank, (i, _, _) in enumerate(found, 1)}
    want = {key: sum(c >= C.MIN_CONTRIBUTION for _, _, c in found[:C.TOP_PHRASES]) for key, found in ranked(few).items()}
    assert {(r.host_id, r.pid, r.k): r.notable for r in J.t08(spark, "").collect()} == {k: n for k, n in want.items() if n}


def test_a_row_does_not_carry_its_vector(spark, few):
    made = next(line for line in plan_of(J.t08(spark, "")) if "Generate posexplode" in line)
    assert "[host_id" in made and "features" not in made.rsplit("[host_id", 1)[1].split("]")[0]

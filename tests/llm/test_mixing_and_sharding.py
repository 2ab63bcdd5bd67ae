"""Mixing and sharding."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hostlens.llm import mixing as X
from hostlens.llm import sharding as H

SCHEMA = "doc_id long, source string, text string, plan string, _size int"


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 7) for i, s, t in rows], SCHEMA)


def reshared(sizes, weights, most=3):
    """Targets by handing excess on until nobody is above the limit."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in free)
        target = [most * s if i in capped else rest * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in free if target[i] > most * sizes[i]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [
    [100, 100, 100], [1, 1000, 1, 50], [5], [0, 10, 0], [0], [1, 1, 1, 1, 1, 1, 10_000], [7, 7, 7, 7], [2, 4, 6, 1, 1, 1],
])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in X.targets(df, X.Mix()).collect()}
    want = reshared(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))]) if sum(sizes) else [0.0] * len(sizes)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_reaches_targets_and_keeps_limits(spark):
    rows = [(i, f"s{i % 5}" if i % 3 else "hot", " ".join(["w"] * (1 + i * 37 % 101))) for i in range(600)]
    rows += [(None, None, "a b c"), (None, None, None), (700, "s1", ""), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    df = table(spark, rows)
    out = X.mixed(df)
    assert out.columns == df.columns
    first, second = (sorted(map(str, X.mixed(x).collect())) for x in (df, df.repartition(7)))
    assert first == second
    sizes, taken, times = Counter(), Counter(), Counter()
    for i, s, t in rows:
        sizes[s] += len((t or "").split())
    for r in out.collect():
        taken[r.source] += len(r.text.split())
        times[r.doc_id, r.text] += 1
    present = Counter((i, t) for i, _, t in rows)
    assert all(n <= 3 * present[k] for k, n in times.items())
    names = sorted(k for k in sizes if k is not None) + [None]
    want = dict(zip(names, reshared([sizes[n] for n in names], [(1, 2, 3)[i % 3] for i in range(len(names))])))
    for s in names:
        assert abs(taken[s] - want[s]) <= max(4, 0.02 * want[s])


def test_mix_of_nothing(spark):
    assert X.mixed(table(spark, [])).count() == 0
    assert X.mixed(table(spark, [(1, "a", None), (2, "b", " ")])).count() == 0


def test_pareto_prefers_high_inclusion(spark):
    """With one random number a document of a source with higher odds comes earlier."""
    df = spark.createDataFrame([(i, e) for i in range(50) for e in (0.1, 0.6, 1.9)], "doc_id long, expected double")
    plan = F.struct("expected", F.floor("expected").cast("double").alias("certain"))
    got = defaultdict(dict)
    for r in df.select("doc_id", "expected", X.place(F.col("doc_id"), plan, X.Mix()).alias("p")).collect():
        got[r.doc_id][r.expected] = r.p
    assert all(0 < p[1.9] < p[0.6] < p[0.1] < 1 for p in got.values())


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 1000])
def test_shards(spark, n):
    rows = [(i if i % 50 else None, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}", None if i % 13 == 0 else f"t{i % 90} é")
            for i in range(n)]
    rows += rows[:1] * 2 if n > 1 else []
    got = H.assigned(table(spark, rows)).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    counts = [len(shards[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(16))
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    share = Counter(s for _, s, _ in rows)
    if n == 1000:
        for part in shards.values():
            have = Counter(r.source for r in part)
            assert all(abs(have[s] - k / 16) <= len(share) for s, k in share.items())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, _, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = H.assigned(table(spark, rows[::-1]).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("ids", ["null", "equal", "both"])
def test_repeated_rows_are_taken_one_by_one(spark, ids):
    """Three sources of 200 documents, ids of no use: every source gets within half a document of its target."""
    rows = []
    for s in ("a", "b", "c"):
        for i in range(200):
            ident = {"null": None, "equal": 7, "both": None if i % 2 else 7}[ids]
            rows.append((ident, s, " ".join(["w"] * (10 if ids != "both" else 5 + i % 11))))
    have, taken = Counter(), Counter()
    for _, s, t in rows:
        have[s] += len(t.split())
    out = X.mixed(table(spark, rows).repartition(5)).collect()
    for r in out:
        taken[r.source] += len(r.text.split())
    for s, target in zip("abc", reshared([have[s] for s in "abc"], [1, 2, 3])):
        assert abs(taken[s] - target) <= 15 / 2


def test_repeated_rows_against_sql(spark, tmp_path):
    import duckdb

    rows = [(i % 40, f"s{i % 3}", " ".join(["w"] * (1 + i % 7))) for i in range(500)]
    rows += [(None, "s1", "a b c d")] * 60 + [(3, "s0", "w w")] * 90 + [(None, None, "x " * (i % 9)) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(X.SQL)
    names = [d[0] for d in rel.description]
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r)) for r in X.op5(spark, str(tmp_path)).select(*names).collect()) == want

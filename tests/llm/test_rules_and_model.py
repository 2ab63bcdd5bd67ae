"""Quality rules and quality classifier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import quality_model as M
from hostlens.llm import quality_rules as Q
from hostlens.llm.common import held_out

SCHEMA = "doc_id long, text string, source string, counts string, _failed int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 7) for i, t, s in rows], SCHEMA)


def brute_repeats(words, n=8):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + n))
    return len(hit)


@pytest.mark.parametrize("seed", range(12))
def test_repeats_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    words = [chr(97 + x) for x in rng.integers(0, 2 + seed % 3, int(rng.integers(0, 90)))]
    assert Q.measure(" ".join(words))[4] == brute_repeats(words)


def test_counts_of_one_text():
    text = "Ünï a#b\n\n  \nx <y>\nx <y>\nz z\t|"
    # no-break space is part of a word; lines without a word never count as repeated
    assert Q.measure(text) == (8, 18, 6, 1, 0)
    assert Q.measure(None) == Q.measure("") == Q.measure(" \n\t") == (0, 0, 0, 0, 0)


def test_long_text_is_measured_whole():
    body = " ".join(f"w{i}" for i in range(200_000))
    assert Q.measure(body + " " + "a b c d e f g h " * 2)[4] == 16


def test_verdicts_follow_document_and_host(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "good.org") for i in range(60)] + [(100 + i, "short", "bad.org") for i in range(60)]
    rows += [(200, good, "bad.org"), (201, "short", "tiny.org"), (202, good, "tiny.org"), (203, None, None), (None, good, None), (None, good, None)]
    df = docs(spark, rows)
    got = Q.verdicts(Q.measured(df, out="m"), counts="m", out="v").collect()
    assert len(got) == len(rows) and all(r["counts"] == "x" and r["_failed"] == 7 for r in got)
    verdict = {r.doc_id: r.v for r in got if r.doc_id is not None}
    assert verdict[0].kept and not verdict[100].kept
    assert not verdict[200].base_failed and not verdict[200].kept  # rejected with its host
    assert 0.3 < verdict[202].host_rate < 0.7
    kept = Q.accepted(df)
    assert kept.columns == df.columns
    assert kept.where("source = 'good.org'").count() == 60


def test_rules_on_empty_table(spark):
    assert Q.accepted(docs(spark, [])).count() == 0


def test_forest_learns_and_flat_arrays_agree_with_nodes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, len(M.STATISTICS)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    f = M.fit(x[:600], y[:600])
    assert ((f.score(x[600:]) >= 0.5) == y[600:]).mean() > 0.93

    def walk(row):  # one row, one tree at a time
        total = f.bias
        for node in f.roots:
            for _ in range(f.depth):
                node = f.child[node] + int(row[f.feature[node]] > f.threshold[node])
            total += f.value[node]
        return total

    assert np.allclose([walk(r) for r in x[600:620]], f.margin(x[600:620]))
    again = M.fit(x[:600], y[:600])
    assert np.array_equal(again.threshold, f.threshold) and np.array_equal(again.value, f.value)


def test_forest_without_or_with_one_kind_of_labels():
    x = np.zeros((0, len(M.STATISTICS)))
    assert M.fit(x, np.zeros(0)).score(np.zeros((2, len(M.STATISTICS)))).tolist() == [0.5, 0.5]
    one = M.fit(np.zeros((4, len(M.STATISTICS))), np.ones(4)).score(np.zeros((1, len(M.STATISTICS))))
    assert 0.8 < one[0] < 1


def test_statistics_are_finite_for_odd_texts():
    for t in (None, "", " ", "\n", "a", "é" * 50_000, "x " * 50_000, "!" * 9):
        s = M.statistics(t)
        assert len(s) == len(M.STATISTICS) and np.isfinite(s).all()


def test_training_ignores_held_out_labels(spark):
    rows = [(i, ("good words of a plain text number %d here." % i) if i % 2 else "BAD!! BAD!! " * (i % 7 + 1), "s") for i in range(120)]
    df = docs(spark, rows + [(None, None, None), (3, rows[3][1], "s")])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(120)] + [(None, 1, 1), (500, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    out = held_out(F.col("doc_id"), 3, 1)
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = M.train(df, labels), M.train(df, flipped)
    assert np.array_equal(a.value, b.value)
    scored = {r.doc_id: r._score for r in M.scored(df, a, out="_score").collect() if r.doc_id is not None}
    assert all((scored[i] >= 0.5) == bool(i % 2) for i in range(120))
    kept = M.accepted(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(120) if i % 2}
    assert M.accepted(docs(spark, []), labels).count() == 0

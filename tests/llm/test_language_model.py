"""Backoff automaton against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from hostlens.llm import language_model as L


def brute(rows):
    counts, pairs, words = Counter(), Counter(), []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        words.append(w)
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
            pairs.update(zip(w, w[1:]))
    n, v, out = sum(counts.values()), len(counts), Counter()
    for (i, _), ws in zip(rows, words):
        base, score, before = 0.0, 0.0, None
        for w in ws:
            base += math.log10((counts[w] + 1) / (n + v + 1))
            p = (counts[w] or 1) / (n + 1)
            c = counts[before] if before is not None else 0
            back = 1 - 0.5 * c / (c + 100)
            score += math.log10((1 - back) * pairs[before, w] / c + back * p if c else p)
            before = w
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out[i, held, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6), round(score, 6)] += 1
    return out


@pytest.mark.parametrize("model", [L.Model(), L.Model(batch_bytes=60, shard_bytes=40), L.Model(batch_rows=1)])
def test_scores(spark, model):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"W{x}" for x in rng.zipf(1.4, 12) % 30)) for i in range(60)]
    rows += [(None, None), (None, "w1 w2"), (61, ""), (62, " \n"), (3, rows[3][1]), (63, "neverseen " * 3), (64, "w1 W2 é\x0bÉ " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in L.scores(df, model=model).collect())
    assert got == brute(rows)


def test_without_training(spark):
    out_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(out_id, "a b")], "doc_id long, text string")
    (r,) = L.scores(df).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert L.scores(df.limit(0)).count() == 0


def test_probabilities_of_a_state_add_up_to_one():
    """Over all known words, the end and the unknown class."""
    texts = [b"a b a c", b"a b", b"c"]
    b = L.Batch([*texts, b"a zz"], np.array([True, True, True, False]), 1)
    inner = np.ones(len(b.tokens), bool)
    inner[b.starts] = False
    words = np.bincount(b.tokens[: 4 + 1 + 2 + 1 + 1 + 1], minlength=b.n_words)
    pairs = np.zeros(len(b.pairs), np.int64)
    for t in texts:
        w = [list(b"a b c".split()).index(x) + 1 for x in t.split()] + [0]
        for u, v in zip(w, w[1:]):
            pairs[np.searchsorted(b.pairs, u * b.n_words + v)] += 1
    m = L.Automaton(b, words, pairs, int(words.sum()), L.Model())
    known = np.flatnonzero(words)
    for u in [x for x in known if x]:
        total = 0.0
        for v in [*known, b.n_words - 1]:
            at = np.searchsorted(m.arc, (u + 1) * b.n_words + v)
            hit = at < len(m.arc) and m.arc[at] == (u + 1) * b.n_words + v
            total += 10 ** (m.weight[at] if hit else m.fail_weight[u + 1] + m.root_weight[v])
        assert total == pytest.approx(1)


def test_blobs_round_trip():
    rng = np.random.default_rng(2)
    h = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 5)]
    c = [np.array([], np.int64), np.array([0, 1, 255, 256, 1 << 40])]
    hashes, counts = L._unpacked(L._packed(h, c))
    assert all(np.array_equal(a, b) for a, b in zip(h + c, hashes + counts))

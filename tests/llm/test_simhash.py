"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash

from hostlens.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, _row int, keep int, _orphan int"


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "One", "one TWO", "a b c", "a b c d e f g a b c d", "Ärger ÉTÉ x y\x0bz", "w " * 9, "ab cd ef " * 30_000,
])
def test_fingerprint(text):
    assert S.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    fps = [0]
    for i in range(150):  # chains and stars of flipped bits, sign bit included
        base = fps[int(rng.integers(0, len(fps)))] if rng.random() < 0.85 else int(rng.integers(0, 1 << 63))
        for b in rng.integers(0, 64, int(rng.integers(0, 5))):
            base ^= 1 << int(b)
        fps.append(base & (1 << 64) - 1)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    order = rng.permutation(len(fps)).tolist()
    rows = spark.createDataFrame([(i, signed[i]) for i in order], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in S.clusters(rows).collect()}
    assert got == dict(enumerate(brute_components(fps)))


def test_long_chain(spark):
    fps, f = [], 0
    for i in range(40):
        fps.append(f)
        f ^= 3 << (i % 31) * 2
    rows = spark.createDataFrame([(100 - i, x) for i, x in enumerate(fps)], "doc_id long, fp long")
    want = brute_components(fps)
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, []).append(100 - i)
    got = {r.doc_id: r.component_id for r in S.clusters(rows).collect()}
    assert all(got[d] == min(g) for g in groups.values() for d in g)


def test_one_per_component(spark):
    body = "the quick brown fox jumps over the lazy dog and runs far away from here "
    rows = [(5, body * 3), (3, body * 3), (3, body * 3), (9, "other words entirely unlike"), (None, "no id at all"),
            (None, "no id at all"), (None, body * 3), (11, None), (12, ""), (13, " ")]
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)
    kept = S.one_per_component(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())
    assert got == [(False, 3, body * 3), (False, 9, "other words entirely unlike"), (False, 11, None), (True, 0, "no id at all")]
    assert S.one_per_component(df.limit(0)).count() == 0
    assert S.clusters(spark.createDataFrame([], "doc_id long, fp long")).count() == 0


def test_hex(spark):
    rows = spark.createDataFrame([(0,), (-1,), (255,), (-(1 << 63),)], "v long")
    assert [r[0] for r in rows.select(S.hex64(rows.v)).collect()] == ["0" * 16, "f" * 16, "0" * 14 + "ff", "8" + "0" * 15]

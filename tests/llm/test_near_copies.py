"""The near-dedup stage: 5-word shingles, Jaccard of 0.8 or more, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from hostlens.llm import simhash as S


def text_of(rng, n):
    return [f"w{i}" for i in rng.integers(0, 1 << 40, n)]


def brute(texts):
    """Component of every text, by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    similar = {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                similar[i, j] = both / (len(a) + len(b) - both)
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], similar


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(8)
    texts = []
    for n in (40, 120, 400):
        for changes in (1, 2, 3, 4, 6, 8, 10) * 6:
            words = text_of(rng, n)
            copy = list(words)
            for at in rng.choice(n, min(changes, n // 5), replace=False):
                copy[at] = f"x{rng.integers(0, 1 << 40)}"
            texts += [" ".join(words), " ".join(copy).upper()]
    return texts


def test_planted_copies(spark, planted):
    want, similar = brute(planted)
    levels = np.array(list(similar.values()))
    assert (levels < 0.85).sum() >= 10 and (levels < 0.95).sum() >= 40
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.copies(docs).collect()}
    found = [got[i] == got[j] for i, j in similar]
    assert np.mean(found) >= 0.95
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is linked that is not that similar
    kept = sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(got.values()))


def test_crowd_of_near_copies(spark):
    """Copies of one text, each with a word of its own, are one component."""
    rng = np.random.default_rng(9)
    words = text_of(rng, 200)
    texts = [" ".join(words)]
    for _ in range(120):
        copy = list(words)
        copy[int(rng.integers(0, 200))] = f"x{rng.integers(0, 1 << 40)}"
        texts += [" ".join(copy)] * 2
    texts += [" ".join(text_of(rng, 200)) for _ in range(30)]
    want, _ = brute(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.copies(docs).collect()} == dict(enumerate(want))


def crowd_around(rng, copies, changes):
    """One text of 200 words and copies of it, each with words of its own."""
    words = text_of(rng, 200)
    texts = [" ".join(words)]
    for _ in range(copies):
        copy = list(words)
        for at in rng.choice(200, changes, replace=False):
            copy[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("copies", [100, 1500])
def test_star(spark, copies):
    """Copies that resemble the text they were made from, and not each other."""
    rng = np.random.default_rng(3)
    texts = [t for t in crowd_around(rng, copies * 3, 4)]
    base = S.shingles(texts[0], 5)
    near = [t for t in texts[1:] if S.jaccard(base, S.shingles(t, 5)) >= 0.8][:copies]
    assert len(near) == copies
    rng.shuffle(near)
    docs = spark.createDataFrame(list(enumerate([*near, texts[0]])), "doc_id long, text string")
    found = Counter(r.component_id for r in S.copies(docs).collect())
    assert max(found.values()) >= 0.95 * (copies + 1)


@pytest.mark.parametrize("level", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_pairs(spark, level):
    """Pairs of 300 shingles just at a similarity."""
    rng = np.random.default_rng(int(100 * level))
    texts = []
    for _ in range(300):
        words = text_of(rng, 304)
        copy, at = list(words), 0
        while S.jaccard(S.shingles(" ".join(words), 5), S.shingles(" ".join(copy), 5)) > level + 0.012:
            copy[-1 - at] = f"x{rng.integers(0, 1 << 40)}"
            at += 1
        texts += [" ".join(words), " ".join(copy)]
    _, similar = brute_pairs(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.copies(docs).collect()}
    found = [got[i] == got[j] for i, j in similar]
    assert len(found) > 250 and np.mean(found) >= 0.93


def brute_pairs(texts):
    """Neighbouring texts that are alike; others share nothing."""
    sets = [S.shingles(t, 5) for t in texts]
    similar = {(i + 1, i): S.jaccard(sets[i], sets[i + 1]) for i in range(0, len(sets), 2)}
    return None, {p: x for p, x in similar.items() if x >= 0.8}


def test_ids_that_are_null_or_repeated(spark):
    rng = np.random.default_rng(4)
    one, two, three = (" ".join(text_of(rng, 60)) for _ in range(3))
    rows = [
        (None, one, "a"), (None, one + " more", "b"), (None, two, "c"), (None, two, "c"),  # no ids: one of each
        (5, three, "d"), (5, three, "d"), (5, "another text", "e"), (7, three + " x", "f"), (6, "", "g"), (8, None, "h"), (9, " ", "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _body string")
    kept = sorted(((r.doc_id or 0, r._body) for r in S.one_per_component(docs).collect()))
    assert [k for k in kept if k[0]] == [(5, "d"), (5, "e"), (6, "g")]
    assert [k[1] for k in kept if not k[0]] in (["a", "c"], ["b", "c"])
    assert S.one_per_component(docs).columns == docs.columns
    assert S.one_per_component(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = np.random.default_rng(5)
    words = text_of(rng, 100_000)
    copy = [*words[:50_000], "new", *words[50_000:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(words[:50_000]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.copies(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_similarity_is_exact():
    words = [f"w{i}" for i in range(13)]
    a, b = S.shingles(" ".join(words), 5), S.shingles(" ".join(words[:12]), 5)
    assert S.jaccard(a, b) == 8 / 9 and S.jaccard(a, a) == 1 and S.jaccard(a[:0], b[:0]) == 1
    assert S.jaccard(np.arange(9), np.arange(1, 10)) == 0.8


def test_pairs_that_no_centre_shows(spark, monkeypatch):
    """Twelve pairs that all meet at the same variants, whose centres resemble one other set each."""
    rng, own, texts = np.random.default_rng(12), S._sets, []
    for _ in range(12):
        words = text_of(rng, 60)
        texts += [" ".join(words), " ".join([*words, "more"])]

    def all_meet(*args):
        made, same = own(*args), F.lit(0).cast("long")
        return F.struct(made["name"].alias("name"), made["size"].alias("size"), same.alias("wide1"), same.alias("wide2"), F.array(same).alias("short"))

    monkeypatch.setattr(S, "_sets", all_meet)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.copies(docs).collect()} == {i: i // 2 * 2 for i in range(24)}


def test_remaining_pairs(spark):
    """Pairs of one variant: not those of one component, nor those that share too little;
    a pair that meets at several variants comes once."""
    sets = [(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5, 6]), (3, [7, 8, 9, 10, 11]), (4, [7, 8, 9, 10, 12]), (5, [7, 8, 9, 10, 11, 13]), (6, [20, 21])]
    met = spark.createDataFrame([(v, i) for v in (8, 9) for i in range(1, 7)], "variant long, id long")
    info = spark.createDataFrame(
        [(i, len(s), 1, 0, 0, [i % 2 + 8, 1 << 19 if i < 4 else 3]) for i, s in sets], "id long, size int, mass long, wide1 long, wide2 long, short array<long>"
    )
    roots = spark.createDataFrame([(2, 1)], "node long, root long")
    sets = spark.createDataFrame(sets, "id long, set array<long>")
    # 4 has a shingle of its own among five, 2 and 5 have one among six each
    assert sorted(map(tuple, S._remaining(met, info, sets, roots, 0.8, 20).collect())) == [(3, 1), (3, 2), (5, 1), (5, 3)]
    loose = sorted(map(tuple, S._remaining(met, info, sets, None, 0.6, 20).collect()))
    assert loose == [(2, 1), (3, 1), (3, 2), (4, 1), (4, 3), (5, 1), (5, 2), (5, 3)]
    wide = info.withColumn("wide1", info.id * 0 - (info.id % 2))  # odd and even ones are far apart, by all 64 bits
    assert sorted(map(tuple, S._remaining(met, wide, sets, None, 0.6, 20).collect())) == loose


def test_outer_members_of_a_crowd_are_not_all_compared(spark):
    """Copies around one text that are near each other, yet not near enough: few of their pairs are left, and none that is alike."""
    rng = np.random.default_rng(13)
    text, sets = rng.integers(0, 1 << 63, 300), []
    for i in range(120):
        own = rng.integers(0, 1 << 63, 300)
        sets.append(np.where(rng.random(300) < (0.09 if i % 2 else 0.14), own, text).astype(np.uint64))
    sets = [np.unique(x) for x in sets] + [np.unique(text.astype(np.uint64))]
    alike = {(a, b) for a in range(121) for b in range(a) if S.jaccard(sets[a], sets[b]) >= 0.8}
    met = spark.createDataFrame([(v, i) for v in (0, 1) for i in range(121)], "variant long, id long")
    info = spark.createDataFrame(
        [(i, len(x), 1, 0, 0, [0], int(len(np.intersect1d(x, sets[-1]))), S._counts(x).tolist()) for i, x in enumerate(sets)],
        "id long, size int, mass long, wide1 long, wide2 long, short array<long>, shared long, counts array<int>",
    )
    # every second member belongs to the text; the others are each their own
    roots = spark.createDataFrame([(i, 0) for i in range(1, 121) if i % 2 or i == 120], "node long, root long")
    stored = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(sets)], "id long, set array<long>")
    of = {i: 0 if i % 2 or i == 120 else i for i in range(121)}
    left = list(map(tuple, S._remaining(met, info, stored, roots, 0.8, 20).collect()))
    assert len(left) == len(set(left)) and {p for p in alike if of[p[0]] != of[p[1]]} <= set(left)
    assert all(of[a] != of[b] and a > b for a, b in left) and len(left) < 500


def test_texts_are_moved_once(spark):
    """Also with ids that are null, in a join that is no broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(14)
        one, two = (" ".join(text_of(rng, 60)) for _ in range(2))
        docs = spark.createDataFrame([(None, one), (None, one), (4, two), (3, two), (3, two)], "doc_id long, text string")
        kept = S.one_per_component(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\([^)]*_own", plan)) == 1
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, one), (3, two)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

"""The audit of sources against the formulas, term by term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hostlens.llm import source_audit as A

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, TERM.findall(lower(text))) for text, lang, source in rows]
    docs, counts = Counter(), defaultdict(Counter)
    for lang, source, words in found:
        docs.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= min_docs]
        v = len(kept)
        own = {s: {w: c[w] for w in kept} for (x, s), c in counts.items() if x == lang}
        own[None] = {w: sum(c[w] for s, c in own.items()) for w in kept}
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * v) for w in kept} for s, c in own.items()}
        for s in own.keys() - {None}:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in own.keys() - {None, s}]
            best = [(p[s][w] - p[None][w], w) for w in kept if own[s][w] and p[s][w] > p[None][w]]
            for part, items in (("pair", pairs), ("term", best)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(items[: top if part == "term" else None], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def some_rows():
    rnd = random.Random(5)
    words = ["The", "the", "é", "İx", "zoo", "A", "a1b", "ÀÀ", "straße", "\x00q", "日本"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        mine = rnd.sample(words, 12)
        text = " ".join(rnd.choice(mine) for _ in range(rnd.randint(0, 30)))
        rows.append((text, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "ſ", None, "S10"])))
    rows += rows[:150] + [rows[3]] * 60 + [("the zoo", "en", s) for s in ("s1", "s2", "s1")] * 20
    rows += [("rare words only", "xx", "s1"), (None, "xx", "s2"), ("", "xx", None), ("one", "solo", "s1"), ("the " * 5000, "en", "s9")]
    return rows


@pytest.mark.parametrize("block_entries", [1, 7, 10_000])
def test_audit(spark, block_entries, monkeypatch):
    monkeypatch.setattr(A, "HELD", 50)
    monkeypatch.setattr(A.pair_values, "__defaults__", (block_entries,))
    rows = some_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", A.F.lit(1)).withColumn("n", A.F.lit("n"))
    out = A.audit(docs.repartition(3), min_docs=30, top_terms=7)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == expected(rows, 30, 7)


def test_nothing_kept_and_empty_table(spark):
    docs = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], "text string, lang string, source string")
    assert sorted(map(tuple, A.audit(docs).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert A.audit(docs.limit(0)).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    row = spark.sql("SELECT 9000000000000000000 AS n, 9000000000000000001 AS total, 3L AS kept").select(A.share("n", "total", "kept")).first()
    assert row[0] == 1 + 10**9 * (9 * 10**18 + 5) // (9 * 10**18 + 1 + 15)


def test_copies_are_read_once(spark):
    rows = [("same", "en", s) for s in ("a", "b", "a")] + [("same", "de", "a"), ("other", "en", "a")]
    out = A.collapsed(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted((r.lang, r.text, sorted(map(tuple, r.sources))) for r in out) == [
        ("de", "same", [("a", 1)]), ("en", "other", [("a", 1)]), ("en", "same", [("a", 2), ("b", 1)]),
    ]


def test_blocks_against_dense_shares():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        s, t = rnd.integers(1, 6), rnd.integers(1, 9)
        zeros = rnd.integers(0, 20, s)
        has = rnd.random((s, t)) < 0.4
        dense = np.where(has, rnd.integers(0, 40, (s, t)), zeros[:, None])
        source, term = np.nonzero(has)
        for g, sums in A.compare([str(i) for i in range(s)], zeros, source, term, dense[source, term]):
            want = [
                int((np.abs(dense[g] - dense[h]) - abs(zeros[g] - zeros[h])).sum()) for h in range(g + 1, s)
            ]
            assert sums.tolist() == want

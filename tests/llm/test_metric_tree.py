"""M-tree search against all inner products."""

import math

import numpy as np
import pytest

from hostlens.llm import metric_tree as T

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def brute(rows, k=5, every=50):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        usable.append((i, q))
    out = []
    for n, (i, q) in enumerate(usable):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for m, (j, x) in enumerate(usable) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = T.top_k(df, p=T.Search(**settings))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("settings", [{}, {"block_rows": 40, "page": 4, "query_rows": 3, "pivots": 5}])
def test_clustered_vectors(spark, settings):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    rows = [(i - 20, (centers[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(320)]
    assert run(spark, rows, **settings) == brute(rows)


def test_ties_copies_and_unusable_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.5]) for i in range(200)] + [(i, [0.5, 1.0]) for i in range(200, 260)]
    rows += [(300, None), (350, [1.0, None]), (400, [nan, 1.0]), (450, [float("inf"), 0.0]), (None, [9.0, 9.0]),
             (50, [1.0, 0.5]), (100, [-3.0, 0.0]), (500, []), (550, [2.0]), (-50, [-1.0, -1.0])]
    assert run(spark, rows, block_rows=64, page=8) == brute(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [0.1, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [0.0, 3.0])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (0, 1, 1, 131072) in got and len([r for r in got if r[0] == 50]) == 15


def test_no_row_holds_a_block(spark, monkeypatch):
    written, real = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda *a, **b: written.append(real(*a, **b)) or written[-1])
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    assert run(spark, rows) == brute(rows)
    sizes = [t.agg({f.name: "max"}).first()[0] for t in written for f in t.schema if f.dataType.typeName() == "binary"]
    assert sizes and all(len(x) == 2 * 16 for x in sizes)


def test_pieces_are_bounded():
    numbers = np.arange(500)
    for kind, width in (("<i2", 4096), ("<i4", 64), ("<i8", 3), ("<i8", 1 << 15)):
        v = (numbers[:, None] * 7 - np.arange(width)).astype(kind)
        got = T.pieces(numbers, -numbers, v)
        assert all(len(x) <= max(T.PIECE_BYTES, 16 + v[0].nbytes) for x in got)
        back = [np.concatenate(x) for x in zip(*(T.unpacked(x, width, v.dtype) for x in got))]
        assert all((a == b).all() for a, b in zip(back, (numbers, -numbers, v)))


@pytest.mark.parametrize("size", [127.9, 128.0, 1000.0, 4e6])
def test_components_of_every_length(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (size * rng.uniform(-1, 1, size=2)).tolist()) for i in range(120)] + [(150, [size, 0.0]), (200, [-size, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [0.1]), (50, [0.0])]) == brute([(0, [1.0]), (1, [0.1]), (50, [0.0])])
    with pytest.raises(ValueError):
        run(spark, [(0, [1e9])])
    large = [(i, [float(i * 3001), float(-i)]) for i in range(0, 2000, 25)]
    assert run(spark, large, block_rows=30) == brute(large)


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.integers(-20, 20, (300, 6)) + c for c in (0, 90, -90)])
    largest = int((vectors**2).sum(1).max())
    tree = T.Tree(np.arange(900), vectors.astype(float), largest, 16)
    for n in range(len(tree.center)):
        stack, rows = [n], []
        while stack:
            x = stack.pop()
            span = range(tree.first[x], tree.last[x])
            rows += span if tree.leaf[x] else []
            stack += [] if tree.leaf[x] else span
        far = np.linalg.norm(tree.points[rows] - tree.center[n], axis=1)
        assert far.max() <= tree.radius[n] + 1e-9
        assert not tree.leaf[n] or len(rows) <= 16
    asked = 0

    class Counting(np.ndarray):
        def __matmul__(self, other):
            nonlocal asked
            asked += len(self)
            return np.asarray(self) @ other

    tree.vectors = tree.vectors.view(Counting)
    for q in vectors[::100]:
        scores = vectors @ q
        want = sorted(zip((-scores).tolist(), range(900)))[:5]
        assert tree.search(-1, q.astype(float), 5, 1e-6) == [(-s, i) for s, i in want]
    assert asked < 9 * 900 / 2

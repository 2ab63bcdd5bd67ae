"""Exact top-k by inner product with M-trees.

Vectors are quantised to integers.  With one more coordinate, sqrt(M - |x|^2) for
rows and 0 for queries (M: the largest squared length), the order by Euclidean
distance is the order by inner product, so a metric tree serves.

Rows are grouped around pivots and cut into blocks of a bounded number of rows;
each block is loaded into an M-tree: pages of child nodes with routing object,
covering radius and distance to the parent's object, and leaf pages of rows with
their distance to the page's object.  Blocks of queries meet all blocks of rows.
A search is best-first: the node with the smallest lower bound of distance is
opened next, until no bound is below the k-th best found.  Stored parent
distances spare computing a distance wherever |d(q, parent) - d(parent, x)|
already exceeds that.  Bounds are floating point and widened by a margin; scores
are exact integers, so results and ties are exact.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without id.  Shorter vectors count as padded with zeros.  Rows that share an
id are rows of their own: each is a query where the id asks for it, and each is a
candidate of every other row.  Scores are computed in floating point
while that is exact and in 64-bit integers beyond; if squared lengths exceed 2^62,
scores are no longs and an error is raised.  Equal vectors, however many, are
rows of pages like any other.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostlens.llm.common import col, materialize, query, small_batches, table

#: squared lengths up to the first bound are exact in floating point; scores up to the second are longs
EXACT, LONG = 1 << 52, 1 << 62
#: of a row of packed queries, unless one query is longer
PIECE_BYTES = 1 << 17
#: of the tables kept between two steps; a task that writes holds so much
ROW_GROUP = {"parquet.block.size": str(16 << 20)}


@dataclass(frozen=True)
class Search:
    """``pivots`` bounds what is broadcast to order the rows."""

    k: int = 5
    scale: int = 256
    every: int = 50
    block_rows: int = 4096
    query_rows: int = 512
    page: int = 512
    pivots: int = 256


class Tree:
    """An M-tree over the rows of one block, in arrays.

    Node n has object ``center[n]``, ``radius[n]``, distance ``up[n]`` to its parent's
    object, and either children ``first[n]:last[n]`` or, as a leaf, rows
    ``first[n]:last[n]`` of the tree's own order.  ``own`` tells rows of one id apart.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: int, page: int, own: np.ndarray | None = None):
        lift = np.sqrt(np.maximum(0.0, float(largest) - (vectors.astype(float) ** 2).sum(1)))
        self.points = np.column_stack((vectors.astype(float), lift))
        self.page = page
        self.largest = largest
        nodes = [(np.arange(len(ids)), self._middle(np.arange(len(ids))), 0.0)]
        self.center, self.radius, self.up, self.first, self.last, self.leaf = [], [], [], [], [], []
        order: list[np.ndarray] = []
        row_up: list[np.ndarray] = []
        at = placed = 0
        while at < len(nodes):
            rows, center, up = nodes[at]
            far = self._distance(rows, center)
            self.center.append(center)
            self.radius.append(float(far.max()))
            self.up.append(up)
            groups = [] if len(rows) <= page else self._split(rows)
            self.leaf.append(not groups)
            if groups:
                self.first.append(len(nodes))
                for g in groups:
                    middle = self._middle(g)
                    nodes.append((g, middle, float(np.linalg.norm(middle - center))))
                self.last.append(len(nodes))
            else:
                order.append(rows)
                row_up.append(far)
                self.first.append(placed)
                placed += len(rows)
                self.last.append(placed)
            at += 1
        order = np.concatenate(order)
        self.ids, self.vectors, self.points = ids[order], vectors[order], self.points[order]
        self.rows = (ids if own is None else own)[order]
        self.row_up = np.concatenate(row_up)
        self.center, self.radius, self.up = np.array(self.center), np.array(self.radius), np.array(self.up)

    def _middle(self, rows: np.ndarray) -> np.ndarray:
        """A routing object: the member nearest to the mean."""
        p = self.points[rows]
        return p[((p - p.mean(0)) ** 2).sum(1).argmin()]

    def _distance(self, rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - center) ** 2).sum(1))

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Up to ``page`` groups around spread members; halves where all are equal."""
        fan = min(self.page, -(-len(rows) // self.page) * 2, 16)
        seeds = self.points[rows[np.linspace(0, len(rows) - 1, max(2, fan)).astype(int)]]
        p = self.points[rows]
        gap = (p**2).sum(1)[:, None] - 2 * p @ seeds.T + (seeds**2).sum(1)
        near = gap.argmin(1)
        groups = [rows[near == s] for s in range(len(seeds))]
        groups = [g for g in groups if len(g)]
        if max(map(len, groups)) == len(rows):
            groups = np.array_split(rows, -(-len(rows) // self.page) if len(rows) <= self.page**2 else self.page)
        return groups

    def search(self, query_row: int, q: np.ndarray, k: int, margin: float) -> list[tuple[int, int]]:
        """The k best (score, id) of the tree, best first; the query's own row is left out."""
        point = np.append(q, 0.0)
        norm = float(q.astype(float) @ q.astype(float))
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        reach = np.inf
        root = float(np.linalg.norm(self.center[0] - point))
        heap = [(max(0.0, root - self.radius[0]), 0, root)]
        while heap and heap[0][0] <= reach:
            _, node, to_node = heapq.heappop(heap)
            a, b = self.first[node], self.last[node]
            if not self.leaf[node]:
                bound = np.abs(to_node - self.up[a:b]) - self.radius[a:b]
                live = np.flatnonzero(bound <= reach) + a
                far = np.sqrt(((self.center[live] - point) ** 2).sum(1))
                low = np.maximum(0.0, far - self.radius[live])
                for n, d, f in zip(live.tolist(), low.tolist(), far.tolist()):
                    if d <= reach:
                        heapq.heappush(heap, (d, n, f))
                continue
            live = np.flatnonzero(np.abs(to_node - self.row_up[a:b]) <= reach) + a
            scores = self.vectors[live] @ q
            if len(best) == k:
                keep = scores >= best[0][0]
                live, scores = live[keep], scores[keep]
            elif len(live) > 4 * k:
                keep = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
                live, scores = live[keep], scores[keep]
            for score, i, row in zip(scores.tolist(), self.ids[live].tolist(), self.rows[live].tolist()):
                entry = (int(score), -i)
                if row == query_row:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                # |q - x|^2 = |q|^2 + M - 2 q.x
                reach = np.sqrt(max(0.0, norm + self.largest - 2 * best[0][0])) + margin
        return [(score, -i) for score, i in sorted(best, reverse=True)]


def quantised(vector: Column, scale: int) -> Column:
    """Integers floor(scale * x); null where the vector takes no part."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def stored_kind(largest: int) -> np.dtype:
    """The shortest integers that hold every component, given the largest squared length."""
    return np.dtype("<i2" if largest < 1 << 30 else "<i4" if largest < 1 << 60 else "<i8")


def pieces(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> list[bytes]:
    """Queries in pieces of some ``PIECE_BYTES``: numbers of rows, ids and vectors, one after the other."""
    many = max(1, PIECE_BYTES // (16 + vectors.itemsize * vectors.shape[1]))
    cuts = [slice(a, a + many) for a in range(0, len(rows), many)]
    return [rows[c].astype("<i8").tobytes() + ids[c].astype("<i8").tobytes() + vectors[c].tobytes() for c in cuts]


def unpacked(piece: bytes, width: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = len(piece) // (16 + kind.itemsize * width)
    numbers = np.frombuffer(piece, "<i8", 2 * m)
    return numbers[:m], numbers[m:], np.frombuffer(piece, kind, offset=16 * m).reshape(m, width)


def top_k(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", p: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``p.every``."""
    spark = vectors.sparkSession
    small_batches(vectors)
    rows = materialize(
        vectors.select(col(vec_id).cast("long").alias("id"), quantised(col(vector), p.scale).alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .withColumn("row", F.monotonically_increasing_id()),
        "quantised", **ROW_GROUP,
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], empty)
    if largest > LONG:
        raise ValueError("scores of these vectors exceed 64-bit integers")
    width, largest = max(1, width), int(largest)
    kind, short = np.dtype("f8") if largest <= EXACT else np.dtype("i8"), stored_kind(largest)
    # every task sends its first numbers of rows; vectors are sent of the chosen ones only
    chosen = [r.row for r in rows.select("row").orderBy(F.xxhash64("row"), "row").limit(min(p.pivots, max(1, n // 64))).collect()]
    pivots = {r.row: r.v for r in rows.where(F.col("row").isin(chosen)).select("row", "v").collect()}
    centers = np.array([[*pivots[r], *[0] * (width - len(pivots[r]))] for r in chosen], float)
    blocks, query_blocks = -(-n // p.block_rows), max(1, -(-n // p.every // p.query_rows))

    def matrix(values: pd.Series) -> np.ndarray:
        lengths = values.map(len).to_numpy()
        out = np.zeros((len(values), width))
        if lengths.sum():
            at = np.arange(width) < lengths[:, None]
            out[at] = np.concatenate(values.to_list())
        return out

    @F.pandas_udf("pivot int, packed binary")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        step = short.itemsize * width
        for v in batches:
            x = matrix(v)
            raw = x.astype(short).tobytes()
            pivot = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1).astype("int32")
            yield pd.DataFrame({"pivot": pivot, "packed": [raw[at : at + step] for at in range(0, len(raw), step)]})

    # rows near one pivot follow each other; a block is the next so many of them, so equal
    # vectors spread over as many blocks as they need
    placed = materialize(
        rows.select("row", "id", nearest("v").alias("near"))
        .select("row", "id", "near.packed", "near.pivot", F.pmod(F.xxhash64("row"), F.lit(64)).alias("turn")),
        "placed", **ROW_GROUP,
    )
    counts = placed.groupBy("pivot", "turn").agg(F.count("*").alias("n"))
    before = Window.orderBy("pivot", "turn").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(
        counts.select(F.col("pivot").alias("p"), F.col("turn").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")),
        "block-starts",
    )
    within = Window.partitionBy("pivot", "turn").orderBy("id", "row")
    numbered = placed.join(F.broadcast(counts), (F.col("pivot") == F.col("p")) & (F.col("turn") == F.col("t"))).select(
        F.floor((F.col("before") + F.row_number().over(within) - 1) / p.block_rows).cast("int").alias("block"),
        F.lit(False).alias("asks"), "id", "row", F.col("packed").alias("v"),
    )

    def load(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "row"])
        v = np.frombuffer(b"".join(frame["packed"]), short).reshape(-1, width)
        return pd.DataFrame({"v": pieces(frame["row"].to_numpy(), frame["id"].to_numpy(), v)})

    asked = (
        placed.where(F.col("id") % p.every == 0)
        .select(F.pmod(F.xxhash64("row"), F.lit(query_blocks)).alias("part"), "row", "id", "packed")
        .groupBy("part").applyInPandas(load, "v binary")
    )
    # queries go to the blocks: a block of rows is moved once, row by row, however many queries there
    # are, and comes before the queries; nothing larger than a piece of queries is a row
    both = numbered.unionByName(
        asked.select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("row"), "v",
        )
    )
    pairs = both.repartition(min(blocks, 4096), "block").sortWithinPartitions("block", "asks", "id", "row")
    # roundings of a distance near zero are as large as the root of those of its square
    margin = 1e-6 * (1 + float(np.sqrt(4.0 * largest)))

    def grow(held: list[tuple[int, int, bytes]]) -> Tree:
        ids, own = np.array([i for i, _, _ in held], "<i8"), np.array([row for _, row, _ in held], "<i8")
        v = np.frombuffer(b"".join(x for _, _, x in held), short).reshape(-1, width)
        return Tree(ids, v.astype(kind), largest, p.page, own)

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, held, tree = None, [], None
        for part in parts:
            for block, asks, i, row, v in zip(*(c.to_pylist() for c in part.columns)):
                if not asks:
                    if block != loaded:
                        loaded, held, tree = block, [], None
                    held.append((i, row, v))
                    continue
                if tree is None:
                    tree, held = grow(held), []
                rows_asking, ids_asking, q = unpacked(v, width, short)
                out = []
                for r, a, x in zip(rows_asking.tolist(), ids_asking.tolist(), q.astype(kind)):
                    out += [(r, a, near, score) for score, near in tree.search(r, x, p.k, margin)]
                if out:
                    names = ["query_row", "query_id", "vec_id", "score"]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names)

    found = pairs.mapInArrow(meet, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH q AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.row, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.row <> b.row)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


@query("op3_exact_top_k", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))

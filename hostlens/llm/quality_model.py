"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document becomes one row of statistics of its characters, words and lines.
Trees grow level by level on quantile bins; the fitted forest is flattened into
arrays of features, thresholds, children and values, and a batch of documents
walks all trees in numpy, one level of all rows at a time.

Null and empty texts have all statistics zero and get a score like any other.
Labels that are null or belong to no document teach nothing; a document with
several labels counts as good only if all of them say so.  Without labels the
score is 0.5, with labels of one kind it is their smoothed share.  Other
columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from hostlens.llm.common import col, fresh, held_out, materialize, query, small_batches, table

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "spaces", "high_bytes", "full_stops", "commas",
    "exclamations", "bars", "symbols", "brackets", "at_signs", "slashes_colons", "other_punctuation", "byte_entropy",
    "distinct_words", "commonest_word", "word_entropy", "same_as_previous", "distinct_pairs", "lines_per_word",
    "repeated_lines", "longest_line", "one_letter_words", "words_ending_in_letters",
]
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(raw, np.uint8)
    h = np.bincount(data, minlength=256)
    size = len(raw)
    share = lambda chars: float(h[list(chars)].sum()) / size
    words, lines = raw.split(), [x.strip() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    n = max(1, len(words))
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    times = np.bincount(ids) if len(ids) else np.ones(1, np.int64)
    pairs = ids[:-1] * len(code) + ids[1:]
    lengths = [len(w) for w in code] or [0]
    ends = sum(int(c) for w, c in zip(code, times) if _LETTERS[w[-1]])
    return [
        np.log1p(size), np.log1p(len(words)), size / n, float(max(lengths)), float(h[65:91].sum()) / size,
        float(h[48:58].sum()) / size, share(b" \t\r\n"), float(h[128:].sum()) / size, share(b"."), share(b","), share(b"!"),
        share(b"|"), share(b"#*$%&~^"), share(b"<>[]{}()"), share(b"@"), share(b"/:"), share(b"?;'\"-_+="), _entropy(h),
        len(code) / n, float(times.max()) / n, _entropy(times), float((ids[1:] == ids[:-1]).sum()) / n,
        len(np.unique(pairs)) / max(1, len(pairs)), len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
        max(map(len, lines), default=0) / size, float(sum(int(c) for w, c in zip(code, times) if len(w) == 1)) / n, ends / n,
    ]


@dataclass(frozen=True)
class Boosting:
    """``sample_rows`` bounds the labelled documents that a forest is fitted on."""

    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    l2: float = 1.0
    min_rows: int = 8
    sample_rows: int = 20_000


@dataclass
class Forest:
    """All trees in common arrays; a leaf is its own child on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = self.child[node] + (x[rows, self.feature[node]] > self.threshold[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, p: Boosting = Boosting()) -> Forest:
    """Boosted logistic regression trees on quantile bins of ``x``."""
    feature, threshold, child, value, roots = [], [], [], [], []
    n, width = x.shape
    good = float(y.sum())
    bias = float(np.log((good + 0.5) / (n - good + 0.5)))

    def add(v: float) -> int:
        # a leaf: comparing with +inf always goes to the first child, itself
        feature.append(0), threshold.append(np.inf), child.append(len(child)), value.append(v)
        return len(child) - 1

    if n and 0 < good < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(n, bias)
        for _ in range(p.trees):
            prob = 1 / (1 + np.exp(-margin))
            grad, hess = y - prob, prob * (1 - prob)
            node = np.full(n, add(0.0))
            roots.append(int(node[0]))
            level = [roots[-1]]
            for depth in range(p.depth + 1):
                slot = np.full(len(child), -1)
                slot[level] = np.arange(len(level))
                at = slot[node]
                live = np.flatnonzero(at >= 0)
                at = at[live]
                size = len(level)
                g, h, c = (np.bincount(at, w, size) for w in (grad[live], hess[live], None))
                for k, nd in enumerate(level):
                    value[nd] = p.rate * g[k] / (h[k] + p.l2)
                if depth == p.depth or not len(live):
                    break
                best, cut, which = np.full(size, 1e-6), np.zeros(size, int), np.full(size, -1)
                base = g * g / (h + p.l2)
                for f in range(width):
                    key = at * p.bins + binned[live, f]
                    gl, hl, cl = (
                        np.bincount(key, w, size * p.bins).reshape(size, p.bins).cumsum(1)[:, :-1]
                        for w in (grad[live], hess[live], None)
                    )
                    gain = gl**2 / (hl + p.l2) + (g[:, None] - gl) ** 2 / (h[:, None] - hl + p.l2) - base[:, None]
                    gain[(cl < p.min_rows) | (c[:, None] - cl < p.min_rows)] = 0
                    top = gain.argmax(1)
                    found = gain[np.arange(size), top]
                    win = found > best
                    best[win], cut[win], which[win] = found[win], top[win], f
                following, goes = [], np.full(len(node), -1)
                for k, nd in enumerate(level):
                    if which[k] < 0:
                        continue
                    feature[nd], threshold[nd] = int(which[k]), float(edges[which[k]][cut[k]])
                    child[nd] = add(0.0)
                    following += [child[nd], add(0.0)]
                for k, nd in enumerate(level):
                    if which[k] >= 0:
                        mine = live[at == k]
                        goes[mine] = child[nd] + (binned[mine, which[k]] > cut[k])
                node = np.where(goes >= 0, goes, node)
                level = following
                if not level:
                    break
            margin = margin + np.asarray(value)[node]
    else:
        bias = bias if n else 0.0
    return Forest(
        np.asarray(feature, np.int32), np.asarray(threshold, float), np.asarray(child, np.int32), np.asarray(value, float),
        np.asarray(roots, np.int32), p.depth, bias,
    )


def train(docs: DataFrame, labels: DataFrame, p: Boosting = Boosting(), doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", parts: int = 3, out: int = 1) -> Forest:
    """A forest from the labelled documents whose crc32 modulo ``parts`` is not ``out``.

    At most ``p.sample_rows`` labels, the first in hash order, are used, so the
    list of labels can be broadcast and the statistics fit into the driver.
    """
    small_batches(docs)
    sample = materialize(
        labels.where(col(label).isNotNull() & col(doc_id).isNotNull() & ~held_out(col(doc_id), parts, out))
        .groupBy(col(doc_id).alias("id")).agg(F.min(col(label)).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(p.sample_rows),
        "label-sample",
    )

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    found = (
        docs.select(col(doc_id).alias("id"), col(text).alias("text"))
        .join(F.broadcast(sample), "id")
        .select("id", "label", measure("text").alias("x"))
        .groupBy("id").agg(F.min(F.struct("label", "x")).alias("row"))
        .select("id", "row.*").toPandas().sort_values("id")
    )
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(STATISTICS))
    return fit(x, (found["label"].to_numpy() > 0).astype(float), p)


def scored(docs: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that the quality label is 1."""
    small_batches(docs)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))
        return pd.Series(forest.score(x))

    return docs.withColumn(out, score(col(text)))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that a forest trained on ``labels`` scores ``least`` or more."""
    (score,) = fresh(docs, "score")
    forest = train(docs, labels, text=text)
    return scored(docs, forest, text, score).where(col(score) >= least).select(*map(col, docs.columns))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, forest).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

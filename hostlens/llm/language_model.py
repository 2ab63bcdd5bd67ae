"""Language model scores by a weighted backoff automaton.

Counts of words and word pairs of the training documents make an interpolated
bigram model over ``(words + end)``:

    P(v | u) = (1 - b(u)) c(u, v) / c(u) + b(u) P(v),   b(u) = 1 - w c(u) / (c(u) + k)
    P(v) = c(v) / (N + 1), and 1 / (N + 1) for all unknown words together

As an automaton, every known word u is a state with an arc for each seen pair,
weighted log10 P(v | u), and a failure arc to the root, weighted log10 b(u); the
root has an arc for each word, weighted log10 P(v).  A text is read once from
left to right: the state goes along, missing arcs follow failure arcs, and the
weights are summed.

No task or driver ever holds the model.  Documents are read in batches of a
bounded size.  A batch sends the distinct words and pairs it has, and how often
its training documents have them, to shards by hash; a shard adds up what all
batches sent and answers each with the counts of the whole corpus.  From its
answers a batch builds the part of the automaton that its texts can reach.  The
number of shards grows with the corpus.  A word or pair that is anywhere frequent
is one entry per batch, so none is hot.

Words and pairs are known by 64-bit hashes.  Null and empty texts consist of the
end alone.  A null doc_id belongs to the training part.  Repeated rows count,
and are scored, one by one.  An empty table gives an empty result; with no
training documents every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hostlens.llm.common import col, held_out, materialize, query, small_batches, table

END = b""
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Model:
    """``pair_weight`` w and ``pair_half`` k of the formula above; sizes of batches
    and shards in bytes of text."""

    pair_weight: float = 0.5
    pair_half: float = 100.0
    batch_bytes: int = 8 << 20
    batch_rows: int = 20_000
    shard_bytes: int = 8 << 20


class Batch:
    """The token stream of some documents and its distinct words and pairs."""

    def __init__(self, texts: list[bytes], training: np.ndarray, shards: int):
        code: dict[bytes, int] = {END: 0}
        stream: list[int] = []
        lengths = []
        for text in texts:
            words = text.lower().split()
            stream += [code.setdefault(w, len(code)) for w in words]
            stream.append(0)
            lengths.append(len(words) + 1)
        self.tokens = np.array(stream, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.n_words = len(code)
        in_training = np.repeat(training, self.lengths)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in code], np.uint64)
        own = np.bincount(self.tokens[in_training], minlength=self.n_words)
        inner = np.ones(len(self.tokens), bool)
        inner[self.starts] = False
        here = np.flatnonzero(inner)
        pairs = self.tokens[here - 1] * self.n_words + self.tokens[here]
        self.pairs, index = np.unique(pairs, return_inverse=True)
        own_pairs = np.bincount(index[in_training[here]], minlength=len(self.pairs))
        left, right = np.divmod(self.pairs, self.n_words)
        self.word_slot = _Slots(hashes, own, shards)
        self.pair_slot = _Slots(_joined(hashes[left], hashes[right]), own_pairs, shards)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, by multiplying and folding (odd constants are fixed)."""
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Slots:
    """Hashes and counts in order of their shard."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, shards: int):
        shard = ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort(shard, kind="stable")
        self.hashes, self.counts = hashes[self.order], counts[self.order]
        self.edges = np.searchsorted(shard[self.order], np.arange(shards + 1))

    def part(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.edges[shard], self.edges[shard + 1]
        return self.hashes[a:b], self.counts[a:b]


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, then compressed."""
    parts = []
    for a in arrays:
        kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype("u1")
        parts.append(bytes([kind.itemsize]) + len(a).to_bytes(8, "little") + a.astype(f"<u{kind.itemsize}").tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join(parts))


def _unsqueezed(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + n * width
    return out


def _packed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    sizes = np.array([len(h) for h in hashes], "<u4").tobytes()
    return sizes + b"".join(h.tobytes() for h in hashes) + _squeezed(*counts)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    a, b = np.frombuffer(blob, "<u4", 2).tolist()
    hashes = np.frombuffer(blob, np.uint64, a + b, 8)
    return [hashes[:a], hashes[a:]], _unsqueezed(blob[8 + 8 * (a + b) :])


def _batches(rows: Iterator[pd.DataFrame], model: Model) -> Iterator[tuple[int, list, list[bytes], np.ndarray]]:
    """(number, ids, texts, training) of consecutive rows; the same in every pass,
    as the number and the cut depend on the partition and its rows alone."""
    number = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[bytes] = []
    training: list[bool] = []
    size = 0
    for frame in rows:
        for doc_id, text, train in zip(frame["doc_id"], frame["text"], frame["training"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if texts and (size + len(raw) > model.batch_bytes or len(texts) >= model.batch_rows):
                yield number, ids, texts, np.array(training, bool)
                number, ids, texts, training, size = number + 1, [], [], [], 0
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            texts.append(raw)
            training.append(bool(train))
            size += len(raw)
    if texts:
        yield number, ids, texts, np.array(training, bool)


class Automaton:
    """States are numbered 0 (root) and 1 + word; arcs are sorted by (state, word)."""

    def __init__(self, batch: Batch, words: np.ndarray, pairs: np.ndarray, tokens: int, model: Model):
        self.n_words = batch.n_words
        root = np.where(words > 0, words, 1) / (tokens + 1)
        back = 1 - model.pair_weight * words / (words + model.pair_half)
        seen = pairs > 0
        left, right = np.divmod(batch.pairs[seen], batch.n_words)
        self.arc = (left + 1) * batch.n_words + right
        self.weight = np.log10((1 - back[left]) * pairs[seen] / words[left] + back[left] * root[right])
        self.root_weight = np.log10(root)
        self.fail_weight = np.concatenate(([0.0], np.log10(back)))
        self.next_state = np.where(words > 0, np.arange(1, batch.n_words + 1), 0)

    def walk(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The sum of weights of each text; all texts are read at once.

        After a token the state is that of the token, so the states of all places
        are known by shifting the tokens by one.
        """
        if not len(tokens):
            return np.zeros(0)
        state = np.concatenate(([0], self.next_state[tokens[:-1]]))
        state[starts] = 0
        key = state * self.n_words + tokens
        at = np.searchsorted(self.arc, key)
        at[at == len(self.arc)] = 0
        hit = self.arc[at] == key if len(self.arc) else np.zeros(len(key), bool)
        step = self.fail_weight[state] + self.root_weight[tokens]
        step[hit] = self.weight[at[hit]]
        return np.add.reduceat(step, starts)


def _count_shards(rows: DataFrame, model: Model) -> tuple[int, int]:
    """(training tokens, shards)."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) + 1
    n, size = rows.agg(F.sum(F.when(F.col("training"), tokens)), F.sum(F.octet_length("text"))).first()
    return n or 0, max(1, -(-(size or 0) // model.shard_bytes))


def scores(docs: DataFrame, parts: int = 7, out: int = 2, model: Model = Model(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    ``docs`` is read twice and must give the same rows in the same partitions, as
    stored tables do; a difference is an error.
    """
    small_batches(docs)
    is_out = held_out(F.col("doc_id"), parts, out)
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).withColumn("training", ~is_out)
    tokens, shards = _count_shards(rows, model)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, _, texts, training in _batches(frames, model):
            batch = Batch(texts, training, shards)
            blobs = []
            for s in range(shards):
                (wh, wc), (ph, pc) = batch.word_slot.part(s), batch.pair_slot.part(s)
                if len(wh) or len(ph):
                    blobs.append((s, number, _packed([wh, ph], [wc, pc])))
            yield pd.DataFrame(blobs, columns=["shard", "batch", "blob"])

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        sent = [_unpacked(b) for b in frame["blob"]]
        answers: list[list[np.ndarray]] = [[] for _ in sent]
        known = 0
        for kind in range(2):
            hashes = np.concatenate([h[kind] for h, _ in sent])
            counts = np.concatenate([c[kind] for _, c in sent])
            names, index = np.unique(hashes, return_inverse=True)
            total = np.bincount(index, counts, len(names)).astype(np.int64)
            known = known if kind else int(np.count_nonzero(total))
            for answer, part in zip(answers, np.split(total[index], np.cumsum([len(h[kind]) for h, _ in sent])[:-1])):
                answer.append(part)
        shard = int(frame["shard"].iloc[0])
        out = [(int(b), shard, _squeezed(*a), 0) for b, a in zip(frame["batch"], answers)]
        return pd.DataFrame([*out, (-1 - shard, shard, b"", known)], columns=["batch", "shard", "blob", "known"])

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, ids, texts, training in _batches(frames, model):
            sizes = np.array([len(t) for t in texts])
            packed = zstandard.ZstdCompressor(3).compress(b"".join(texts))
            yield pd.DataFrame([(number, ids, sizes, training, packed)], columns=["batch", "ids", "sizes", "training", "texts"])

    def walk(documents: pa.Table, answers: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return _result([*[[None] * answers.num_rows] * 5, answers["known"].to_pylist()])
        ids = documents["ids"][0].as_py()
        raw = zstandard.ZstdDecompressor().decompress(documents["texts"][0].as_py(), max(1, sum(documents["sizes"][0].as_py())))
        texts, at = [], 0
        for n in documents["sizes"][0].as_py():
            texts.append(raw[at : at + n])
            at += n
        batch = Batch(texts, np.array(documents["training"][0].as_py(), bool), shards)
        words, pairs = np.zeros(batch.n_words, np.int64), np.zeros(len(batch.pairs), np.int64)
        got = 0
        for shard, blob in zip(answers["shard"].to_pylist(), answers["blob"].to_pylist()):
            for into, slot, counts in zip((words, pairs), (batch.word_slot, batch.pair_slot), _unsqueezed(blob)):
                a, b = slot.edges[shard], slot.edges[shard + 1]
                if b - a != len(counts):
                    raise RuntimeError("the documents were not read the same way twice")
                into[slot.order[a:b]] = counts
                got += len(counts)
        if got != len(words) + len(pairs):
            raise RuntimeError("the documents were not read the same way twice")
        score = Automaton(batch, words, pairs, tokens, model).walk(batch.tokens, batch.starts)
        base = np.add.reduceat(np.log10(words + 1.0)[batch.tokens], batch.starts)
        seen = np.add.reduceat((words > 0)[batch.tokens].astype(np.int64), batch.starts)
        return _result([ids, batch.lengths, seen, base, score, [None] * len(ids)])

    def _result(values: list) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = ["doc_id", "n_tokens", "n_known", "base", "score", "known"]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, values, kinds)})

    answers = (
        rows.mapInPandas(send, "shard int, batch long, blob binary")
        .groupBy("shard").applyInPandas(add_up, "batch long, shard int, blob binary, known long")
    )
    documents = rows.mapInPandas(keep, "batch long, ids array<long>, sizes array<long>, training array<boolean>, texts binary")
    scored = materialize(
        documents.groupBy("batch").cogroup(answers.groupBy("batch"))
        .applyInArrow(walk, "doc_id long, n_tokens long, n_known long, base double, score double, known long"),
        "language-model",
    )
    distinct = scored.agg(F.sum("known")).first()[0] or 0
    return scored.where(F.col("known").isNull()).select(
        "doc_id", is_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))).alias("base_score"), "score",
    )


@query("op10_language_model")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))

"""How the tokens of two tokenizers lie over the same bytes.

Both tokenizers cut the same bytes, so what they agree on is known from the
bytes where their tokens end: a dictionary from end to index for either, their
keys intersected as hash sets, and the sorted common ends slice both lists of
ids into groups, the smallest stretches that both cut alike.  Within a group two
tokens are linked if their bytes overlap.  A group with one token on either side
links everything; otherwise a link ends wherever a token of the group ends.

``A`` is a byte-level model of the ``tokenizers`` library that reads a space and
the text; ``B`` is a sentencepiece model that adds the space itself.  Special
tokens are neither added nor recognised.

Where both models start a token at any single space after another character, the
stretches between such spaces (units) are aligned by themselves: each distinct
unit once, many in one library call, and remembered.
``Units`` checks that both models end a token where a unit ends, and encodes a
text as a whole where one of its units is not spelt by its tokens.  Models of any other kind are asked for whole texts.
  A text whose tokens do not spell
a space and the text (a mark that stands for a space, bytes replaced by
normalisation) has no tokens, nor have null and empty texts.

How often the corpus links an id of A with one of B (``pair_counts``) follows
from links counted per block of documents.  ``scored`` brings the counts back:
not link by link, but once for each pair of ids a block has; links are kept as
sorted places in the block's list of pairs.  A block holds ``BLOCK_BYTES`` of
text or one document, so what a worker holds is bounded, and a pair that occurs
everywhere is one row per block.

Rows are told apart by their place in a block, so ids may be null or repeated,
and repeated rows count as often as they occur.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hostlens.llm.common import col, fresh, materialize, query, small_batches, table
from hostlens.llm.token_counts import ByteLevel, Piecewise

BLOCK_BYTES = 4 << 20
#: text of remembered units, and units in one library call
REMEMBERED_BYTES, UNITS_AT_ONCE = 8 << 20, 4096
MARK = "▁"
_UNIT = re.compile(rf"(?<=[^\s{MARK}]) (?=[\s\S])")


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself where
    that is printable in Latin-1, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Batch:
    """Tokens of several texts one after another, their groups and links.

    ``tokens_a``, ``tokens_b``, ``groups`` and ``links`` count them per text;
    ``cut_a``, ``cut_b`` hold where each group ends in ``a``, ``b``; ``link_a``,
    ``link_b`` are places in ``a``, ``b``; ``ends`` are the groups' ends in bytes,
    counted over all texts.
    """

    a: np.ndarray
    b: np.ndarray
    tokens_a: np.ndarray
    tokens_b: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.model_a = Tokenizer.from_str(a.decode())
        self.model_a.encode_special_tokens = True
        self.model_a.no_truncation()
        self.model_a.no_padding()
        byte = byte_of_character()
        entries = self.model_a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(entries.values(), default=0) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.model_b = model = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_b = [
            bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(model.get_piece_size())
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        #: the number of an id and what follows it, by 0, 1 or 2 times ``most`` plus the id
        self.written = [f"{i}{sign}" for sign in ",|;" for i in range(self.most)]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both models; none where they do not spell a space and the text."""
        plain = [t or "" for t in texts]
        spaced = [" " + t for t in plain]
        found_a = [e.ids for e in self.model_a.encode_batch_fast(spaced, add_special_tokens=False)]
        found_b = self.model_b.encode(plain, num_threads=1)
        for i, t in enumerate(spaced):
            raw = t.encode()
            if (
                not plain[i]
                or b"".join(map(self.bytes_a.__getitem__, found_a[i])) != raw
                or b"".join(map(self.bytes_b.__getitem__, found_b[i])) != raw
            ):
                found_a[i], found_b[i] = [], []
        return found_a, found_b

    def align(self, texts: list[str | None]) -> Batch:
        found_a, found_b = self.tokens(texts)
        tokens_a, tokens_b = (np.fromiter(map(len, f), np.int64, len(f)) for f in (found_a, found_b))
        a, b = (np.fromiter(itertools.chain.from_iterable(f), np.int64, n.sum()) for f, n in ((found_a, tokens_a), (found_b, tokens_b)))
        # texts follow each other, so ends go on growing and no group reaches into the next text
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at_a, at_b = (dict(zip(e.tolist(), range(1, len(e) + 1))) for e in (ends_a, ends_b))
        common = sorted(at_a.keys() & at_b.keys())
        cut_a, cut_b = (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))
        ends = np.array(common, np.int64)
        closed = np.searchsorted(cut_a, np.cumsum(tokens_a), "right")
        groups = np.diff(closed, prepend=0)
        link_a, link_b = self._links(ends_a, ends_b, cut_a, cut_b)
        return Batch(a, b, tokens_a, tokens_b, groups, tokens_a + tokens_b - groups, cut_a, cut_b, ends, link_a, link_b)

    @staticmethod
    def _links(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked tokens, group by group.

        A group of m and n tokens has m + n - 1 links, as its inner ends all differ.
        """
        in_a, in_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        made = in_a + in_b - 1
        group = np.repeat(np.arange(len(made)), made)
        step = np.arange(len(group)) - np.repeat(np.cumsum(made) - made, made)
        link_a = (cut_a - in_a)[group] + np.minimum(step, in_a[group] - 1)
        link_b = (cut_b - in_b)[group] + np.minimum(step, in_b[group] - 1)
        mixed = (in_a > 1) & (in_b > 1)
        if mixed.any():
            stops = np.union1d(ends_a[np.repeat(mixed, in_a)], ends_b[np.repeat(mixed, in_b)])
            here = mixed[group]
            link_a[here] = np.searchsorted(ends_a, stops)
            link_b[here] = np.searchsorted(ends_b, stops)
        return link_a, link_b

    def written_groups(self, x: Batch) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        in_a, in_b = np.diff(x.cut_a, prepend=0), np.diff(x.cut_b, prepend=0)
        code_a, code_b = x.a.copy(), x.b.copy()
        code_a[x.cut_a - 1] += self.most
        code_b[x.cut_b - 1] += 2 * self.most
        codes = np.empty(len(code_a) + len(code_b), np.int64)
        codes[np.arange(len(code_a)) + np.repeat(x.cut_b - in_b, in_a)] = code_a
        codes[np.arange(len(code_b)) + np.repeat(x.cut_a, in_b)] = code_b
        signs = list(map(self.written.__getitem__, codes.tolist()))
        edges = np.concatenate(([0], np.cumsum(x.tokens_a + x.tokens_b))).tolist()
        return ["".join(signs[i:j])[:-1] for i, j in zip(edges, edges[1:])]


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... for each entry."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


class Units:
    """Distinct units with their counts (tokens of A and B, groups, links), groups and links."""

    def __init__(self, a: bytes, b: bytes):
        self.aligner = Aligner(a, b)
        self.split = _UNIT.split if ByteLevel(a).cut and Piecewise(b).cut else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.bytes, self.written = 0, []
        self.spelt, self.counts = np.zeros(0, bool), np.zeros((4, 0), np.int64)
        self.first, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, units: list[str], x: Batch, ends: np.ndarray) -> bool:
        """Takes over the alignment of one text made of ``units``, which end at ``ends``; false if they do not."""
        group = np.searchsorted(x.ends, ends) + 1
        if not len(x.ends) or group[-1] > len(x.ends) or (x.ends[group - 1] != ends).any():
            return False
        stops = np.stack([x.cut_a[group - 1], x.cut_b[group - 1], group, x.cut_a[group - 1] + x.cut_b[group - 1] - group])
        said, before = self.aligner.written_groups(x)[0].split(";"), 0
        for unit, g in zip(units, group.tolist()):
            self.at[unit] = len(self.written)
            self.written.append(";".join(said[before:g]))
            before = g
        counts = np.diff(stops, prepend=0)
        self.made.append((np.ones(len(units), bool), counts, x.a[x.link_a] << 32 | x.b[x.link_b]))
        return True

    def _alone(self, unit: str) -> None:
        x = self.aligner.align([unit])
        if not self._add([unit], x, np.array([1 + len(unit.encode())])):
            self.at[unit] = len(self.written)
            self.written.append("")
            self.made.append((np.zeros(1, bool), np.zeros((4, 1), np.int64), np.zeros(0, np.int64)))

    def learn(self, units: set[str]) -> None:
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        new = [u for u in units if u not in self.at]
        # what ends in white space or a mark would run into the next unit
        joined = [u for u in new if u and not u[-1].isspace() and u[-1] != MARK]
        for at in range(0, len(joined), UNITS_AT_ONCE):
            some = joined[at : at + UNITS_AT_ONCE]
            sizes = np.array([1 + len(u.encode()) for u in some], np.int64)
            if not self._add(some, self.aligner.align([" ".join(some)]), np.cumsum(sizes)):
                for unit in some:
                    self._alone(unit)
        for unit in new:
            if unit not in self.at:
                self._alone(unit)
        if new:
            self.bytes += sum(map(len, new))
            spelt, counts, pairs = zip(*self.made)
            self.spelt = np.concatenate((self.spelt, *spelt))
            self.counts = np.concatenate((self.counts, *counts), axis=1)
            self.pairs = np.concatenate((self.pairs, *pairs))
            self.first = np.cumsum(self.counts[3]) - self.counts[3]

    def place(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and how many each text has."""
        if self.bytes > REMEMBERED_BYTES:
            self.forget()
        cut = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        places = [list(map(self.at.__getitem__, units)) for units in cut]
        whole = [i for i, p in enumerate(places) if len(p) > 1 and not self.spelt[p].all()]
        self.learn({texts[i] for i in whole})
        for i in whole:
            places[i] = [self.at[texts[i]]]
        sizes = np.fromiter(map(len, places), np.int64, len(places))
        return np.fromiter(itertools.chain.from_iterable(places), np.int64, sizes.sum()), sizes


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))


def aligned(docs: DataFrame, a: bytes, b: bytes, text: str = "text", out: str = "groups") -> DataFrame:
    """``docs`` with an array of groups: ids of A, ids of B, and the bytes of the
    text they cover (the first group starts at the space that stands before it: -1)."""
    small_batches(docs)

    @F.arrow_udf("array<struct<a:array<int>,b:array<int>,first:long,end:long>>")
    def groups(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = Aligner(a, b)
        for texts in batches:
            x = aligner.align(texts.to_pylist())
            in_a, in_b = np.diff(x.cut_a, prepend=0), np.diff(x.cut_b, prepend=0)
            last = np.cumsum(x.groups)
            before = np.concatenate(([0], x.ends))[last - x.groups]  # bytes of earlier texts
            end = x.ends - np.repeat(before, x.groups) - 1
            first = np.concatenate(([0], x.ends))[:-1] - np.repeat(before, x.groups) - 1
            rows = pa.StructArray.from_arrays(
                [_lists(x.a.astype(np.int32), in_a), _lists(x.b.astype(np.int32), in_b), pa.array(first), pa.array(end)],
                ["a", "b", "first", "end"],
            )
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], last)).astype(np.int32)), rows)

    (name,) = fresh(docs, out)
    return docs.withColumn(name, groups(col(text)))


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCK = f"block long, {_COUNTS}, steps array<int>, pairs array<long>, times array<long>"


class _Block:
    """Documents whose links are kept as places in one sorted list of pairs."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.ids: list[pa.Array] = []
        self.counts: list[list[np.ndarray]] = []
        self.digests: list[str] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, units: Units, ids: pa.Array, texts: pa.Array) -> None:
        self.bytes += texts.nbytes
        place, sizes = units.place(texts.to_pylist())
        owner = np.repeat(np.arange(len(ids)), sizes)
        counts = np.zeros((4, len(ids)), np.int64)
        for into, each in zip(counts, units.counts):
            np.add.at(into, owner, each[place])
        self.ids.append(ids)
        self.counts.append(list(counts))
        said, edges = list(map(units.written.__getitem__, place.tolist())), np.concatenate(([0], np.cumsum(sizes))).tolist()
        for i, j in zip(edges, edges[1:]):
            text = ";".join(said[i:j])
            self.digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        used, again = np.unique(place, return_inverse=True)
        links = units.counts[3][used]
        pairs, code = np.unique(units.pairs[_ragged(units.first[used], links)], return_inverse=True)
        first = np.cumsum(links) - links
        key = np.repeat(owner, links[again]) * max(1, len(pairs)) + code[_ragged(first[again], links[again])]
        key.sort()
        self.parts.append((pairs, (key % max(1, len(pairs))).astype(np.int32)))

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        counts = [np.concatenate(c) for c in zip(*self.counts)]
        pairs = np.unique(np.concatenate([p for p, _ in self.parts]))
        place = np.concatenate([np.searchsorted(pairs, p).astype(np.int32)[x] for p, x in self.parts])
        times = np.bincount(place, minlength=len(pairs))
        links, n = counts[3], len(self.digests)
        first = (np.cumsum(links) - links)[links > 0]
        steps = np.diff(place, prepend=np.int32(0))
        steps[first] = place[first]
        own = np.zeros(n, np.int64)
        own[0] = len(pairs)  # the pairs stand in the block's first row
        columns = [
            pa.array(np.full(n, self.number)), pa.chunked_array(self.ids).combine_chunks(), *map(pa.array, counts),
            pa.array(self.digests, pa.string()), _lists(steps, links), _lists(pairs, own), _lists(times, own),
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def blocks(docs: DataFrame, a: bytes, b: bytes, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: block, doc_id, counts, the steps between the sorted places
    of its links in the block's pairs; the block's first row also has the pairs, A's
    id in the upper and B's in the lower 32 bits, and how often the block links them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs)
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    first, *rest = StructType.fromDDL(_BLOCK).fields
    kind = StructType([first, rows.schema["doc_id"], *rest])
    schema = to_arrow_schema(kind)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(a, b)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            if not batch.num_rows:
                continue
            block.add(units, batch.column(0), batch.column(1))
            if block.bytes >= block_bytes:
                yield from block.rows(schema)
                block = _Block(block.number + 1)
        if block.ids:
            yield from block.rows(schema)

    return rows.mapInArrow(walk, kind)


def _block_pairs(made: DataFrame) -> DataFrame:
    """(block, place, pair, times): what each block links."""
    return made.where("pairs IS NOT NULL AND size(pairs) > 0").select(
        "block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p")
    ).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, n, best): links of two ids in all ``blocks``; ``best`` where no id of A
    is linked with that id of B more often."""
    counts = materialize(_block_pairs(made).groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    own = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    # one row per id of B, so as many as its vocabulary has
    most = materialize(counts.groupBy(own).agg(F.max("n").alias("most")), "most-linked")
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), own, "n").join(F.broadcast(most), "b").select(
        "a", F.col("b").cast("int").alias("b"), "n", (F.col("n") == F.col("most")).alias("best")
    )


def scored(docs: DataFrame, a: bytes, b: bytes, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links
    to the id of A that the corpus links most with their id of B) and count_sum."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = materialize(blocks(docs, a, b, doc_id, text, block_bytes), "alignment-blocks")
    # written, so that both sides of the join are plain shuffles and a common pair can be split
    counts = materialize(
        pair_counts(made).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n", "best"), "pair-table"
    )
    known = _block_pairs(made).drop("times").join(counts, "pair").select(F.col("block").alias("of"), "place", "n", "best")
    kept = made.drop("pairs", "times")
    out = StructType([*kept.schema.fields[1:-1], *StructType.fromDDL("n_best long, count_sum long").fields])
    schema, same = to_arrow_schema(out), kept.columns[1:-1]

    def weigh(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        n, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        place = pairs["place"].to_numpy()
        n[place], best[place] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
        links = rows["n_links"].to_numpy()
        steps = rows["steps"].combine_chunks().flatten().to_numpy().astype(np.int64)
        run = np.cumsum(steps)
        first = (np.cumsum(links) - links)[links > 0]
        at = run - np.repeat(run[first] - steps[first], links[links > 0])
        sums = np.zeros((2, len(links)), np.int64)
        if len(first):
            for i, weight in enumerate((best, n)):
                sums[i, links > 0] = np.add.reduceat(weight[at], first)
        columns = [*map(rows.column, same), *map(pa.array, sums)]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return kept.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(weigh, out)


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (read_bytes(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return scored(table(spark, sf_dir, "documents"), a, b)

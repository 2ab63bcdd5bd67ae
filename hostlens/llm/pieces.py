"""SentencePiece encoding with byte offsets, and decoding.

Normalisation replaces the longest prefix that the model's compiled character
map knows, again and again, and writes down for every normalised character
where in the source it came from.  Pieces are found by merging on the normalised
text; projecting their borders through the alignment gives the bytes of the
original text that each piece covers.

Merging never crosses from another character to a white space mark when no
piece of the vocabulary does, so texts are merged word by word and words are
remembered; a model with such a piece is merged over whole texts.

Null counts as empty; an empty text has no pieces, only the end id if asked for.
Texts may be of any length.  Byte pieces of one character share its place: all
but the last cover no bytes.  Other columns pass through.  Only BPE models with
byte fallback, without user-defined or unused pieces, are supported; others
raise ValueError.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostlens.llm.common import col, fresh, query, small_batches, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def default_model() -> bytes:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, whose values point
    at zero-terminated replacements."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key at a place."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.replacements[start : self.replacements.index(b"\0", start)]


@dataclass
class Rules:
    """How a model normalises; ``charmap`` None maps every character to itself."""

    charmap: CharacterMap | None
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters the byte of the
        source where it starts, with the end as a last entry."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.charmap is None and not self.trim_spaces:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF))
            prefix = [0] * (1 + self.dummy_prefix)
            text = " " * self.dummy_prefix + text
            return text.replace(" ", MARK) if self.escape_spaces else text, np.concatenate((prefix, ends))
        raw = text.encode("utf-8", "surrogatepass")
        chunks, total = list(self._replaced(raw)), len(raw)
        if self.trim_spaces:
            chunks, total = self._trimmed(chunks, total)
            if not chunks:
                return "", np.array([total])
        out, starts = [], []
        if self.dummy_prefix:
            out.append(" ")
            starts.append(chunks[0][0] if chunks else 0)
        for at, chunk in chunks:
            out.append(chunk)
            starts += [at] * len(chunk)
        normal = "".join(out)
        return normal.replace(" ", MARK) if self.escape_spaces else normal, np.array([*starts, total])

    def _replaced(self, raw: bytes) -> Iterator[tuple[int, str]]:
        at = 0
        while at < len(raw):
            hit = self.charmap.longest(raw, at) if self.charmap else None
            if hit is None:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, raw[at : at + size]
            yield at, hit[1].decode()
            at += hit[0]

    def _trimmed(self, chunks: list[tuple[int, str]], total: int) -> tuple[list[tuple[int, str]], int]:
        """Without leading, trailing and repeated spaces, and where the source then ends."""
        out, after_space = [], True
        for at, chunk in chunks:
            if after_space:
                chunk = chunk.lstrip(" ")
            if chunk:
                out.append((at, chunk))
                after_space = chunk.endswith(" ")
        if not out:
            return [], 0
        spaces = f" {MARK}" if self.escape_spaces else " "
        while out and out[-1][1][-1] in spaces:
            total, chunk = out.pop()
            if chunk := chunk.rstrip(spaces):
                out.append((total, chunk))
        return out, total


class Merges:
    """All merges of a vocabulary as sorted pairs of symbols, for many words at once.

    Symbols are ids of pieces, and numbers beyond them for single characters that
    are only parts of pieces.
    """

    NONE = 1 << 30

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(ids) + 1000 + len(symbols))
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        levels = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        found = []
        for p, score in scores.items():
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, levels[score], ids[p]))
        found.sort()
        self.pairs, self.ranks, self.made = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of pairs; rank ``NONE`` if they do not merge."""
        if not len(self.pairs):
            return np.full(len(left), self.NONE), np.zeros(len(left), np.int64)
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.ranks[at], self.NONE), self.made[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, symbol, characters) after merging; ``word`` numbers the words in order.

        Each round merges the best pair of every word, of equal ones the leftmost,
        and looks up only the two pairs that are new.  Finished words leave.
        """
        size = np.ones(len(symbols), np.int64)
        done = []
        rank, made = self.look(symbols[:-1], symbols[1:])
        rank, made = np.append(rank, self.NONE), np.append(made, 0)
        rank[:-1][word[1:] != word[:-1]] = self.NONE
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(symbols)), first)
            alive = best >> 32 < self.NONE
            at = best[alive] & 0xFFFFFFFF
            symbols[at] = made[at]
            size[at] += size[at + 1]
            stays = np.repeat(alive, np.diff(np.append(first, len(symbols))))
            if not alive.all():
                done.append((word[~stays], symbols[~stays], size[~stays]))
            # the pair after a merged one starts at its place now, and both sides are new
            rank[at] = self.NONE
            new = np.zeros(len(symbols) + 1, bool)
            new[at] = True
            stays[at + 1] = False
            symbols, size, word, rank, made, new = (x[stays] for x in (symbols, size, word, rank, made, new[:-1]))
            new[:-1] |= new[1:]
            near = np.flatnonzero(new[:-1] & (word[1:] == word[:-1]))
            rank[near], made[near] = self.look(symbols[near], symbols[near + 1])
        if not done:
            return word, symbols, size
        word, symbols, size = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return word[order], symbols[order], size[order]


class Pieces:
    """One model: encoder and decoder."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = {p.type for p in proto.pieces}
        trainer, normal = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models of normal, control and byte pieces are supported")
        self.rules = Rules(
            CharacterMap(normal.precompiled_charsmap) if normal.precompiled_charsmap else None,
            normal.add_dummy_prefix, normal.remove_extra_whitespaces, normal.escape_whitespaces,
        )
        self.score, self.id, self.byte_id = {}, {}, [0] * 256
        self.surface, self.marked, self.control = [], [], set()
        self.unknown, self.end, fallback = 0, 2, BYTE in kinds
        for i, p in enumerate(proto.pieces):
            out = b""
            if p.type == NORMAL:
                self.score[p.piece], self.id[p.piece] = p.score, i
                out = p.piece.replace(MARK, " ").encode()
            elif p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_id[value], out = i, bytes([value])
            elif p.type == UNKNOWN:
                self.unknown, out = i, trainer.unk_surface.encode()
            else:
                self.control.add(i)
                if p.piece == trainer.eos_piece:
                    self.end = i
            self.surface.append(out)
            self.marked.append(p.type == NORMAL and p.piece.startswith(MARK))
        if not fallback:
            raise ValueError("only models with byte fallback are supported")
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        # nothing merges with a character that is in no piece
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.id))
        words = f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")
        self.words = re.compile("(?s).+" if crossing else words).findall
        self.merges = Merges(self.id, self.score)
        #: words and their pieces, as (id, characters) pairs of int32 in bytes
        self.memory: dict[str, bytes] = {}

    def learn(self, words: set[str], most: int = 120_000, longest: int = 64) -> dict[str, bytes]:
        """Remembers words; words with rare characters, and very long ones, go one by
        one, and the latter are only returned."""
        if len(words - self.memory.keys()) + len(self.memory) > most:
            self.memory.clear()
        words = words - self.memory.keys()
        rare = {w for w in words if len(w) > longest}
        plain = list(words - rare)
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, lengths = self.merges.of_char[codes], np.array([len(w) for w in plain], np.int64)
        number = np.repeat(np.arange(len(plain)), lengths)
        odd = np.zeros(len(plain), bool)
        odd[number[symbols < 0]] = True
        odd[number[symbols >= len(self.surface)]] = True
        usual = ~odd[number]
        word, symbols, size = self.merges.merge(symbols[usual], number[usual])
        raw = np.column_stack((symbols, size)).astype(np.int32).tobytes()
        edge = np.searchsorted(word, np.arange(len(plain) + 1)) * 8
        for i, w in enumerate(plain):
            self.memory[w] = self._merged(w) if odd[i] else raw[edge[i] : edge[i + 1]]
        return {w: self._merged(w) for w in rare}

    def _merged(self, word: str) -> bytes:
        """Best-scoring neighbours are merged first, of equal ones the leftmost."""
        part = self._merged_long(word) if len(word) > 64 else self._merged_short(word)
        out: list[int] = []
        for p in part:
            known = self.id.get(p)
            if known is not None:
                out += (known, len(p))
            else:
                ids = [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")]
                for i in ids[:-1]:
                    out += (i, 0)
                out += (ids[-1], len(p))
        return array("i", out).tobytes()

    def _merged_short(self, word: str) -> list[str]:
        part, get, none = list(word), self.score.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(part, part[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            part[i] += part.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = get(part[i - 1] + part[i], none)
            if i < len(scores):
                scores[i] = get(part[i] + part[i + 1], none)
        return part

    def _merged_long(self, word: str) -> list[str]:
        """The same with a heap of neighbours, for long words."""
        part, get = list(word), self.score.get
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                both = part[left] + part[right]
                score = get(both)
                if score is not None:
                    heapq.heappush(heap, (-score, left, right, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not part[left] or not part[right] or len(part[left]) + len(part[right]) != size:
                continue
            part[left] += part[right]
            part[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in part if p]

    def encode(self, text: str | None, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the end of what each covers in ``text``."""
        return self.encode_all([text], end)[0]

    def encode_all(self, texts: list[str | None], end: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of many texts, whose new words are merged together."""
        normal = [self.rules.apply(t or "") for t in texts]
        split = [self.words(n) for n, _ in normal]
        rare, out = self.learn(set().union(*split)), []
        find = self.memory.__getitem__ if not rare else lambda w: self.memory.get(w) or rare[w]
        for words, (_, align) in zip(split, normal):
            both = np.frombuffer(b"".join(map(find, words)), np.int32).reshape(-1, 2)
            stops = np.cumsum(both[:, 1])
            ids, starts, stops = both[:, 0], align[stops - both[:, 1]], align[stops]
            if end:
                ids, starts, stops = np.append(ids, self.end), np.append(starts, align[-1]), np.append(stops, align[-1])
            out.append((ids, starts, stops))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that make no character become U+FFFD each."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        codecs.register_error("each", lambda e: ("�" * (e.end - e.start), e.end))
        if not self.control.isdisjoint(ids[:-1]):
            # bytes on both sides of a control piece make no character
            runs = itertools.groupby(ids, self.control.__contains__)
            raw = "".join(
                b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "each") for control, run in runs if not control
            ).encode()
        if self.rules.dummy_prefix or self.rules.trim_spaces:
            first = next((i for i in ids if self.surface[i]), None)
            if first is not None and self.marked[first]:
                raw = raw.lstrip(b" ") if self.rules.trim_spaces else raw[1:]
        return raw.decode("utf-8", "each")


def encode_column(text: Column, model: bytes, end: bool = True, decoded: bool = False) -> Column:
    """struct(ids, starts, ends) of a text column; with ``decoded`` also what the ids
    decode to."""

    @F.arrow_udf("struct<ids:array<int>,starts:array<long>,ends:array<long>" + (",decoded:string>" if decoded else ">"))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(model)
        for texts in batches:
            found = pieces.encode_all(texts.to_pylist(), end)
            edges = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
            fields = []
            for i, kind in enumerate((np.int32, np.int64, np.int64)):
                flat = np.concatenate([f[i] for f in found]) if found else np.zeros(0)
                fields.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(kind))))
            if decoded:
                fields.append(pa.array([pieces.decode(f[0].tolist()) for f in found], pa.string()))
            yield pa.StructArray.from_arrays(fields, ["ids", "starts", "ends", "decoded"][: len(fields)])

    return encode(text)


def decode_column(ids: Column, model: bytes) -> Column:
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(model)
        for arrays in batches:
            yield pa.array([pieces.decode(a or []) for a in arrays.to_pylist()], pa.string())

    return decode(ids)


def encoded(docs: DataFrame, model: bytes, text: str = "text", end: bool = True) -> DataFrame:
    """``docs`` with ids, starts and ends; where a name is taken, underscores are added."""
    small_batches(docs)
    ids, starts, ends, both = fresh(docs, "ids", "starts", "ends", "_pieces")
    found = docs.withColumn(both, encode_column(col(text), model, end))
    return found.select(
        *map(col, docs.columns),
        *[col(both)[c].alias(name) for c, name in (("ids", ids), ("starts", starts), ("ends", ends))],
    )


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(docs)
    both = docs.select("doc_id", encode_column(F.col("text"), default_model(), decoded=True).alias("p"))
    return both.select(
        "doc_id",
        F.size("p.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("p.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("p.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

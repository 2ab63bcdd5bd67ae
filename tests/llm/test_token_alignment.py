"""Alignment of two tokenizers against a walk over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF
from hostlens.llm import token_alignment as T

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
MODELS = [T.read_bytes(p) for p in PATHS]
ALPHABET = list("abtionr12 \n\t'é☃😀​你.") + ["the ", "ing", " in", "<|endoftext|>", "</s>", "<0x0A>", "ation"]


def texts():
    rnd = random.Random(11)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 120))) for _ in range(150)]
    return [None, "", " ", "a", "has ▁ mark", "\x00", "x" * 3000, "😀☃" * 50, *made, made[0], made[0]]


class Plain:
    """The contract, one token and one byte at a time."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        more = iter(range(256, 512))
        self.byte = {chr(x if x in plain else next(more)): x for x in range(256)}

    @staticmethod
    def owners(pieces):
        """For each byte, the number of the token it belongs to."""
        return [i for i, p in enumerate(pieces) for _ in p]

    def one(self, text):
        """(ids of A, ids of B, groups, links as pairs of ids)"""
        raw = (" " + (text or "")).encode()
        ids_a = self.a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = self.b.encode(text or "")
        bytes_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in ids_a]
        bytes_b = [
            bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return [], [], [], []
        own_a, own_b = self.owners(bytes_a), self.owners(bytes_b)
        both = list(dict.fromkeys(zip(own_a, own_b)))
        links = [(ids_a[x], ids_b[y]) for x, y in both]
        groups, x, y = [], 0, 0
        for i, (p, q) in enumerate(zip(own_a, own_b), 1):
            if i == len(raw) or (own_a[i] != p and own_b[i] != q):
                groups.append((ids_a[x : p + 1], ids_b[y : q + 1]))
                x, y = p + 1, q + 1
        return ids_a, ids_b, groups, links


def expected(rows):
    plain = Plain()
    found = [(i, *plain.one(t)) for i, t in rows]
    counts = Counter(p for *_, links in found for p in links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for i, a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            i, len(a), len(b), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if said else "",
            sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
        ))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("block_bytes", [1, 2000, 8 << 20])
def test_scores(spark, block_bytes):
    rows = [(None if i % 17 == 0 else i // 2, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("block", T.F.lit("x")).withColumn("n_a", T.F.lit(1.5))
    got = T.scored(docs.repartition(3), *MODELS, block_bytes=block_bytes).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def test_some_groups_are_mixed():
    x = T.Aligner(*MODELS).align(texts())
    in_a, in_b = (T.np.diff(c, prepend=0) for c in (x.cut_a, x.cut_b))
    assert ((in_a > 1) & (in_b > 1)).any()


def test_groups_and_spans(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("groups", T.F.lit(0))
    plain = Plain()
    got = {r.doc_id: r._groups for r in T.aligned(docs, *MODELS).collect()}
    for i, t in rows:
        _, _, groups, _ = plain.one(t)
        assert [(g.a, g.b) for g in got[i]] == groups
        raw, at = (t or "").encode(), -1
        for g in got[i]:
            assert g.first == at < g.end <= len(raw)
            at = g.end
        assert not groups or at == len(raw)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.scored(docs, *MODELS).columns == COLUMNS and T.scored(docs, *MODELS).count() == 0
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in T.scored(only_null, *MODELS).collect()] == [(1, 0, 0, 0, 0, "", 0, 0)]


def test_query(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in T.op12(spark, SF).select(*COLUMNS).collect()}
    assert sorted(got.values()) == sorted(expected(docs))

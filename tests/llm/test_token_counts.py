"""Token counts against the libraries."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hostlens.llm import token_counts as T

JSON, WORDS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = list("ab12 \n\t'.,;!?é☃😀▁\x1c\x85​　你好。，") + ["'s", "'ll", "  ", "<|endoftext|>", "</s>", "the ", "word "]


def library(path):
    if path.endswith(".json"):
        model = Tokenizer.from_file(path)
        return lambda t: len(model.encode(t, add_special_tokens=False).ids)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(model.encode(t))


def texts(seed=3):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    return ["", " ", "x" * 5000, "<|endoftext|>" * 200, "a<|endoftext|> b" * 99, " " * 999, "你好。" * 500, "q w" * 2000, *made]


@pytest.mark.parametrize("path", [JSON, WORDS, MODEL])
@pytest.mark.parametrize("most", [1, 7, 64, 1 << 15])
def test_cut_texts_have_the_tokens_of_whole_ones(path, most):
    model, want = T.load(*T.read_tokenizer(path)), library(path)
    assert (model.cut is None) == (path == WORDS)
    assert T.count(model, texts(), most, 500).tolist() == [want(t) for t in texts()]


def test_parts_are_small_and_whole():
    model = T.load(*T.read_tokenizer(JSON))
    text = "some words, and more of them\n" * 10_000
    cut = list(T.parts(text, model.cut, 0, 1000))
    assert "".join(cut) == text and max(map(len, cut)) < 1020


def test_calls_are_balanced():
    import numpy as np

    sizes = np.array([1] * 1000 + [500] * 10 + [1] * 1000)
    slices = T.calls(sizes, 700)
    assert [a for a, _ in slices[1:]] == [b for _, b in slices[:-1]] and slices[-1][1] == len(sizes)
    assert max(sizes[a:b].sum() for a, b in slices) <= 1200
    assert T.calls(sizes[:0]) == [] and T.calls(np.zeros(3)) == [(0, 3)]


def test_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "hello <|endoftext|> world", None), (2, "long word " * 30_000, "c"), (2, "long word " * 30_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = T.counted(docs, JSON)
    assert out.columns == ["doc_id", "text", "n_tokens", "n_bytes", "_n_tokens", "over_limit"]
    want = library(JSON)
    got = sorted((r.doc_id or 0, r.n_bytes, r._n_tokens, r.over_limit) for r in out.collect())
    assert got == sorted((i or 0, len((t or "").encode()), want(t or ""), want(t or "") > 512) for i, t, _ in rows)
    assert T.counted(docs.limit(0), MODEL).count() == 0


def test_unknown_file():
    with pytest.raises(ValueError):
        T.read_tokenizer("vocabulary.txt")


def test_query(spark):
    from conftest import SF

    want = library(JSON)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, T.op11(spark, SF).collect()))
    assert got == sorted((d.doc_id, len(d.text.encode()), want(d.text), want(d.text) > 512) for d in docs)

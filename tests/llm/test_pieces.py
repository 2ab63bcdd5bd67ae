"""SentencePiece encoding against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from hostlens.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab ▁\n\té☃😀<s></s>ſﬁ́　\x00�"
TEXTS = [
    "", " ", "  a  b ", "▁", "▁▁ ab", "<0x0A></s><s>", "x" * 5000, " a" * 3000, "▁" * 100, "é☃\n", "Hello, wörld! 你好\r\n",
    "word " * 20_000, "q" * 65 + " " + "z" * 64,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return P.Pieces(P.read_model(PATH))


def texts():
    rnd = random.Random(7)
    return TEXTS + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(400)]


def test_ids_offsets_and_decoding(own, library):
    for t in texts():
        ids, starts, ends = own.encode(t)
        assert ids.tolist() == library.encode(t, add_eos=True)
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())
        said = library.encode(t, return_type="proto").pieces
        assert [(p.begin, p.end) for p in said] == list(zip(starts.tolist(), ends.tolist()))[:-1]
        assert starts[-1] == ends[-1] == len(t.encode())


def test_short_and_long_merging_agree(own):
    rnd = random.Random(3)
    for _ in range(300):
        word = "".join(rnd.choice("abcdeé▁tion") for _ in range(rnd.randint(1, 64)))
        assert own._merged_short(word) == own._merged_long(word)


def test_decoding_of_any_ids(own, library):
    rnd = random.Random(5)
    for _ in range(2000):
        ids = [rnd.randint(0, 258) if rnd.random() < 0.5 else rnd.randint(3, 31_999) for _ in range(rnd.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("dummy", [True, False])
@pytest.mark.parametrize("trim", [True, False])
def test_character_map(rule, dummy, trim):
    normalizer = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=trim, escape_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    spec = proto.normalizer_spec
    rules = P.Rules(P.CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None, dummy, trim, True)
    for t in [x for x in texts() if len(x) < 100]:
        normal, offsets = normalizer.normalize(t, with_offsets=True)
        mine, align = rules.apply(t)
        assert mine == normal
        raw = t.encode()
        assert [len(raw[:a].decode(errors="replace")) for a in align] == list(offsets)


def test_words_merged_together_agree_with_words_merged_alone():
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abcdeéღ▁tionst😀") for _ in range(rnd.randint(1, 70))) for _ in range(2000)}
    p = P.Pieces(P.read_model(PATH))
    found = p.learn(words)
    assert all((p.memory.get(w) or found[w]) == p._merged(w) for w in words)
    assert all(len(w) <= 64 for w in p.memory)


def test_memory_is_bounded(own):
    for i in range(30):
        own.learn({f"▁w{i}x{k}" for k in range(20)}, most=100)
        assert len(own.memory) <= 120
        assert own.memory[f"▁w{i}x3"] == own._merged(f"▁w{i}x3")


def test_other_models_are_refused():
    proto = pb.ModelProto()
    proto.ParseFromString(P.read_model(PATH))
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        P.Pieces(proto.SerializeToString())


def test_on_a_table(spark, library):
    rows = [(1, "some text", 9), (1, "some text", 9), (None, None, 9), (2, "", 9), (3, "é\n" * 2000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = P.encoded(df, P.read_model(PATH))
    assert out.columns == ["doc_id", "text", "ids", "_ids", "starts", "ends"]
    got = out.collect()
    assert [r._ids for r in got] == [library.encode(t or "", add_eos=True) for _, t, _ in rows]
    raw = rows[4][1].encode()
    assert b"".join(raw[a:b] for a, b in zip(got[4].starts, got[4].ends)) == raw
    assert P.encoded(df.limit(0), P.read_model(PATH)).count() == 0


def test_query(spark, tmp_path, library):
    rows = [(1, "Some text."), (2, None), (None, "x y"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = P.op2(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want

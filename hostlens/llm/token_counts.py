"""Token counts of whole texts, without the tokens.

An Arrow function takes a batch of texts and gives two numbers for each: its
UTF-8 bytes and its tokens.  Within a batch the work is dealt by bytes, not by
rows: texts are packed into library calls of nearly equal size, and a long text
is cut into parts that are encoded in several calls and added up, so neither a
crowd of short texts nor one very long text decides what a call holds.

A cut is made only where no token can reach across it:

* byte-level models that split with the usual pattern (contractions, letters,
  digits, other signs, white space) start a new piece wherever white space
  follows a letter or digit, and wherever certain punctuation does; what
  stands before or after is then split as it would be in the whole text;
* sentencepiece models mark a word's start.  A single space between two ASCII
  letters or digits is such a start: the text after it, without the space, gets
  the same mark as dummy prefix.  This holds where no piece runs into a mark and
  normalisation changes nothing.

Models of any other kind, and texts without such a place, are encoded whole.

Null counts as empty; an empty text has no bytes and no tokens.  Strings of
special tokens inside a text are handled as each library does by default;
nothing is added, truncated or padded.  Other columns pass through, whatever
they are called; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostlens.llm.common import col, fresh, query, small_batches, table

MARK = "▁"
#: bytes of one library call, and characters after which a text is cut at the next place
CALL_BYTES, PART_CHARS = 1 << 17, 1 << 15
#: tokens beyond which a document does not fit a context
LIMIT = 512
# white space after a letter or digit; punctuation after one that every version of Unicode calls so
_BYTE_LEVEL_CUT = re.compile(
    r"[^\W_](?=[ \t\r\n])|[0-9A-Za-zぁ-ゖァ-ヺ一-龥가-힣](?=[,.;:!?，。、；：！？])"
)
_PIECE_CUT = re.compile(r"[0-9A-Za-z](?= [0-9A-Za-z])")


def read_tokenizer(path: str) -> tuple[str, bytes]:
    """Kind (``json`` or ``model``) and content of a tokenizer file."""
    kind = path.rpartition(".")[2]
    if kind not in ("json", "model"):
        raise ValueError(f"neither a .json nor a .model file: {path}")
    with open(path, "rb") as f:
        return kind, f.read()


class ByteLevel:
    """A model of the ``tokenizers`` library."""

    skips = 0

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(content.decode())
        self.model.no_truncation()
        self.model.no_padding()
        said = json.loads(content)
        before = said["pre_tokenizer"] or {}
        usual = (
            said["normalizer"] is None and said["model"]["type"] == "BPE"
            and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        )
        whole = all(
            not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and not re.search(r"[\s,.;:!?，。、；：！？]", t["content"])
            for t in said["added_tokens"]
        )
        self.cut = _BYTE_LEVEL_CUT if usual and whole else None

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Piecewise:
    """A model of the ``sentencepiece`` library."""

    #: characters left out at a cut
    skips = 1

    def __init__(self, content: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        proto = pb.ModelProto()
        proto.ParseFromString(content)
        normal, trainer = proto.normalizer_spec, proto.trainer_spec
        # 1 to 3 and 6 are normal, unknown, control and byte pieces; 2 is BPE
        separate = trainer.model_type == 2 and all(
            p.type in (1, 2, 3, 6) and (p.type != 1 or not re.search(f"[^{MARK}]{MARK}", p.piece)) for p in proto.pieces
        )
        same = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces
        marked = normal.add_dummy_prefix and normal.escape_whitespaces and not trainer.treat_whitespace_as_suffix
        self.cut = _PIECE_CUT if separate and same and marked else None

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.model.encode(texts, num_threads=1)))


def load(kind: str, content: bytes) -> ByteLevel | Piecewise:
    return {"json": ByteLevel, "model": Piecewise}[kind](content)


def parts(text: str, cut: re.Pattern | None, skips: int = 0, most: int = PART_CHARS) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut where ``cut`` allows it."""
    at = 0
    while cut is not None and len(text) - at > most:
        place = cut.search(text, at + most)
        if place is None:
            break
        yield text[at : place.end()]
        at = place.end() + skips
    yield text[at:]


def calls(sizes: np.ndarray, most: int = CALL_BYTES) -> list[tuple[int, int]]:
    """Slices of rows with nearly equal sums of sizes, of about ``most`` each."""
    if not len(sizes):
        return []
    ends = np.cumsum(sizes)
    share = ends[-1] / max(1, round(ends[-1] / most))
    number = ((ends - sizes / 2) // share).astype(np.int64) if share else np.zeros(len(sizes), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    return list(zip(edges, edges[1:]))


def count(model: ByteLevel | Piecewise, texts: list[str], most: int = PART_CHARS, call: int = CALL_BYTES) -> np.ndarray:
    """Tokens of each text."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for p in parts(t, model.cut, model.skips, most) if len(t) > most else (t,):
            if p:
                pieces.append(p)
                owner.append(i)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    found = [n for a, b in calls(sizes, call) for n in model.lengths(pieces[a:b])]
    return np.bincount(np.array(owner, np.int64), np.array(found, np.int64), len(texts)).astype(np.int64)


def count_column(text: Column, kind: str, content: bytes) -> Column:
    """struct(n_bytes, n_tokens) of a text column."""

    @F.arrow_udf("struct<n_bytes:long,n_tokens:long>")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(kind, content)
        for texts in batches:
            texts = texts.fill_null("")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            n_tokens = pa.array(count(model, texts.to_pylist()), pa.int64())
            yield pa.StructArray.from_arrays([n_bytes, n_tokens], ["n_bytes", "n_tokens"])

    return lengths(text)


def counted(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; where a name is taken,
    underscores are added."""
    small_batches(docs)
    n_bytes, n_tokens, over, both = fresh(docs, "n_bytes", "n_tokens", "over_limit", "_lengths")
    found = docs.withColumn(both, count_column(col(text), *read_tokenizer(path)))
    return found.select(
        *map(col, docs.columns),
        col(both)["n_bytes"].alias(n_bytes),
        col(both)["n_tokens"].alias(n_tokens),
        (col(both)["n_tokens"] > limit).alias(over),
    )


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")

"""Encoding a corpus with a byte-level BPE vocabulary through sentencepiece.

A sentencepiece BPE model is serialised straight from the rank file: each piece is the token's bytes mapped
to one character a byte, its score the negative rank, with identity normalisation. Texts are cut into
pre-tokens in the JVM; Python sees them as Arrow arrays, encodes each distinct pre-token once and gathers
the ids with numpy.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.session import prepare

#: Folder of the vocabulary files; a parameter everywhere, this is only the default.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the public pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes b stand as the character FIRST + b, so that no byte is white space or sentencepiece's own marker.
FIRST = 0x100
#: Distinct pre-tokens kept by a worker; beyond it the cache starts anew, so memory is bounded.
CACHE = 200_000
_TO_CHARS = {b: FIRST + b for b in range(256)}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a rank file (base64 token, rank); ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not consecutive")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _int(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: ids are ranks, id n is the unknown piece (never produced: all bytes are pieces)."""
    if len({t for t in tokens if len(t) == 1}) != 256:
        raise ValueError("the vocabulary lacks single bytes")
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, mapped(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _int(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int(3, 2))
    n = len(tokens)
    # trainer_spec: model_type BPE, vocab_size, unk id, no bos, eos, pad; normalizer_spec: identity, nothing added or escaped
    minus = (1 << 64) - 1
    out += _field(2, _int(3, 2) + _int(4, n + 1) + _int(40, n) + _int(41, minus) + _int(42, minus) + _int(43, minus))
    out += _field(3, _field(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0))
    return bytes(out)


def load_model(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """Broadcast of the serialised model; its size is that of the vocabulary file, about 1 MB, whatever the corpus."""
    return spark.sparkContext.broadcast(serialise(read_ranks(os.path.join(folder, f"{vocabulary}.tiktoken"))))


class Encoder:
    """Ids of pre-tokens: each distinct one is encoded once and kept as a slice of one flat array."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def slots(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.slot]
        if new:
            ids = self.sp.encode([mapped(w.encode("utf-8", "replace")) for w in new], num_threads=1)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            start = len(self.flat) + np.cumsum(size) - size
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
            self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.int32, int(size.sum()))])
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def encode_lists(self, lists: pa.ListArray) -> pa.ListArray:
        """Lists of pre-tokens to lists of ids; a null list gives an empty one."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        if len(self.slot) > CACHE:
            self.forget()
        slot = self.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        size = self.size[slot]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[slot] - ends[:-1], size) + np.arange(ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(self.flat[at]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(unmapped(self.sp.id_to_piece(int(i))) for i in ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    key = hashlib.md5(model).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): token ids of every row's text, without special tokens.

    Null and empty texts have the empty list. Strings that look like special tokens are ordinary text.
    Rows are kept as they are: repeated ids give repeated rows; other columns are ignored. No shuffle.
    """
    spark = df.sparkSession
    prepare(spark)
    model = load_model(spark, vocabulary, folder)
    words = F.coalesce(F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + PATTERN), F.lit(0)), F.array().cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), enc.encode_lists(batch.column(1))], [id_col, "ids"])

    return df.select(F.col(id_col), words.alias("w")).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): the texts of lists of token ids, by the inverse mapping; bytes that are no UTF-8 become the replacement character.
    Null and empty lists give ''; ids outside the vocabulary fail."""
    spark = df.sparkSession
    prepare(spark)
    model = load_model(spark, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for b in batches:
            texts = [enc.decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")

import os

import pytest

from corvid.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.isdir(K.TOKENIZERS), reason="no vocabularies")
TEXTS = ["", None, "Hello world", "it's  two   spaces \n\n next\tline ", "<|endoftext|> stays text", "中文，标点。", "naïve café 12345 ½", "\x00\x07 control\r\n", "👩‍👩‍👧 emoji", "a" * 5000, " ", "\n", "x" + " " * 40 + "y", "مرحبا ไทย", "don't we'll I'M", " nbsp　wide"]


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(K.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encode_equals_reference_and_decodes(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in K.encode(df).collect()}
    enc = K.Encoder(K.serialise(K.read_ranks(os.path.join(K.TOKENIZERS, "byte_bpe_50k.tiktoken"))))
    for i, t in enumerate(TEXTS):
        assert got[i] == reference(t), t
        assert enc.decode(got[i]) == (t or "").encode()
    assert K.encode(df.limit(0)).count() == 0


def test_documents(spark, sf_dir):
    from corvid.session import table

    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r["ids"] for r in K.encode(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == reference(r["text"])


def test_small_cache(monkeypatch):
    monkeypatch.setattr(K, "CACHE", 3)
    import pyarrow as pa

    enc = K.Encoder(K.serialise(K.read_ranks(os.path.join(K.TOKENIZERS, "byte_bpe_50k.tiktoken"))))
    for words in (["one", " two", " three", " four"], ["one", " five"], []):
        got = enc.encode_lists(pa.array([words, [], words], pa.list_(pa.string()))).to_pylist()
        assert got == [reference("".join(words)), [], reference("".join(words))]


def test_vocabulary_must_be_whole():
    with pytest.raises(ValueError):
        K.serialise([b"a"])


def test_decode_inverts(spark):
    df = spark.createDataFrame([*enumerate(TEXTS)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in K.decode(K.encode(df)).collect()}
    assert got == {i: (t or "").encode("utf-8", "replace").decode() for i, t in enumerate(TEXTS)}
    assert K.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first()["text"] == ""

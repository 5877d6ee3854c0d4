import pytest
from hypothesis import given
from hypothesis import strategies as st

from corvid.operators import chunking as C


def test_check():
    C.check(10, 0)
    for bad in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            C.check(*bad)


def test_window_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 3), (2, "  "), (3, None), (4, "tiny")], "id int, t string")
    got = [tuple(r) for r in C.window_chunks(df, "id", "t", 20, 5, 5).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, "abcdefghijabcdefghij"), (1, 1, "fghijabcdefghij")]
    assert C.window_chunks(df.limit(0), "id", "t").count() == 0


@given(st.text(alphabet="ab c\n", max_size=300), st.integers(1, 50), st.integers(0, 49))
def test_windows_rebuild_text(text, size, overlap):
    overlap = min(overlap, size - 1)
    step = max(1, size - overlap)
    raw = [text[i : i + size] for i in range(0, len(text), step)]
    assert "".join(r[:step] for r in raw[:-1]) + (raw[-1] if raw else "") == text


def test_paragraph_packing():
    a, b = "a" * 600, "b" * 500
    assert C.paragraphs_of(a + "\n\n" + b) == [a, "a" * 100 + "\n\n" + b]
    assert C.paragraphs_of("x" * 1024 + "\n\n" + "y" * 20) == ["x" * 1024, "x" * 100 + "\n\n" + "y" * 20]
    assert C.paragraphs_of("") == [] and C.paragraphs_of(None) == [] and C.paragraphs_of("short") == []
    assert C.paragraphs_of("p" * 20 + "\n\n" + "q" * 20, 30, 0) == ["p" * 20, "q" * 20]


def test_large_paragraph():
    assert C.split_paragraph("A. B. C", 4, 0) == ["A.B", "C"]
    assert C.split_paragraph("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9, "x"]
    many = ("word " * 20 + "\n") * 100
    small = C.split_paragraph(many, 1024, 100)
    assert all(len(c) <= 1024 for c in small)
    sparse = "\n".join("s" * 600 for _ in range(14))
    assert C.split_paragraph(sparse, 1024, 100) == C.hard_windows(sparse, 1024, 100)
    assert len(C.split_paragraph(sparse, 1024, 100, compat=True)) == 14 + len(C.hard_windows(sparse, 1024, 100))


def test_adaptive():
    text = "\n\n".join("m" * 520 for _ in range(120))
    assert C.adaptive_of(text) == C.windows_of(text)
    assert C.adaptive_of(text[:20_000]) == C.paragraphs_of(text[:20_000])


def test_legacy(spark):
    df = spark.createDataFrame([(1, "z" * 1024), (2, "short"), (3, ""), (4, None)], "id int, t string")
    got = {(r[0], r[1]): len(r[2]) for r in C.legacy_chunks(df, "id", "t").collect()}
    assert got == {(1, 0): 1024, (1, 1): 100, (2, 0): 5}


@given(st.text(alphabet="ab. \n中。", max_size=400))
def test_recursive_pieces_fit(text):
    assert all(0 < len(p) <= 50 for p in C.recursive_of(text, 50, 10))


def test_sentences():
    assert C.sentences_of("One two. Three four! 五六。", 4, 0) == ["One two.", "Three four!", "五六。"]
    assert C.sentences_of(None) == []


def test_chunk_with_and_ids(spark):
    df = spark.createDataFrame([("p", "a" * 30), ("q", None)], "path string, t string")
    c = C.with_ids(C.paragraph_chunks(df, "path", "t", 20, 5), "path").orderBy("chunk_index").collect()
    assert [r["doc_id"] for r in c] == ["p#0", "p#1"] and len(c[0]["chunk_id"]) == 64


def test_stats(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    assert tuple(C.size_stats(df, "t").first()) == (2, 3, 1.5, 3)
    assert tuple(C.size_stats(df.limit(0), "t").first()) == (0, 0, None, 0)
    assert [r[0] for r in C.largest(df, "id", "t").collect()] == [1]

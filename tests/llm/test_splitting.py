import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corvid.llm import splitting as S


@given(st.text(alphabet="ab .\n,中。", max_size=400), st.integers(2, 60), st.integers(0, 59))
def test_pieces_cover_and_fit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = S.cuts(text, limit, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b in got:
        assert 0 < b - a <= limit
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_boundaries():
    text = "A first sentence here. " * 10
    assert all(text[a:b].rstrip().endswith(".") for a, b in S.cuts(text, 60, 0))
    assert S.cuts("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]
    para = "p" * 40 + "\n\n" + "q" * 40
    assert S.cuts(para, 60, 0) == [(0, 42), (42, 82)]
    assert S.cuts("中文句子。" * 6, 12, 0)[0] == (0, 10)


def test_no_hard_cut_where_a_boundary_is_in_reach():
    long = "y" * 95
    assert S.cuts("some words " + long + " end", 100, 10)[0] == (0, 11)
    # a boundary within the overlap, and one that only a smaller overlap reaches
    for text in ("ab " + long + " end of it", "x. " * 10 + long + " more", long + " " + "z" * 99 + " " + long):
        for overlap in (0, 10, 40):
            got = S.cuts(text, 100, overlap)
            assert all(text[b - 1] == " " for _, b in got[:-1]) and all(b - c <= overlap for (_, b), (c, _) in zip(got, got[1:]))


@given(st.lists(st.sampled_from(["a" * 30, "b" * 57, "c", "d.", ",", "e" * 12]), max_size=40), st.integers(0, 59))
def test_short_words_are_never_cut(words, overlap):
    text = " ".join(words)
    assert all(text[b - 1 : b + 1].strip() != text[b - 1 : b + 1] for _, b in S.cuts(text, 60, overlap)[:-1])


def test_token_units():
    word = re.compile(r"\S+\s*")
    got = S.cuts("one two three four five six seven", 3, 1, word)
    assert all(len(word.findall("one two three four five six seven"[a:b])) <= 3 for a, b in got) and got[-1][1] == 33
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            S.cuts("x", *bad)


def test_pieces(spark, rows):
    big = "word " * 300
    df = spark.createDataFrame([("a", big), ("a", big), ("b", " " * 2000 + "short"), ("c", None), ("d", ""), (None, big), ("e", "y" * 75_000), ("f", "z" * 1024), ("g", "z" * 1025)], "id string, content string")
    df = df.selectExpr("*", "1 AS start", "2 AS chunk_index")
    got = S.pieces(df).orderBy("id", "chunk_index").collect()
    assert {r["id"] for r in got} == {"a", "e", "g"} and max(len(r["content"]) for r in got) <= 1024
    e = [r for r in got if r["id"] == "e"]
    assert [r["chunk_index"] for r in e] == list(range(len(e)))
    whole = ""
    for r in e:
        assert len(whole) - r["start"] <= 100
        whole = whole[: r["start"]] + r["content"]
    assert whole == "y" * 75_000
    assert S.pieces(df.limit(0)).count() == 0


def test_pieces_by_tokens(spark):
    df = spark.createDataFrame([("a", "one two three. four five six seven"), ("b", "one two"), ("c", "x" * 90)], "id string, content string")
    got = S.pieces(df, limit=4, overlap=0, unit=r"\S+\s*").orderBy("chunk_index").collect()
    assert {r["id"] for r in got} == {"a"} and "".join(r["content"] for r in got) == "one two three. four five six seven"
    assert all(len(r["content"].split()) <= 4 for r in got)

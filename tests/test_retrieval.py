import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import context, fusion, keyword, vectors
from corvid.plans import retrieval

SIDE = "query_id int, id string, doc_id string, rank int, score double"


def test_rrf(spark, rows):
    v = spark.createDataFrame([(1, "a", "a", 1, 0.9), (1, "b", None, 2, 0.8), (1, "c", "unknown", 3, 0.7), (1, "a", "a", 4, 0.1)], SIDE)
    k = spark.createDataFrame([(1, "x", "a", 1, 5.0), (1, "z", "z", 2, 4.0)], SIDE)
    got = {r["key"]: r for r in fusion.rrf(v, k).collect()}
    assert set(got) == {"a", "b", "c", "z"}
    assert got["a"]["rrf"] == round(1 / 61 + 1 / 64 + 1 / 61, 8) and got["a"]["vector_score"] == 0.9 and got["a"]["sources"] == "vector,vector,keyword"
    assert [r["key"] for r in fusion.rrf(v, k).orderBy("position").collect()] == ["a", "b", "z", "c"]
    assert fusion.rrf(v.limit(0), k).count() == 2 and fusion.rrf(v, k.limit(0)).count() == 3
    assert rows(fusion.both_sources(fusion.rrf(v, k))) == [(1, 0)]
    unique = fusion.rrf(v.where("rank < 4"), k)
    assert unique.agg(F.max("rrf")).first()[0] <= 2 / 61 + 1e-8


def test_weighted(spark):
    v = spark.createDataFrame([(1, "a", "a", 1, 0.5)], SIDE)
    k = spark.createDataFrame([(1, "b", "b", 1, 2.0)], SIDE)
    assert {r["key"]: r["combined_score"] for r in fusion.weighted(v, k).collect()} == {"a": 0.3, "b": 0.8}
    with pytest.raises(ValueError):
        fusion.weighted(v, k, 0.5, 0.4)


def test_rerank(spark):
    c = spark.createDataFrame([(1, 1, "x y", ""), (1, 2, "x y", "only x"), (1, 3, "x y", None), (1, 4, "x y", "y and x"), (1, 5, "x y", "none")], "query_id int, position int, query string, content string")
    got = fusion.rerank(c, "query", "content", "position", 2).orderBy("rank").collect()
    assert [(r["position"], r["rerank_score"]) for r in got] == [(4, 1.0), (2, 0.5)]
    assert fusion.rerank(c, "query", "content", "position", 9, cut=1).count() == 1
    assert fusion.candidate_cap(10) == 30 and fusion.candidate_cap(40) == 50


def test_context(spark):
    d = spark.createDataFrame([(1, r, "p", 0.5, "c" * (2500 if r < 13 else 1)) for r in range(1, 14)], "query_id int, rank int, file_path string, score double, content string")
    parts = context.context_parts(d).orderBy("rank").collect()
    assert sum(r["n_chars_used"] for r in parts) == 20_000 and parts[-1]["cut"] and not parts[0]["cut"] and len(parts) == 10
    assert parts[0]["part"].startswith("文档 1: p\n相关度: 0.500\n内容: ccc") and context.DOC_CUT in parts[0]["part"] and parts[-1]["part"].endswith(context.TOTAL_CUT)
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r["query_id"]: r["context"] for r in context.context(d, q).collect()}
    assert got[2] == context.NO_DOCS and got[1].count("\n\n文档") == 9


def test_stream_events(spark):
    a = spark.createDataFrame([(1, "abc" * 10, None), (2, None, None), (3, "x", "boom")], "query_id int, answer string, error string")
    got = [(r["query_id"], r["seq"], r["event"]) for r in context.stream_events(a).orderBy("query_id", "seq").collect()]
    assert got == [(1, 0, "meta"), (1, 1, "delta"), (1, 2, "delta"), (1, 3, "done"), (2, 0, "meta"), (2, 1, "done"), (3, 0, "meta"), (3, 1, "error")]


def test_bm25_and_fuzzy(spark, rows):
    d = spark.createDataFrame([(1, "pod pod node"), (2, "node"), (3, None), (4, "")], "doc_id int, text string")
    q = spark.createDataFrame([(7, "pod"), (8, None), (9, "absent")], "query_id int, query string")
    got = keyword.bm25(d, "doc_id", "text", q, "query_id", "query").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(7, 1, 1)]
    t = spark.createDataFrame([("podd",), ("ab",)], "term string")
    v = spark.createDataFrame([("pod",), ("pods",), ("node",), ("ac",), ("ab",)], "term string")
    assert rows(keyword.fuzzy_terms(t, v)) == [("ab", "ab", 0), ("podd", "pod", 1), ("podd", "pods", 1)]
    h = spark.createDataFrame([("x" * 200 + " pod here", "pod"), (None, "pod")], "text string, query string")
    marked = [r["highlights"] for r in keyword.highlights(h, "text", "query", 10).collect()]
    assert "<em>pod</em>" in marked[0][0] and marked[1] == []
    assert keyword.highlights(h, "text", "query", 21).first()["highlights"] == []


def test_highlights_across_window_borders(spark):
    texts = ["a " * 74 + "pod tail", "中" * 149 + "pods pod", "b " * 60 + "x" * 170 + " pod " + "中" * 400]
    h = spark.createDataFrame([(x, "pod") for x in texts], "text string, query string")
    got = [r["highlights"] for r in keyword.highlights(h, "text", "query", 10).collect()]
    assert all(sum("<em>pod</em>" in x for x in m) == 1 for m in got)
    assert all(len(x) <= 150 + len("<em></em>") for m in got for x in m)


def test_topk_and_ivf(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype("float32")
    rows_ = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0]), (903, [float("nan")] * 16)]
    e = spark.createDataFrame(rows_, "id int, v array<float>").repartition(3)
    q = e.where("id < 5 OR id >= 900")
    got = vectors.topk(e, "id", "v", q, "id", "v", 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(5):
        mine = [r["id"] for r in got.where(f"query_id = {i}").orderBy("rank").collect()]
        assert mine == np.argsort(-(u[i] @ u.T), kind="stable")[:5].tolist()
    assert got.where("query_id = 902").count() == 1 and got.where("query_id IN (900, 901, 903)").count() == 0
    assert vectors.topk(e, "id", "v", q.limit(0), "id", "v").count() == 0
    assert vectors.topk(e, "id", "v", q.where("id < 5"), "id", "v", 1, exclude_self=True).where("id = query_id").count() == 0
    c = vectors.ivf_train(e, "id", "v", 8)
    near = vectors.ivf_search(vectors.ivf_assign(e, "id", "v", c), c, e.where("id < 40"), "id", "v", 5, nprobe=6)
    exact = vectors.topk(e, "id", "v", e.where("id < 40"), "id", "v", 5)
    recall = near.join(exact, ["query_id", "id"]).count() / exact.count()
    assert recall >= 0.9
    assert [vectors.nprobe_for(n) for n in (999, 1000, 10_000, 100_000)] == [10, 32, 64, 128]


def test_ivf_finds_all_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(1200, 32))
    tight = np.repeat(rng.normal(size=(60, 24)), 10, axis=0) + 0.1 * rng.normal(size=(600, 24))
    e = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate([*flat, *tight])] + [(9000, None), (9001, [1.0])], "id int, v array<float>").repartition(3)
    q = e.where("id % 40 = 0 OR id = 9001")
    c = vectors.ivf_train(e, "id", "v")
    index = vectors.ivf_assign(e, "id", "v", c)
    assert index.count() == 1801
    exact = vectors.topk(e, "id", "v", q, "id", "v", 10)
    near = vectors.ivf_search(index, c, q, "id", "v", 10)
    key = ["query_id", "id", "rank"]
    assert exact.count() == near.count() and near.select(*key).exceptAll(exact.select(*key)).count() == 0
    seen = []
    real = vectors._best_of
    monkeypatch.setattr(vectors, "_best_of", lambda *a, probed=None, **k: seen.append(probed) or real(*a, probed=probed, **k))
    monkeypatch.setattr(vectors, "nprobe_for", lambda n: 1)
    tight = q.where("id BETWEEN 1200 AND 8999")
    assert vectors.ivf_search(index, c, tight, "id", "v", 10).exceptAll(exact.join(tight.select("id").withColumnRenamed("id", "query_id"), "query_id").select("query_id", "id", "rank", "cosine")).count() == 0
    # cells far from the query are left out
    assert sum(x.sum() for x in seen) < tight.count() * len(c[24]) / 3
    assert vectors.ivf_search(index, c, q.limit(0), "id", "v").count() == 0 and vectors.ivf_train(e.limit(0), "id", "v") == {}


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, t string")
    got = {r["id"]: r for r in vectors.embed(df, "id", "t").collect()}
    assert got[1]["embedding"] == got[3]["embedding"] and abs(sum(x * x for x in got[1]["embedding"]) - 1) < 1e-6 and set(got[2]["embedding"]) == {0.0}

    class Broken:
        def encode(self, texts):
            raise RuntimeError("no")

    assert vectors.embed(df, "id", "t", Broken).where("embedding IS NULL AND error = 'no'").count() == 3


def test_whole_texts_are_encoded():
    long = "a " * 512
    whole, cut = vectors.HashingEncoder(), vectors.HashingEncoder(max_tokens=512)
    assert not np.array_equal(*whole.encode([long, long + "behind"])) and np.array_equal(*cut.encode([long, long + "behind"]))


def test_retrieve(spark):
    d = spark.createDataFrame([(i, f"text {'pod' if i % 2 else 'node'} {i}", f"p{i}") for i in range(20)], "id int, t string, path string")
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, v array<float>")
    q = spark.createDataFrame([(1, "pod", [1.0, 1.0])], "query_id int, query string, query_vec array<float>")
    r = retrieval.retrieve(d, "id", "t", e, "id", "v", q, 3, "path").orderBy("rank").collect()
    assert len(r) == 3 and all("pod" in x["content"] for x in r)
    assert retrieval.retrieve(d, "id", "t", None, "id", "v", q, 3).count() == 3
    w = spark.createDataFrame([("pod limit",)], "q string").select(retrieval.stand_in_rewrite(F.col("q")).alias("j"))
    assert tuple(retrieval.parse_rewrites(w, "j").select("semantic_query", "keywords").first()) == ("pod limit", "pod limit")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_against_brute_force(spark, rows):
    import random

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abß中") for _ in range(rng.randrange(1, 8))) for _ in range(120)})
    v = spark.createDataFrame([(w,) for w in words], "term string")
    t = v.limit(30)
    want = []
    for (a,) in t.collect():
        allowed = 0 if len(a) <= 2 else 1 if len(a) <= 5 else 2
        near = sorted((edits(a, b), b) for b in words if b[0] == a[0] and edits(a, b) <= allowed)[:50]
        want += [(a, b, e) for e, b in near]
    assert rows(keyword.fuzzy_terms(t, v)) == sorted(want, key=str)


def test_bm25_fuzzy_and_path(spark, rows):
    d = spark.createDataFrame([(1, "pods and nodes", "a/b.md"), (2, "node pool", "c.md"), (3, "other words", "pods")], "doc_id int, text string, path string")
    q = spark.createDataFrame([(7, "node"), (8, "pods"), (9, "a b c d e f g h node"), (10, " ")], "query_id int, query string")
    exact = {(r["query_id"], r["doc_id"]) for r in keyword.bm25(d, "doc_id", "text", q, "query_id", "query").collect()}
    assert exact == {(7, 2), (8, 1), (9, 2)}
    fuzzy = keyword.bm25(d, "doc_id", "text", q, "query_id", "query", search=keyword.Search(), path="path").orderBy("query_id", "rank").collect()
    got = [(r["query_id"], r["doc_id"]) for r in fuzzy]
    # Words within their edits, for short queries only; a query that is the whole path finds its document.
    assert got[:2] == [(7, 2), (7, 1)] and (8, 3) in got and [x for x in got if x[0] == 9] == [(9, 2)]
    assert keyword.bm25(d.limit(0), "doc_id", "text", q, "query_id", "query", search=keyword.Search()).count() == 0


def test_chinese_tokens_are_marked(spark):
    h = spark.createDataFrame([("使用配额 quota配额", "额 quota")], "text string, query string")
    assert keyword.highlights(h, "text", "query", 5).first()["highlights"] == ["使用配<em>额</em> <em>quota</em>配<em>额</em>"]


def test_rewritten_and_encoded(spark):
    q = spark.createDataFrame([(1, "Pod pod Node"), (2, " ")], "query_id int, query string")
    r = {x["query_id"]: x for x in retrieval.rewritten(q).collect()}
    assert r[1]["keywords"] == "pod node" and r[1]["semantic_query"] == "Pod pod Node" and r[2]["keywords"] == " "
    d = spark.createDataFrame([(1, "pod one"), (2, "node two"), (3, "other")], "id int, text string")
    v = vectors.embed(d, "id", "text", keep=True).drop("error")
    got = retrieval.retrieve(d, "id", "text", v, "id", "embedding", q, 2, rewriter=retrieval.stand_in_rewrite, make_encoder=vectors.HashingEncoder, cut=4)
    assert {x["key"] for x in got.where("query_id = 1").collect()} == {"1", "2"}


def test_histories(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    m = [("c", f"m{i:02}", t(i), ("user", "AI", "?")[i % 3], f"x{i}") for i in range(20)] + [("d", "n", t(1), "assistant", "only"), ("e", "o", t(1), " Human", "ask"), (None, "p", t(1), "user", "lost")]
    got = {r["chat_id"]: r for r in context.histories(spark.createDataFrame(m, "chat_id string, id string, created_at timestamp_ntz, role string, content string"), 3).collect()}
    assert set(got) == {"c", "e"} and got["c"]["question"] == "x18" and [tuple(x) for x in got["c"]["history"]] == [("assistant", "x13"), ("user", "x15"), ("assistant", "x16")]
    assert got["e"]["history"] == []


def test_vector_index_keeps_other_columns(spark):
    d = spark.createDataFrame([(1, "pod", "x")], "id int, text string, more string")
    assert vectors.embed(d, "id", "text", keep=True).columns == ["id", "text", "more", "embedding", "error"]


def test_bm25_blocks_and_string_ids(spark, rows, monkeypatch):
    d = spark.createDataFrame([(f"d{i}", "pod " * (i % 4) + "node") for i in range(30)] + [(None, "pod"), ("e", None)], "doc_id string, text string").repartition(4)
    q = spark.createDataFrame([(f"q{i}", ("pod", "node", "pod node", "")[i % 4]) for i in range(9)], "query_id string, query string")
    whole = rows(keyword.bm25(d, "doc_id", "text", q, "query_id", "query", 3))
    monkeypatch.setattr(keyword, "QUERY_BLOCK", 2)
    assert rows(keyword.bm25(d, "doc_id", "text", q, "query_id", "query", 3)) == whole and len(whole) == 7 * 3
    assert [r[1] for r in whole if r[0] == "q0"] == ["d11", "d15", "d19"]
    assert rows(vectors.topk(vectors.embed(d.where("doc_id IS NOT NULL"), "doc_id", "text"), "doc_id", "embedding", vectors.embed(q, "query_id", "query"), "query_id", "embedding", 1).select("query_id"))[0] == ("q0",)

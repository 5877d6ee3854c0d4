import random
import re

from corvid.llm import leakage as L


def words(t):
    return [w.lower() for r in re.findall(r"[^\W_]+", t or "") for w in re.findall("[一-鿿]|[^一-鿿]+", r)]


def brute(docs, items, run=12):
    out = set()
    for d, t in docs:
        w = words(t)
        have = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for i, u in items:
            x = words(u)
            if d is not None and any(tuple(x[k : k + run]) in have for k in range(len(x) - run + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark, rows):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(5, 40))) for i in range(20)] + [(90, None), (91, ""), (92, "中文测试项目的一段话十二字")]
    docs = [(d, text(rng.randrange(0, 80))) for d in range(60)]
    for d in range(60, 80):
        w = items[rng.randrange(20)][1].upper().split()
        docs.append((d, "x, " + " - ".join(w[2:16]) + "! " + text(5)))
    docs += [(80, None), (81, ""), (82, "前 中文测试项目的一段话十二 后"), (60, docs[60][1])]
    got = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert set(rows(got)) == brute(docs, items) and got.count() == len(set(rows(got)))


def test_groups_of_items(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "GROUP_CHARS", 50)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(14))) for i in range(5)]
    docs = [(i, items[i][1]) for i in range(5)]
    got = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(got) == [(i, i) for i in range(5)]
    assert L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_short_items_and_other_ids(spark, rows):
    items = [("a", "one two three"), ("b", "one two"), ("c", "x"), ("d", " ".join(f"w{i}" for i in range(12)))]
    docs = [(1.5, "say one two three again"), (2.5, "one two, end"), (3.5, " ".join(f"w{i}" for i in range(12)))]
    got = L.leaks(spark.createDataFrame(docs, "doc_id double, text string"), spark.createDataFrame(items, "item_id string, text string"), least=2)
    assert rows(got) == [(1.5, "a"), (1.5, "b"), (2.5, "b"), (3.5, "d")]

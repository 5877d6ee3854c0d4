import random

import numpy as np

from corvid.llm import near_duplicates as D


def texts(seed=4, groups=25):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(400)] + ["中文", "近似"]
    out = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(90)]
        out.append((f"g{g:02}a", " ".join(base)))
        for k, share in enumerate((0.02, 0.05, 0.12)):
            w = [rng.choice(vocab) if rng.random() < share else x for x in base]
            out.append((f"g{g:02}{'bcd'[k]}", "  ".join(w).upper() if k else " ".join(w)))
        cut = rng.randrange(20, 70)
        out.append((f"g{g:02}e", " ".join(base[cut:] + base[:cut])))
    return out


def brute(rows, least=0.7):
    norm = [(i, " ".join(t.lower().split())) for i, t in dict(rows).items() if t]
    sets = [(i, D.shingles(t)) for i, t in norm if len(t) >= 300]
    return {(min(i, j), max(i, j)) for a, (i, s) in enumerate(sets) for j, u in sets[:a] if D.similarity(s, u) >= least}


def test_pairs_and_groups(spark, rows):
    data = texts()
    data += [("copy1", data[0][1]), ("copy2", data[0][1] + " \n"), ("short", "too short"), ("none", None), ("empty", ""), data[3], ("long", "word " * 15_000)]
    df = spark.createDataFrame([*data, (None, data[0][1])], "id string, content string").selectExpr("*", "1 AS rid", "'x' AS text")
    want = brute(data)
    got = set(rows(D.duplicate_pairs(df)))
    assert got <= want and len(got) >= 0.98 * len(want) and ("copy1", "copy2") in got
    groups = {r["id"]: r for r in D.duplicate_groups(df).collect()}
    assert set(groups) == {i for i, t in data if t and len(" ".join(t.split())) >= 300}
    assert groups["g00b"]["group"] == groups["copy2"]["group"] == "copy1" and groups["long"]["group"] == "long"
    # Groups are the components of all pairs.
    name = {i: i for i in groups}
    for _ in range(10):
        for a, b in got:
            name[a] = name[b] = min(name[a], name[b])
    assert {i: r["group"] for i, r in groups.items()} == name
    assert D.duplicate_pairs(df.limit(0)).count() == 0 and D.duplicate_groups(df.limit(0)).count() == 0


def test_hot_bucket(spark, rows, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    data = [(f"h{i:03}", " ".join(base[:-1] + [f"end{i}"])) for i in range(60)]
    df = spark.createDataFrame(data, "id string, content string")
    keyed = D.keyed
    monkeypatch.setattr(D, "keyed", lambda d, key, rid, copies=None: keyed(d, key, rid, cap=7, copies=copies))
    assert set(rows(D.duplicate_pairs(df))) == brute(data)


def test_groups_pair_no_cluster_whole(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    data = [(f"h{i:03}", " ".join(base[:-1] + [f"end{i}"])) for i in range(150)] + [(f"o{i}", " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))) for i in range(20)]
    seen = []
    real = D.verified_pairs
    monkeypatch.setattr(D, "verified_pairs", lambda t, i, c, *a: seen.append(c.count()) or real(t, i, c, *a))
    groups = {r["id"]: r["group"] for r in D.duplicate_groups(spark.createDataFrame(data, "id string, content string")).collect()}
    assert groups == {i: "h000" if i[0] == "h" else i for i, _ in data}
    assert sum(seen) <= 150 * 22


def test_copies_are_paired_block_by_block(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "CLASS_BLOCK", 3)
    data = [(f"c{i}", "same text " * 40) for i in range(10)]
    got = rows(D.duplicate_pairs(spark.createDataFrame(data, "id string, content string")))
    assert got == [(f"c{i}", f"c{j}") for i in range(10) for j in range(i + 1, 10)]


def test_sketches_estimate():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    b = a[:2700] + "".join(rng.choice("ijklmnop ") for _ in range(300))
    sig = D.samples([a, b, "".join(rng.choice("qrstuv ") for _ in range(900))])
    true = D.similarity(D.shingles(a), D.shingles(b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12
    sk = D.odd_sketch(sig)
    dist = lambda i, j: int(np.bitwise_count(sk[i] ^ sk[j]).sum())
    assert dist(0, 1) <= D.sketch_limit() < dist(0, 2)
    assert (D.samples(["abc", a])[0] == D._EMPTY).all()

import numpy as np

from corvid.llm import buckets, neighbours as N


def clustered(n, dim=96, per=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // per, dim))
    x = np.repeat(base, per, axis=0) + 0.45 * rng.normal(size=(n // per * per, dim))
    return x.astype(np.float32)


def truth(ids, x, k=10, least=0.75):
    u = N.unit(x)
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order if s[i, j] >= least}
    return out


def frame(spark, ids, x, more=()):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)] + list(more), "id string, embedding array<float>")


def test_hadamard_keeps_lengths():
    a = np.random.default_rng(0).normal(size=(5, 64))
    b = N.hadamard(a)
    assert np.allclose(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)) and np.allclose(N.hadamard(b), a)
    m = N.rotations(96, 2)
    assert np.allclose(m[:, :128] @ m[:, :128].T, np.eye(96), atol=1e-5)


def test_pack_is_lossless():
    import pyarrow as pa

    x = np.random.default_rng(0).normal(size=(7, 96)).astype(np.float32)
    assert (N.unpack(pa.array(N.pack(x), pa.binary()), 96) == x).all()


def test_pairs_recall(spark):
    x = clustered(1200)
    ids = [f"id{i:05}" for i in range(len(x))]
    more = [("bad1", None), ("bad2", [0.0] * 96), ("bad3", [1.0] * 5), ("bad4", [float("nan")] * 96), ("bad5", []), (None, [1.0] * 96), (ids[0], [float(v) for v in x[0]])]
    want = truth(ids, x)
    got = {tuple(r) for r in N.similar_pairs(frame(spark, ids, x, more)).collect()}
    assert len(want) > 500 and len(got & want) / len(want) >= 0.95 and got <= want | got
    # further bits, as for more rows
    assert N.plan(len(x), bucket=4)[2] > 0
    got = {tuple(r) for r in N.similar_pairs(frame(spark, ids, x), bucket=4).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_further_bits_keep_the_chance_to_meet(spark):
    rng = np.random.default_rng(7)
    a, g = N.unit(rng.normal(size=(2000, 96))), rng.normal(size=(2000, 96))
    b = 0.75 * a + np.sqrt(1 - 0.75**2) * N.unit(g - (g * a).sum(axis=1, keepdims=True) * a)
    met = {}
    for n in (200_000, 400_000, 3_000_000, 12_000_000, 60_000_000, 500_000_000):
        tables, probes, bits = N.plan(n)
        m = N.rotations(96, N.rotations_of(tables, bits, 96))
        x, y = N.bucket_keys(a, m, tables, probes, bits), N.bucket_keys(b, m, tables, probes, bits)
        assert x.shape[1] == probes
        met[bits] = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean()
    assert len(met) == 6 and min(met) == 0 and max(met) >= 10 and min(met.values()) >= met[0] - 0.015
    # pairs of about the least cosine, buckets as of millions of rows
    x = np.stack([a[:600], b[:600] + 1e-3 * a[:600]], axis=1).reshape(-1, 96).astype(np.float32)
    ids = [f"id{i:05}" for i in range(len(x))]
    want = truth(ids, x)
    assert N.plan(len(x), bucket=1)[2] >= 4
    got = {tuple(r) for r in N.similar_pairs(frame(spark, ids, x), bucket=1).collect()}
    assert len(want) >= 600 and len(got & want) / len(want) >= 0.95


def test_copies_and_hot_buckets(spark, monkeypatch):
    x = clustered(120)
    x[30:60] = x[30]
    ids = [f"id{i:05}" for i in range(len(x))]
    want = truth(ids, x)
    got = {tuple(r) for r in N.similar_pairs(frame(spark, ids, x)).collect()}
    assert len(got & want) / len(want) >= 0.95
    assert {p for p in got if set(p) <= set(ids[30:60])} == {p for p in want if set(p) <= set(ids[30:60])}
    lists = N.similar(frame(spark, ids, x), least=0.75).where("id = 'id00059'").orderBy("rank").collect()
    assert [r["neighbour"] for r in lists] == ids[30:40] and lists[0]["cosine"] == 1.0
    keyed = buckets.keyed
    monkeypatch.setattr(N, "keyed", lambda df, key, rid, copies=None: keyed(df, key, rid, cap=4, copies=copies))
    again = {tuple(r) for r in N.similar_pairs(frame(spark, ids, x)).collect()}
    assert again == got


def test_nearest_of_is_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(500, 96)), clustered(120, per=12)]).astype(np.float32)
    x[40:60] = x[40]
    ids = [f"id{i:05}" for i in range(len(x))]
    df = frame(spark, ids, x, [(ids[3], [float(v) for v in x[3]]), ("none", None)])
    asked = df.where("id IN ('id00003', 'id00045', 'id00200', 'id00510', 'none') OR id < 'id00002'")
    got = {}
    for r in N.nearest_of(df, asked).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    u = N.unit(x)
    s = u @ u.T
    for i in (0, 1, 3, 45, 200, 510):
        assert got.pop(ids[i]) == [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 12), ids[j]))[:10]]
    assert not got
    base = N.numbered(df, "id", "embedding", 96, 10)
    lists = N.exact_lists(base, base.select("rid", "vec").limit(7), 96, 3, block=2).collect()
    assert len(lists) == 7 and all(len(r["near"]) == 3 for r in lists)
    assert N.nearest_of(df, df.limit(0)).count() == 0


def test_odd_tables(spark):
    x = clustered(12)
    ids = [f"i{k}" for k in range(12)]
    assert N.similar_pairs(frame(spark, [], [])).count() == 0
    df = frame(spark, ids, x).selectExpr("*", "'z' AS rid", "1 AS vec")
    assert N.similar_pairs(df).count() == len(truth(ids, x))
    twice = frame(spark, ids, x, [("i0", [float(v) for v in -x[0]])])
    assert N.similar(twice, least=0.75).groupBy("id", "neighbour").count().where("count > 1").count() == 0

import random

from corvid.llm import subjects as S

NAMES = ["alpha", "beta", "gamma"]


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    terms = {s: [f"{s[0]}{''.join(rng.choice('klmnoprst') for _ in range(6))} {''.join(rng.choice('aeiou') for _ in range(5))}" for _ in range(12)] for s in NAMES}
    filler = ["".join(rng.choice("vwxyz") for _ in range(5)) for _ in range(60)]

    def sentence(s):
        t = rng.sample(terms[s], 2)
        return " ".join([rng.choice(filler), rng.choice(filler), "the", t[0], rng.choice(filler), "with the", t[1], *rng.sample(filler, 4)]).capitalize() + "."

    docs, truth = [], {}
    for d in range(n):
        kind = d % 4
        own = rng.sample(NAMES, 1 if kind else 2)
        text = [sentence(rng.choice(own)) for _ in range(12)] if kind else [sentence(own[k % 2]) for k in range(12)]
        if kind == 1:
            text[3] = sentence(rng.choice([x for x in NAMES if x not in own]))
        docs.append((d, "\n".join(text) if d % 3 else " ".join(text)))
        truth[d] = set(own)
    return docs, truth, terms, sentence


def run(spark, docs, labels, skip=None):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    la = spark.createDataFrame(labels, "doc_id bigint, subject string")
    su = spark.createDataFrame([(n,) for n in NAMES], "subject string")
    sk = spark.createDataFrame([(t,) for t in skip], "text string") if skip is not None else None
    got = {}
    for r in S.subjects_of(d, la, su, sk).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    return got


def test_held_out_accuracy(spark):
    docs, truth, terms, sentence = corpus()
    labels = [(d, f" {s.upper()} " if d % 7 == 0 else s) for d in range(0, 300, 3) for s in truth[d]]
    labels += [(1, "unknown"), (None, "alpha"), (2, None), (6, "gamma")]
    docs += [(900, None), (901, ""), (902, "qq zz. " * 30), (903, "漢字 " * 20)]
    got = run(spark, docs, labels, ["Not in any text at all, though it is long enough to be one.", None])
    held = [d for d in truth if d % 3]
    assert sum(got.get(d, set()) == truth[d] for d in held) / len(held) >= 0.95
    assert not {900, 901, 902, 903} & set(got)


def test_skipped_sentences(spark):
    docs, truth, terms, sentence = corpus()
    labels = [(d, s) for d in range(0, 300, 3) for s in truth[d]]
    skip = [sentence("beta") for _ in range(6)]
    docs.append((950, "\n".join([sentence("alpha") for _ in range(6)] + skip)))
    assert run(spark, docs, labels)[950] == {"alpha", "beta"}
    assert run(spark, docs, labels, skip)[950] == {"alpha"}


def test_nothing_labelled_or_empty(spark):
    docs, *_ = corpus(n=10)
    assert run(spark, docs, []) == {}
    assert run(spark, [], [(1, "alpha")]) == {}


def test_weights_and_clamped_seeds(spark):
    docs, truth, terms, sentence = corpus()
    labels = [(d, s) for d in range(0, 300, 3) for s in truth[d]] + [(300, "beta")]
    # One sentence in five is too little to be treated, but a trusted label stays.
    docs.append((300, "\n".join([sentence("alpha")] * 4 + [sentence("beta")])))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    s = S.Subjects(d, spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(n,) for n in NAMES], "subject string"))
    w = {}
    for r in s.weights(0.0).collect():
        w.setdefault(r["doc_id"], {})[r["subject"]] = r["weight"], r["trusted"]
    assert all(abs(sum(x for x, _ in v.values()) - 1) < 1e-9 for v in w.values())
    right = sum(set(sorted(v, key=lambda k: -v[k][0])[: len(truth[i])]) == truth[i] for i, v in w.items() if i < 300 and i % 3)
    assert right >= 0.95 * sum(i % 3 > 0 for i in range(300))
    found = {(r["doc_id"], r["subject"]) for r in s.found().collect()}
    assert all((i, k) in found for i, v in w.items() for k, (_, trusted) in v.items() if trusted)
    assert {i for i, v in w.items() if any(t for _, t in v.values())} <= {i for i, _ in labels}


def test_propagation_gains_and_ends(spark):
    # Term 2 starts with subject 0 alone but stands in documents of subject 1 only: it takes that subject over.
    hits = spark.createDataFrame([(i, [1, 2], [3, 1]) for i in range(9)] + [(10 + i, [0], [1]) for i in range(9)], "doc_id bigint, only array<int>, tf array<int>")
    start = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 0.0)], "term int, p0 double, p1 double")
    seeds = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0])], "doc_id bigint, given array<double>")
    d, t = S.propagate(hits, start, seeds, 2, tolerance=0.003)
    p = {r["term"]: r["p1"] for r in t.collect()}
    assert p[0] < 0.05 and p[1] > 0.9 and 0.3 < p[2] < 0.6
    assert t.agg({"moved": "avg"}).first()[0] <= 0.003
    at = {r["doc_id"]: r for r in d.collect()}
    assert at[0]["d1"] == 1.0 and at[5]["d1"] > 0.75 and at[12]["d0"] > 0.95


def test_skip_changes_counts(spark):
    hits = spark.createDataFrame([(1, 2, [5, 6], [0, 0, 1], [7, 8, 7], [7, 8], [2, 1]), (2, 1, [6], [0], [7], [7], [1])], S.HITS)
    left = S.without(hits, spark.createDataFrame([(6,)], "hash bigint")).collect()
    assert [(r["doc_id"], r["live"], r["at"], r["term"], r["only"], r["tf"]) for r in left] == [(1, 1, [0, 0], [7, 8], [7, 8], [1, 1])]


def test_followed_terms():
    rows = [("signing", 40), ("signing key", 40), ("key", 90), ("控制", 20), ("控制平面", 19), ("平面", 60)]
    assert S.followed(rows).tolist() == [1, 1, 2, 4, 4, 5]

import datetime as dt
import random

import pytest

from corvid.llm import conversations as C

T0 = dt.datetime(2025, 1, 1)
MSG = "id string, chat_id string, content string, message_type string, role string, created_at timestamp_ntz, updated_at timestamp_ntz, meta_info string"


def msg(i, chat, role, s, content="x", kind="text", meta=None, version=0):
    return (i, chat, content, kind, role, None if s is None else T0 + dt.timedelta(seconds=s), T0 + dt.timedelta(seconds=version), meta)


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(n, find(n)) for n in parent}


@pytest.mark.parametrize("pairs", [[], [("a", "a"), (None, "b")], [("a", "b"), ("b", "a"), ("c", "b"), ("e", "d"), (None, "d")], [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]])
def test_components(spark, rows, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    assert {tuple(r) for r in C.connected_components(df).collect()} == components(pairs)


def test_components_of_random_graph(spark):
    rng = random.Random(5)
    pairs = [(str(rng.randrange(80)), str(rng.randrange(80))) for _ in range(60)] + [("hub", str(i)) for i in range(200, 260)]
    assert {tuple(r) for r in C.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()} == components(pairs)


def chats(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


CASES = {
    "good": ([("user", 1), (" Assistant ", 2), ("HUMAN", 3), ("bot", 3)], True),
    "system": ([("system", 5), ("user", 1), ("ai", 2)], True),
    "tie": ([("assistant", 1), ("user", 1)], True),
    "unanswered": ([("user", 1), ("assistant", 2), ("user", 3)], False),
    "twice": ([("user", 1), ("user", 2), ("assistant", 3), ("assistant", 4)], False),
    "same_instant": ([("user", 1), ("user", 1), ("assistant", 1), ("assistant", 1)], False),
    "answer_first": ([("assistant", 1), ("user", 2), ("assistant", 3)], False),
    "unknown_role": ([("user", 1), ("assistant", 2), ("?", 3)], False),
    "null_role": ([("user", 1), ("assistant", 2), (None, 3)], False),
    "no_time": ([("user", 1), ("assistant", None)], False),
    "system_only": ([("system", 1)], False),
}


def test_dropped(spark):
    data = [msg(f"{c}{i}", c.upper() if i % 2 else c, r, s) for c, (ms, _) in CASES.items() for i, (r, s) in enumerate(ms)]
    data += [msg("b0", "blank", "user", 1, " \n"), msg("b1", "blank", "assistant", 2), msg("n0", "nulltext", "user", 1, None), msg("n1", "nulltext", "assistant", 2)]
    data += [msg("e0", "error", "user", 1), msg("e1", "error", "assistant", 2, kind="ERROR"), msg("o0", "orphan", "user", 1), msg("o1", "orphan", "assistant", 2)]
    data += [msg("v0", "versions", "user", 1), msg("v1", "versions", "?", 2), msg("v1", "versions", "assistant", 2, version=5), msg("v1", "versions", "?", 2, version=3)]
    data += [msg(None, "good", "?", 9), msg("lost", None, "user", 1)]
    known = chats(spark, *CASES, "blank", "nulltext", "error", "VERSIONS", "empty", None)
    got = {r[0] for r in C.dropped(known, spark.createDataFrame(data, MSG)).collect()}
    assert got == {c for c, (_, ok) in CASES.items() if not ok} | {"blank", "nulltext", "error", "orphan", "empty"}


def test_long_chat_is_cut_into_ranges(spark):
    good = [msg(f"g{i:04}", "long", "user" if i % 2 == 0 else "assistant", i) for i in range(2000)]
    bad = [msg(f"h{i:04}", "bad", "user" if i % 2 == 0 or i == 1001 else "assistant", i) for i in range(2000)]
    df = spark.createDataFrame(good + bad, MSG).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [r[0] for r in C.dropped(chats(spark, "long", "bad"), df).collect()] == ["bad"]
        turns = C.rebuilt(chats(spark, "long", "bad"), df).orderBy("turn").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["id"] for r in turns] == [f"g{i:04}" for i in range(2000)] and [r["turn"] for r in turns] == list(range(2000))


def test_lost_messages_join_by_links(spark):
    data = [msg("a", "C1", "user", 1), msg("b", None, "assistant", 2, meta='{"reply_to": "a"}'), msg("c", None, "user", 3, meta='{"quote_of": "b", "x": 1}')]
    data += [msg("d", None, "user", 1, meta='{"reply_to": "e"}'), msg("e", None, "user", 1), msg("f", None, "user", 1, meta="{broken"), msg("g", None, "user", 1, meta='{"reply_to": "gone"}')]
    got = {r["id"]: r["conversation"] for r in C.conversations(spark.createDataFrame(data, MSG)).collect()}
    assert got == {"a": "c1", "b": "c1", "c": "c1", "d": "d", "e": "d", "f": "f", "g": "g"}
    extra = spark.createDataFrame([("f", "g")], "a string, b string")
    assert {r["id"]: r["conversation"] for r in C.conversations(spark.createDataFrame(data, MSG), extra).collect()}["g"] == "f"


def test_rebuilt_takes_in_lost_messages(spark):
    data = [msg("a", "C1", "user", 1), msg("b", None, "assistant", 2, meta='{"reply_to": "a"}')]  # whole only with b
    data += [msg("c", "c2", "user", 1), msg("d", "c2", "assistant", 2), msg("e", None, "user", 3, meta='{"quote_of": "d"}')]  # broken by e
    data += [msg("f", None, "user", 1), msg("g", None, "assistant", 2, meta='{"in_reply_to": "f"}')]  # without a chat
    data += [msg("h", None, "user", 1), msg("i", None, "user", 2, meta='{"reply_to": "h"}'), msg("j", None, "user", 1)]  # unanswered
    data += [msg("k", "gone", "user", 1), msg("l", None, "assistant", 2, meta='{"reply_to": "k"}')]  # not in chats
    df = spark.createDataFrame(data, MSG)
    known = chats(spark, "c1", "c2", "empty")
    got = C.rebuilt(known, df).orderBy("conversation", "turn").collect()
    assert [(r["conversation"], r["turn"], r["id"]) for r in got] == [("c1", 0, "a"), ("c1", 1, "b"), ("f", 0, "f"), ("f", 1, "g")]
    assert {r[0] for r in C.dropped(known, df).collect()} == {"c1", "empty", "gone"}


def test_found_takes_in_lost_messages(spark, tmp_path):
    from corvid.llm.queries import QUERIES

    data = [msg("a", "C1", "user", 1), msg("b", None, "assistant", 2, meta='{"reply_to": "a"}')]  # whole only with b
    data += [msg("c", "c2", "user", 1), msg("d", "c2", "assistant", 2), msg("e", None, "user", 3, meta='{"quote_of": "d"}')]  # broken by e
    data += [msg("f", None, "user", 1), msg("g", None, "assistant", 2, meta='{"in_reply_to": "f"}')]  # without a chat
    data += [msg("h", "gone", "user", 1), msg("i", None, "assistant", 2, meta='{"reply_to": "h"}')]  # not in chats
    data += [msg("j", "c3", "user", 1), msg("k", None, "assistant", 2, meta='{"reply_to": "j"}'), msg("l", None, "user", 3, meta='{"reply_to": "k"}'), msg("m", None, "bot", 4, meta='{"parent_id": "l"}')]  # whole by a chain
    data += [msg("n", "c4", "user", 1), msg("o", "c4", "assistant", 2), msg("c4", None, "user", 3)]  # a message named like the chat
    data += [msg("p", "c5", "user", 1), msg("q", None, "assistant", 2, meta='{"reply_to": "p"}'), msg("q", "c5", "assistant", 2, " ", version=1)]  # the newer version counts
    spark.createDataFrame(data, MSG).write.parquet(f"{tmp_path}/messages.parquet")
    chats(spark, "c1", "C2", "c3", "c4", "c5", "empty", None).write.parquet(f"{tmp_path}/chats.parquet")
    assert sorted(r[0] for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()) == ["c2", "c5", "empty", "gone"]


def test_rebuilt_is_registered():
    from corvid.llm.queries import QUERIES

    assert "p2_rebuilt" in QUERIES


def test_empty(spark):
    none = spark.createDataFrame([], MSG)
    assert [r[0] for r in C.dropped(chats(spark, "a"), none).collect()] == ["a"]
    assert C.dropped(chats(spark, None), none).count() == 0


def test_following_links(spark, rows):
    data = [("a", "C1", 1, "s"), ("b", None, 2, "s"), ("c", None, 3, "s"), ("d", "c2", 4, "s"), ("e", None, 1, "t"), ("f", None, 2, None)]
    df = spark.createDataFrame([(i, c, s, k) for i, c, s, k in data], "id string, chat_id string, created_at int, sender_id string").selectExpr("*", "1 AS updated_at")
    assert rows(C.following_links(df)) == [("b", "a"), ("c", "b")]


def test_content_of_the_judged_version(spark):
    a, b = msg("a", "c1", "user", 1, "first"), msg("a", "c1", "user", 1, "second")
    df = spark.createDataFrame([a, b, msg("z", "c1", "assistant", 2)], MSG)
    assert [r["id"] for r in C.rebuilt(chats(spark, "c1"), df).orderBy("turn").collect()] == ["a", "z"]

import datetime as dt

import pytest

from corvid.operators import cache, chat

T0 = dt.datetime(2025, 1, 1)
MSG = "id string, updated_at timestamp_ntz, chat_id string, content string, role string, created_at timestamp_ntz"


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(f"m{i:02}", at(0), "c1", f"text {i}%", "user" if i % 2 == 0 else "assistant", at(i // 2)) for i in range(25)]
    rows += [("m00", at(9), "c1", "newer", "user", at(0)), ("x", at(0), None, None, None, None), (None, at(0), "c1", "z", "user", at(0))]
    return chat.current(spark.createDataFrame(rows, MSG))


@pytest.fixture(scope="module")
def chats(spark):
    rows = [("c1", at(0), "u1", None, at(5), False), ("c2", at(0), "u1", "New Chat", at(9), True), ("c3", at(0), "u2", "named", at(1), False)]
    return spark.createDataFrame(rows, "id string, updated_at timestamp_ntz, user_id string, title string, last_message_at timestamp_ntz, is_archived boolean")


def test_current(messages):
    assert messages.count() == 26 and messages.where("id = 'm00'").first()["content"] == "newer"


def test_current_ids_and_columns(spark):
    rows = [("A", at(1), "C1", "x"), ("a", at(2), "c1", "y"), ("b", None, "C2", "z"), ("b", at(0), None, "w")]
    m = spark.createDataFrame(rows, "id string, updated_at timestamp_ntz, chat_id string, content string")
    c = chat.current(m, "id", "chat_id")
    assert sorted(map(tuple, c.collect())) == [("a", "c1"), ("b", None)] and c.columns == ["id", "chat_id"]
    assert "content" not in c._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_title_of_any_user_role(spark):
    m = spark.createDataFrame([("m1", at(0), "c1", "hello", " Human", at(0)), ("m2", at(0), "c1", "hi", "assistant", at(1))], MSG)
    c = spark.createDataFrame([("c1", at(0), "u1", "", at(5), False)], "id string, updated_at timestamp_ntz, user_id string, title string, last_message_at timestamp_ntz, is_archived boolean")
    assert chat.history(c, m).first()["title"] == "hello"


def test_recent(messages):
    got = chat.recent_messages(messages, 3).orderBy("seq").collect()
    assert [r["id"] for r in got] == ["m23", "m22", "m24"] and [r["seq"] for r in got] == [0, 1, 2]


def test_search_counts(messages, chats, rows):
    assert chat.search_messages(messages, "TEXT 1").count() == 11
    assert rows(chat.message_counts(chats, messages)) == [("c1", 25), ("c2", 0), ("c3", 0)]
    assert [len(r["messages"]) for r in chat.latest_lists(chats, messages, 5).orderBy("chat_id").collect()] == [5, 0, 0]
    whole = chat.with_messages(chats, messages)
    assert [(r["pos"], r["id"]) for r in whole.where("chat_id = 'c1'").orderBy("pos").limit(3).collect()] == [(0, "m24"), (1, "m22"), (2, "m23")]
    assert whole.where("chat_id = 'c1'").count() == 25 and rows(whole.where("chat_id > 'c1'").select("chat_id", "id")) == [("c2", None), ("c3", None)]
    assert chat.with_messages(chats, messages.limit(0)).count() == 3


def test_history(messages, chats, rows):
    got = rows(chat.history(chats, messages).select("user_id", "chat_id", "title", "n_messages"))
    assert got == [("u1", "c1", "text 4%", 20), ("u2", "c3", "named", 0)]


def test_updates(spark, messages, chats, rows):
    assert rows(chat.archive_old(chats, at(6), 0).select("id", "is_archived")) == [("c1", True), ("c2", True), ("c3", True)]
    assert chat.delete_old(messages, at(6), 0).count() == 26 - 12
    c, m = chat.delete_chats(chats, messages, spark.createDataFrame([("c1",)], "chat_id string"))
    assert c.count() == 2 and m.count() == 1
    users = spark.createDataFrame([("u1", True), ("u2", True)], "id string, is_active boolean")
    pairs = spark.createDataFrame([("u1", "u2")], "from_id string, to_id string")
    u, c = chat.merge_users(users, chats, pairs)
    assert rows(u) == [("u1", False), ("u2", True)] and c.where("user_id = 'u2'").count() == 3
    assert chat.deactivate(users, spark.createDataFrame([("u2",), ("no",)], "id string")).where("is_active").count() == 1
    asks = spark.createDataFrame([("c1", "u1"), ("c1", "u2"), ("no", "u1")], "chat_id string, user_id string")
    assert rows(chat.owned(chats, asks)) == [("c1", "u1", True), ("c1", "u2", False), ("no", "u1", False)]
    assert chat.touch_chats(chats, messages).where("id = 'c1'").first()["last_message_at"] == at(12)
    assert chat.not_unique(chats, "user_id").first()["n"] == 2
    assert chat.point(chats, "user_id", "u1").count() == 2
    new = spark.createDataFrame([("c1", "n1"), ("c9", "named"), ("c8", "t"), ("c7", "t"), ("c6", None), ("c6", None)], "id string, title string")
    full, rejected = chat.insert(chats, new, ["id", "title"])
    assert full.count() == 5 and rows(rejected) == [("c1", "n1"), ("c6", None), ("c8", "t"), ("c9", "named")]


def test_cache(spark, rows):
    e = spark.createDataFrame([("k", i, at(i * 10)) for i in range(5)] + [("k", 9, at(9000)), (None, 1, at(0))], "key string, item int, ts timestamp_ntz")
    assert rows(cache.bounded(e, "key", ["ts"], 2, "first").select("item", "pos")) == [(0, 0), (1, 1)]
    assert rows(cache.bounded(e, "key", ["ts"], 2).select("item", "pos")) == [(4, 0), (9, 1)]
    with pytest.raises(ValueError):
        cache.bounded(e, "key", ["ts"], 2, "middle")
    assert rows(cache.segments(e.where("key IS NOT NULL"), "key", "ts", ["item"]).groupBy("segment").count()) == [(0, 5), (1, 1)]
    assert cache.segments(e.limit(0), "key", "ts", ["item"]).count() == 0
    many = spark.range(3000).selectExpr("'h' AS key", "id AS item", "timestamp_ntz '2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60 + 4000 * (id div 1000)) AS ts")
    assert rows(cache.segments(many, "key", "ts", ["item"]).groupBy("segment").count()) == [(0, 1000), (1, 1000), (2, 1000)]
    assert cache.live(e, "ts", at(9000)).count() == 1
    assert cache.bounded(e.limit(0), "key", ["ts"]).count() == 0
    a = spark.createDataFrame([("a", 1)], "key string, item int")
    b = spark.createDataFrame([("a", 2), ("b", 3)], "key string, item int")
    assert rows(cache.cache_aside(a, b, "key")) == [("a", 1, "cache"), ("b", 3, "store")]
    assert cache.invalidate(b, a, "key").count() == 1
    lists = cache.bounded(e.where("key IS NOT NULL"), "key", ["ts"], 3)
    merged = cache.merge_lists(lists, spark.createDataFrame([("k", "z")], "from_id string, to_id string"), "key", ["ts"], 2)
    assert rows(merged.select("key", "item", "pos")) == [("z", 4, 0), ("z", 9, 1)]
    lines = spark.createDataFrame([('{"a": 1}',), ("oops",), (None,)], "line string")
    assert rows(cache.rehydrate(lines, "line", "a int")) == [(1,)]


def test_apply_owned(spark, chats, messages, rows):
    asks = [("c1", "u1", "title", "b"), ("c1", "u1", "title", "a"), ("c2", "u1", "delete", None), ("c3", "u1", "archive", None), ("no", "u1", "title", "x"), ("c3", "u2", "sell", None), ("c3", "u2", None, None)]
    c, m, refused = chat.apply_owned(chats, messages, spark.createDataFrame(asks, "chat_id string, user_id string, action string, title string"))
    assert rows(c.select("id", "title", "is_archived")) == [("c1", "a", False), ("c3", "named", False)]
    assert refused.count() == 4 and m.count() == messages.count()
    _, m, _ = chat.apply_owned(chats, messages, spark.createDataFrame([("c1", "u1", "delete", None)], "chat_id string, user_id string, action string, title string"))
    assert m.count() == 1


def test_cache_fill_and_reads(spark, rows):
    a = spark.createDataFrame([("a", 1)], "key string, item int")
    b = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), ("b", 5), (None, 9)], "key string, item int")
    assert rows(cache.filled(a, b, "key", ["item"], 2).select("key", "item", "pos")) == [("a", 1, 0), ("b", 4, 0), ("b", 5, 1)]
    ids = spark.createDataFrame([("u", "x", 0), ("u", "y", 1), ("u", "z", 2)], "key string, id string, pos int")
    entries = spark.createDataFrame([("x", 1), ("z", 3)], "id string, v int")
    assert rows(cache.read_entries(ids, entries, "key", "id", 2).select("id", "v")) == [("x", 1)] and cache.read(ids, "key", 1).count() == 1

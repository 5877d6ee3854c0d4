"""The relational operators of the chat store: users, chats and messages as tables.

Tables may hold rows sent again and ids in either case; ``current`` keeps the latest version of each key, with ids in lower
case, and is what the queries start from. Writes return the whole new table, to be written by ``corvid.sources.sinks``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import canonical_role, conversation_title
from corvid.operators.ranges import numbered

#: Columns that hold UUIDs, which are equal apart from case.
IDS = ("id", "chat_id", "user_id", "sender_id")
RECENT_CHATS, HISTORY_MESSAGES = 5, 20
ARCHIVE_DAYS, DELETE_DAYS = 30, 90


def current(df: DataFrame, *columns: str, key: str = "id", version: str = "updated_at") -> DataFrame:
    """Each key once: the row with the latest version (null is oldest), ties by the columns in order. Null keys are dropped, ids
    are given in lower case. Only the key, the version and the named ``columns`` (all, without any) are read and shuffled."""
    rest = [c for c in columns or df.columns if c not in (key, version)]
    low = df.select(*[F.lower(c).alias(c) if c in IDS else F.col(c) for c in dict.fromkeys([key, version, *rest])])
    x = low.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *rest)).alias("x"))
    return x.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in columns or df.columns])


def point(df: DataFrame, column: str, value) -> DataFrame:
    """At most two rows with the value: more than one means the key is not unique."""
    return df.where(F.col(column) == F.lit(value)).limit(2)


def lookups(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Point lookups of many keys: a semi join."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def anonymous_user(users: DataFrame, anonymous_id: str) -> DataFrame:
    return users.where((F.col("anonymous_id") == anonymous_id) & F.col("is_anonymous"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_of_each(df: DataFrame, key: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``page`` for every key at once, with column ``pos`` (1-based); the per-key limit is pushed below the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).where((F.col("pos") > offset) & (F.col("pos") <= offset + limit))


def newest(*ties: str) -> list[Column]:
    return [F.col(ties[0]).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties[1:]]]


def user_chats(chats: DataFrame, limit: int, offset: int = 0, include_archived: bool = False) -> DataFrame:
    """A page of each user's chats, latest message first."""
    c = chats if include_archived else chats.where(~F.col("is_archived"))
    return page_of_each(c.where("user_id IS NOT NULL"), "user_id", newest("last_message_at", "id"), limit, offset)


def recent_messages(messages: DataFrame, n: int, key: str = "chat_id") -> DataFrame:
    """The newest ``n`` messages of each chat, with ``seq`` from the oldest of them on (0-based)."""
    m = page_of_each(messages.where(F.col(key).isNotNull()), key, newest("created_at", "id"), n)
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    return m.withColumn("seq", (size - F.col("pos")).cast("int")).drop("pos")


def search_messages(messages: DataFrame, keyword: str, limit: int = 50) -> DataFrame:
    """The newest messages of each chat whose content holds the keyword, by ILIKE: % and _ in it are wildcards."""
    hit = messages.where(F.col("chat_id").isNotNull() & F.ilike("content", F.lit(f"%{keyword}%")))
    return page_of_each(hit, "chat_id", newest("created_at", "id"), limit)


def message_counts(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_id, n) for every chat, zero included."""
    n = messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))
    return chats.select(F.col("id").alias("chat_id")).join(n, "chat_id", "left").select("chat_id", F.coalesce("n", F.lit(0)).alias("n"))


def chat_counts(users: DataFrame, chats: DataFrame) -> DataFrame:
    """(user_id, n_all, n_open) for every user."""
    n = chats.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(~F.col("is_archived")).alias("n_open"))
    return users.select(F.col("id").alias("user_id")).join(n, "user_id", "left").select("user_id", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("n_open", F.lit(0)).alias("n_open"))


def user_stats(users: DataFrame, chats: DataFrame) -> DataFrame:
    """Profile and number of chats of every user."""
    n = chats.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("chat_count"))
    return users.select("id", "username", "is_active", "is_anonymous").join(n, "id", "left").withColumn("chat_count", F.coalesce("chat_count", F.lit(0)))


def with_messages(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_id, pos, id, role, created_at): every chat with all its messages, newest first (``pos`` from 0, ties by id); a chat
    without messages has one row of nulls. Rows rather than a list, numbered range by range, so that no task holds a whole chat."""
    m = messages.where("chat_id IS NOT NULL").select("chat_id", "id", "role", "created_at")
    m = numbered(m, ["chat_id"], [F.col("created_at").desc_nulls_last(), F.col("id")], "pos")
    return chats.select(F.col("id").alias("chat_id")).join(m, "chat_id", "left").select("chat_id", "pos", "id", "role", "created_at")


def latest_lists(chats: DataFrame, messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """(chat_id, messages): each chat with its newest ``n`` messages as a list of (created_at, id, role), newest first; [] without."""
    m = page_of_each(messages.where("chat_id IS NOT NULL"), "chat_id", newest("created_at", "id"), n)
    g = m.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("pos", "created_at", "id", "role"))).alias("messages"))
    g = g.select("chat_id", F.transform("messages", lambda x: F.struct(x["created_at"].alias("created_at"), x["id"].alias("id"), x["role"].alias("role"))).alias("messages"))
    empty = F.array().cast(dict(g.dtypes)["messages"])
    return chats.select(F.col("id").alias("chat_id")).join(g, "chat_id", "left").select("chat_id", F.coalesce("messages", empty).alias("messages"))


def history(chats: DataFrame, messages: DataFrame, n_chats: int = RECENT_CHATS, n_messages: int = HISTORY_MESSAGES) -> DataFrame:
    """(user_id, pos, chat_id, title, n_messages): each user's recent open chats with the view's title: the chat's own, else
    the first user message among the newest ``n_messages``, however the role is written."""
    recent = user_chats(chats, n_chats).select("user_id", "pos", F.col("id").alias("chat_id"), "title")
    m = recent_messages(messages.join(recent.select("chat_id"), "chat_id", "left_semi"), n_messages)
    asked = canonical_role("role") == "user"
    first = m.groupBy("chat_id").agg(F.min_by(F.when(asked, F.col("content")), F.when(asked, F.col("seq"))).alias("first"), F.count(F.lit(1)).alias("n"))
    return recent.join(first, "chat_id", "left").select("user_id", "pos", "chat_id", conversation_title("title", "first").alias("title"), F.coalesce("n", F.lit(0)).alias("n_messages"))


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """UPDATE ... SET values WHERE condition; a null condition updates nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def archive_old(chats: DataFrame, as_of: dt.datetime, days: int = ARCHIVE_DAYS) -> DataFrame:
    """Chats with those archived whose last message is older than ``days`` before ``as_of``."""
    old = (F.col("last_message_at") < F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")) & ~F.col("is_archived")
    return set_where(chats, old, is_archived=True)


def delete_old(messages: DataFrame, as_of: dt.datetime, days: int = DELETE_DAYS) -> DataFrame:
    """Messages without those created more than ``days`` before ``as_of``; messages without a time stay."""
    return messages.where(~F.coalesce(F.col("created_at") < F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz"), F.lit(False)))


def delete_chats(chats: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chats, messages) without the chats of ``gone`` (chat_id) and, by cascade, without their messages."""
    g = gone.select("chat_id").distinct()
    return chats.join(g.withColumnRenamed("chat_id", "id"), "id", "left_anti"), messages.join(g, "chat_id", "left_anti")


def deactivate(users: DataFrame, gone: DataFrame) -> DataFrame:
    """Users with those of ``gone`` (id) inactive; unknown ids change nothing."""
    g = gone.select("id").distinct().withColumn("_gone", F.lit(True))
    return set_where(users.join(g, "id", "left"), F.col("_gone"), is_active=False).select(*users.columns)


def merge_users(users: DataFrame, chats: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, chats) after merging each pair (from_id, to_id): chats move to the target, the source is deactivated.
    Messages keep their sender. Of several targets of one source the smallest counts."""
    p = pairs.groupBy("from_id").agg(F.min("to_id").alias("to_id"))
    moved = chats.join(p.withColumnRenamed("from_id", "user_id"), "user_id", "left").withColumn("user_id", F.coalesce("to_id", "user_id")).drop("to_id").select(*chats.columns)
    gone = users.join(p.select(F.col("from_id").alias("id")).withColumn("gone", F.lit(True)), "id", "left")
    return set_where(gone, F.col("gone"), is_active=False).drop("gone").select(*users.columns), moved


def insert(df: DataFrame, rows: DataFrame, unique: list[str] = ["id"]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(table, rejected): ``rows`` added to the table, but for those whose value in a ``unique`` column the table or an earlier row
    (by ``unique`` order) has already. Nulls never clash; missing columns are null."""
    new = rows
    for c in unique:
        have = df.where(F.col(c).isNotNull()).select(c).distinct().withColumn("_have", F.lit(True))
        first = Window.partitionBy(c).orderBy(*unique)
        named = new.where(F.col(c).isNotNull()).join(have, c, "left").withColumn("_n", F.row_number().over(first)).where("_have IS NULL AND _n = 1").drop("_have", "_n")
        new = named.select(*rows.columns).unionByName(new.where(F.col(c).isNull()))
    rejected = rows.exceptAll(new)
    return df.unionByName(new, allowMissingColumns=True), rejected


def not_unique(df: DataFrame, column: str) -> DataFrame:
    """(value, n): values of the column that several rows share."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def owned(chats: DataFrame, asks: DataFrame) -> DataFrame:
    """(chat_id, user_id, owned): whether the asking user owns the chat; false for unknown chats."""
    c = chats.select(F.col("id").alias("chat_id"), F.col("user_id").alias("owner"))
    return asks.join(c, "chat_id", "left").select("chat_id", "user_id", F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)).alias("owned"))


def apply_owned(chats: DataFrame, messages: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chats, messages, refused) after the asks (chat_id, user_id, action, title) of users to give a chat a ``title``, to ``archive``
    or to ``delete`` it, with its messages. Asks for unknown chats, by others than the owner or of any other action are refused.
    Of several titles for a chat the smallest counts; a deletion goes before all else. What a cache holds of the chats that
    were asked for has to go (``cache.invalidate``)."""
    own = owned(chats, asks.select("chat_id", "user_id").distinct()).where("owned").select("chat_id", "user_id")
    known = F.col("action").isin("title", "archive", "delete")
    good = asks.where(known).join(own, ["chat_id", "user_id"], "left_semi")
    refused = asks.where(~F.coalesce(known, F.lit(False))).unionByName(asks.where(known).join(own, ["chat_id", "user_id"], "left_anti"))
    per = good.groupBy(F.col("chat_id").alias("id")).agg(
        F.min(F.when(F.col("action") == "title", F.col("title"))).alias("_title"), F.max(F.col("action") == "archive").alias("_archive"), F.max(F.col("action") == "delete").alias("_gone")
    )
    new = chats.join(per, "id", "left").where(~F.coalesce("_gone", F.lit(False)))
    new = new.withColumns({"title": F.coalesce("_title", "title"), "is_archived": F.col("is_archived") | F.coalesce("_archive", F.lit(False))}).select(*chats.columns)
    gone = per.where("_gone").select(F.col("id").alias("chat_id"))
    return new, messages.join(gone, "chat_id", "left_anti"), refused.select(*asks.columns)


def touch_chats(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with last_message_at brought up to their latest message."""
    last = messages.groupBy(F.col("chat_id").alias("id")).agg(F.max("created_at").alias("_last"))
    return chats.join(last, "id", "left").withColumn("last_message_at", F.greatest("last_message_at", "_last")).select(*chats.columns)


def valid_messages(messages: DataFrame, low: int = 1, high: int = 2000) -> DataFrame:
    return messages.where(F.length("content").between(low, high))

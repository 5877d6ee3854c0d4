"""Rebuilding conversations from message rows.

``connected_components`` is the alternating large-star / small-star algorithm on an edge table; only
messages that lack a conversation identifier enter it, over their reply and quote links.
``conversations`` gives every message its conversation, ``validate`` judges each conversation.

No step sorts a whole conversation in one task: messages are first counted per instant, instants are
cut into ranges by (conversation, time), each range is summarised, and the few summaries are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import canonical_role
from corvid.functions.text import strip as stripped
from corvid.operators.ranges import numbered
from corvid.session import stage

#: JSON keys of meta_info that name another message.
LINK_KEYS = ("reply_to", "in_reply_to", "quote_of", "parent_id")

def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns (node, component) for an undirected edge table (a, b); component is the smallest node.

    Alternates large-star (every larger neighbour of a node is tied to the smallest neighbour) and
    small-star (every smaller neighbour is tied to the smallest) until no edge changes. Each round is
    two shuffles over the edges; the round's edges are written to the shared folder. Self links and
    repeated edges are dropped, edges with a null end are ignored, an empty table gives an empty result.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .where("u <> v")
        .distinct()
    )
    e = stage(e, "cc")
    sign = None
    for _ in range(max_rounds):
        now = e.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        if now == sign or not now["n"]:
            break
        sign = now
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stage(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct(),
            "cc",
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def latest(messages: DataFrame) -> DataFrame:
    """One row per message id: the version with the latest updated_at (null is oldest; ties by the columns in order, ``text``, a
    hash of the content, last)."""
    cols = ["chat_id", "role", "message_type", "created_at", "blank", "links", "text"]
    small = messages.select(
        "id",
        "updated_at",
        F.lower("chat_id").alias("chat_id"),
        canonical_role(F.col("role")).alias("role"),
        F.lower(stripped(F.col("message_type"))).alias("message_type"),
        "created_at",
        F.coalesce(~F.col("content").rlike(r"(?U)\S"), F.lit(True)).alias("blank"),
        F.when(
            F.col("chat_id").isNull() | F.greatest(*[F.contains("meta_info", F.lit(f'"{k}"')) for k in LINK_KEYS]),
            F.array_compact(F.array(*[F.get_json_object("meta_info", f"$.{k}") for k in LINK_KEYS])),
        ).alias("links"),
        F.xxhash64("content").alias("text"),
    )
    key = F.struct("updated_at", *[c for c in cols])
    return small.groupBy("id").agg(F.max(key).alias("x")).select("id", *[f"x.{c}" for c in cols])


def conversations(messages: DataFrame, extra_links: DataFrame | None = None) -> DataFrame:
    """Each message id once, with ``conversation``: its chat_id in lower case or, lacking one, that of its component; ``chat`` is the
    chat among these, null where a component touches none.

    A message without chat_id belongs to the component it forms with other messages over reply and
    quote links (``LINK_KEYS`` in meta_info, or ``extra_links`` (a, b)); a component that touches a chat
    takes that chat (the smallest id of several), else the smallest message id. Null ids, malformed
    meta_info and links to unknown messages do no harm: they add nothing.
    """
    m = latest(messages.where(F.col("id").isNotNull()))
    m = stage(m, "messages")
    links = m.where(F.size("links") > 0).select(F.col("id").alias("a"), F.explode("links").alias("b"))
    if extra_links is not None:
        links = links.unionByName(extra_links.select("a", "b"))
    lost = m.where("chat_id IS NULL").select("id")
    links = links.join(m.select(F.col("id").alias("b")), "b", "left_semi")
    open_links = links.join(lost.withColumnRenamed("id", "a"), "a", "left_semi").unionByName(
        links.join(lost.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    )
    part = connected_components(open_links)
    named = (
        part.join(m.select(F.col("id").alias("node"), "chat_id"), "node")
        .groupBy("component")
        .agg(F.min("chat_id").alias("named"))
    )
    found = part.join(named, "component").select(F.col("node").alias("id"), F.coalesce("named", "component").alias("found"), F.col("named").alias("chat"))
    rest = m.where("chat_id IS NULL").join(found, "id", "left").withColumn("conversation", F.coalesce("found", "id")).drop("found")
    own = m.where("chat_id IS NOT NULL").withColumn("conversation", F.col("chat_id")).withColumn("chat", F.col("chat_id"))
    return own.unionByName(rest).drop("links")


def turn_faults(m: DataFrame) -> DataFrame:
    """(conversation) of every conversation whose user and assistant messages are not strict turns.

    ``m`` has conversation, role and created_at. Messages of one instant are counted first, so ties cost
    nothing; more than one of a role at one instant is a fault, since equal roles then meet. The instants
    are range-partitioned by (conversation, time): one huge conversation spans many tasks, each range keeps
    its first and last role, and the ranges of a conversation are compared in order.
    """
    at = (
        m.where(F.col("role").isin("user", "assistant") & F.col("created_at").isNotNull())
        .groupBy("conversation", "created_at")
        .agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    )
    parts = at.repartitionByRange("conversation", "created_at").withColumn("range", F.spark_partition_id())
    w = Window.partitionBy("conversation", "range").orderBy("created_at")
    first = F.when(F.col("u") > 0, "u").otherwise("a")
    last = F.when(F.col("a") > 0, "a").otherwise("u")
    runs = (
        parts.withColumn("before", F.lag(last).over(w))
        .withColumn("bad", (F.col("u") > 1) | (F.col("a") > 1) | F.coalesce(F.col("before") == first, F.lit(False)))
        .groupBy("conversation", "range")
        .agg(
            F.min_by(first, "created_at").alias("first"),
            F.max_by(last, "created_at").alias("last"),
            F.max("bad").alias("bad"),
        )
    )
    w = Window.partitionBy("conversation").orderBy("range")
    return (
        runs.withColumn("before", F.lag("last").over(w))
        .groupBy("conversation")
        .agg(
            F.max(F.col("bad") | (F.coalesce("before", F.lit("a")) == F.col("first"))).alias("bad"),
            F.max_by("last", "range").alias("end"),
        )
        .where("bad OR end <> 'a'")
        .select("conversation")
    )


def broken(chats: DataFrame, m: DataFrame) -> DataFrame:
    """(conversation) of every conversation to drop, out of those of ``m`` and all ids in ``chats.id``.

    Kept is a conversation whose messages all have a time, a content and a known role, and whose user and assistant messages
    alternate user first, assistant last, without an answer of type error; one with a chat_id must also be in chats.
    """
    each = m.groupBy("conversation").agg(
        F.max(
            F.col("created_at").isNull()
            | F.col("blank")
            | F.col("role").isNull()
            | ((F.col("role") == "assistant") & F.coalesce(F.col("message_type") == "error", F.lit(False)))
        ).alias("bad"),
        F.count_if(F.col("role") == "user").alias("users"),
        F.max(F.col("chat_id").isNotNull()).alias("named"),
    )
    known = chats.where(F.col("id").isNotNull()).select(F.lower("id").alias("conversation")).distinct().withColumn("known", F.lit(True))
    faults = turn_faults(m).withColumn("fault", F.lit(True))
    unknown = F.col("known").isNull() & F.col("named")
    return (
        known.join(each, "conversation", "full")
        .join(faults, "conversation", "left")
        .where(unknown | F.col("bad").isNull() | F.col("bad") | (F.col("users") == 0) | F.col("fault").isNotNull())
        .select("conversation")
    )


def dropped(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_id) of every chat to drop, out of all ids in ``chats.id`` and ``messages.chat_id``.

    Chats are judged as in ``broken`` by the messages that name them: messages without chat_id count for none, so no components
    are built. Empty tables, chats without messages and ids of either case are handled; null ids are no chats.
    """
    m = stage(latest(messages.where(F.col("id").isNotNull())).drop("links", "text"), "messages").where("chat_id IS NOT NULL")
    return broken(chats, m.withColumn("conversation", F.col("chat_id"))).withColumnRenamed("conversation", "chat_id")


def not_rebuilt(chats: DataFrame, messages: DataFrame, extra_links: DataFrame | None = None) -> DataFrame:
    """(chat_id) of every chat to drop, out of all ids in ``chats.id`` and ``messages.chat_id``: those that ``rebuilt`` does not give.

    Unlike in ``dropped`` a chat is judged with the messages without chat_id that links lead to it. Components without a chat are
    no chats, also where a message id reads like the id of one.
    """
    m = conversations(messages, extra_links).where("chat IS NOT NULL").drop("conversation", "text").withColumnRenamed("chat", "conversation")
    return broken(chats, stage(m, "conversations")).withColumnRenamed("conversation", "chat_id")


def rebuilt(chats: DataFrame, messages: DataFrame, extra_links: DataFrame | None = None) -> DataFrame:
    """The messages of kept conversations: conversation, turn (0-based, ordered), id, role, created_at, content.

    Conversations are those of ``conversations``: messages without chat_id are judged and numbered with the chat their links
    lead to, or as a conversation of their own. One huge conversation is numbered by many tasks.
    """
    m = stage(conversations(messages, extra_links).drop("chat"), "conversations")
    m = m.join(broken(chats, m), "conversation", "left_anti")
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    m = m.select("conversation", "created_at", rank.alias("k"), "id", "role", "text")
    turns = numbered(m, ["conversation"], [F.col(c) for c in ("created_at", "k", "id")], "turn")
    # The content of the version that was judged.
    text = messages.where(F.col("id").isNotNull()).select("id", F.xxhash64("content").alias("text"), "content").groupBy("id", "text").agg(F.first("content").alias("content"))
    return turns.join(text, ["id", "text"]).select("conversation", "turn", "id", "role", "created_at", "content")


def following_links(messages: DataFrame) -> DataFrame:
    """(a, b): each message without a chat and the message its sender wrote before it, for stores that keep no other links."""
    m = messages.where("id IS NOT NULL AND sender_id IS NOT NULL AND created_at IS NOT NULL").groupBy("id").agg(F.max(F.struct("updated_at", "sender_id", "created_at", "chat_id")).alias("x"))
    m = stage(numbered(m.select("id", "x.sender_id", "x.created_at", "x.chat_id"), ["sender_id"], [F.col("created_at"), F.col("id")], "n"), "senders")
    before = m.select("sender_id", (F.col("n") + 1).alias("n"), F.col("id").alias("b"))
    return m.where("chat_id IS NULL").select("sender_id", "n", F.col("id").alias("a")).join(before, ["sender_id", "n"]).select("a", "b")

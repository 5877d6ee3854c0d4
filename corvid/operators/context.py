"""Assembly of a bounded prompt context from ranked documents, and the messages around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import canonical_role

#: Messages before the question that go into its prompt.
HISTORY = 10
MAX_DOCS, MAX_DOC_CHARS, MAX_CHARS = 10, 2000, 20_000
# The words of the context's text.
DOC_CUT, TOTAL_CUT, NO_DOCS = "\n...[内容已截断]", "\n...[上下文已截断]", "没有找到相关的文档内容。"
RULE = "-" * 50


def context_parts(docs: DataFrame, content: str = "content", max_docs: int = MAX_DOCS, max_doc: int = MAX_DOC_CHARS, max_total: int = MAX_CHARS) -> DataFrame:
    """(query_id, rank, part, n_chars_used, cut) for ranked documents (query_id, rank, file_path, score, content).

    Each document's text is cut to ``max_doc`` characters; the first part that overflows ``max_total`` is cut and is the
    last. The marker of a cut text counts towards the total, separators and the final marker do not. Ranks count from 1.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    d = docs.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max_docs)
    c = F.coalesce(F.col(content), F.lit(""))
    body = F.when(F.length(c) > max_doc, F.concat(F.substring(c, 1, max_doc), F.lit(DOC_CUT))).otherwise(c) if max_doc > 0 else c
    head = F.concat(F.lit("文档 "), F.col("_i").cast("string"), F.lit(": "), F.coalesce("file_path", F.concat(F.lit("文档 "), F.col("_i").cast("string"))), F.lit("\n相关度: "), F.format_string("%.3f", F.coalesce("score", F.lit(0.0))), F.lit("\n"))
    d = d.withColumn("_part", F.concat(head, F.lit("内容: "), body, F.lit("\n" + RULE)))
    before = F.coalesce(F.sum(F.length("_part")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_before", before).where(F.col("_before") < max_total) if max_total > 0 else d.withColumn("_before", before)
    over = (F.col("_before") + F.length("_part") > max_total) if max_total > 0 else F.lit(False)
    used = F.when(over, F.lit(max_total) - F.col("_before")).otherwise(F.length("_part"))
    part = F.when(over, F.concat(F.substr("_part", F.lit(1), (F.lit(max_total) - F.col("_before")).cast("int")), F.lit(TOTAL_CUT))).otherwise(F.col("_part"))
    return d.select("query_id", F.col("_i").alias("rank"), part.alias("part"), used.cast("bigint").alias("n_chars_used"), over.alias("cut"))


def context(docs: DataFrame, queries: DataFrame, **limits) -> DataFrame:
    """(query_id, context): the parts of each query joined by blank lines; a fixed sentence for queries without documents."""
    joined = context_parts(docs, **limits).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
    return queries.select("query_id").distinct().join(joined, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_DOCS)).alias("context"))


def prompt(system: str, history, context_text, question):
    """Column: array of (role, content): system, the history, then the question with its context."""
    user = F.concat(F.lit("Context:\n"), context_text, F.lit("\n\nQuestion: "), question)
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.concat(one("system", F.lit(system)), history, one("user", user))


def histories(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """(chat_id, question, history): of each chat the newest user message and up to ``n`` messages before it, oldest first, as
    (role, content) in canonical roles. Messages of unknown role or without content are no part of a prompt; chats without a user
    message have no row. Only the newest messages of a chat are gathered: its list is bounded."""
    m = messages.select("chat_id", "id", "created_at", canonical_role("role").alias("role"), "content").where("chat_id IS NOT NULL AND role IN ('user', 'assistant') AND content IS NOT NULL")
    order = [F.col("created_at").desc_nulls_last(), F.col("id")]
    asked = m.where("role = 'user'").withColumn("_r", F.row_number().over(Window.partitionBy("chat_id").orderBy(*order))).where("_r = 1")
    asked = asked.select("chat_id", F.col("created_at").alias("_at"), F.col("id").alias("_id"), F.col("content").alias("question"))
    older = F.coalesce(F.col("created_at") < F.col("_at"), F.col("created_at").isNull() & F.col("_at").isNotNull()) | (F.col("created_at").eqNullSafe(F.col("_at")) & (F.col("id") > F.col("_id")))
    before = m.join(asked.drop("question"), "chat_id").where(older)
    before = before.withColumn("_r", F.row_number().over(Window.partitionBy("chat_id").orderBy(*order))).where(F.col("_r") <= n)
    g = before.groupBy("chat_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("_r", "role", "content")))).alias("h"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    history = F.coalesce(F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), none)
    return asked.select("chat_id", "question").join(g, "chat_id", "left").select("chat_id", "question", history.alias("history"))


def source_list(docs: DataFrame) -> DataFrame:
    """(query_id, sources): JSON list of title, id, content, url, score of each query's documents in rank order; url is left out
    where there is none."""
    url = F.col("url") if "url" in docs.columns else F.lit(None).cast("string")
    item = F.struct("rank", F.col("file_path").alias("title"), F.col("key").alias("id"), "content", url.alias("url"), "score")
    return docs.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["title"], x["id"], x["content"], x["url"], x["score"]))).alias("sources"))


def stream_events(answers: DataFrame, piece: int = 20) -> DataFrame:
    """(query_id, seq, event, data): the event rows of streamed answers: meta first, deltas of ``piece`` characters, then done;
    an error row instead of what follows it for rows with ``error`` set."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length("answer") - 1, F.lit(0)), F.lit(piece)), lambda i: F.struct(F.lit("delta").alias("event"), F.to_json(F.struct(F.substr("answer", i + 1, F.lit(piece)).alias("content"))).alias("data")))
    one = lambda e, d: F.array(F.struct(F.lit(e).alias("event"), d.alias("data")))
    body = F.when(F.col("error").isNotNull(), one("error", F.to_json(F.struct(F.col("error").alias("message"))))).otherwise(
        F.concat(F.filter(pieces, lambda x: F.length(F.get_json_object(x["data"], "$.content")) > 0), one("done", F.lit("{}")))
    )
    rows = answers.withColumn("answer", F.coalesce("answer", F.lit(""))).select("query_id", F.posexplode(F.concat(one("meta", F.to_json(F.struct("query_id"))), body)).alias("seq", "e"))
    return rows.select("query_id", "seq", "e.event", "e.data")

"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.llm import boilerplate, conversations, leakage, near_duplicates, neighbours, splitting, subjects, tokens
from corvid.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_lines(table(spark, d, "raw_docs"))


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, d, "raw_docs"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Every message's conversation, with the sender's message before it as the link of one without a chat."""
    m = table(spark, d, "messages")
    return conversations.conversations(m, conversations.following_links(m)).select("id", "conversation")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.not_rebuilt(table(spark, d, "chats"), table(spark, d, "messages"))


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuilt(table(spark, d, "chats"), table(spark, d, "messages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks")).where("chunk_index = 1").select("id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks"))


def _cover(pieces: DataFrame) -> DataFrame:
    """(id, hash, linked): the hash of the text that the pieces make without their overlaps, and whether each begins within the last 100
    characters of the one before it, or at its end."""
    end = F.col("start") + F.length("content")
    w = Window.partitionBy("id").orderBy("chunk_index")
    p = pieces.withColumn("before", F.coalesce(F.lag(end).over(w), F.lit(0)))
    ok = (F.col("before") >= F.col("start")) & (F.col("start") >= F.col("before") - 100) & (F.length("content") > 0)
    new = F.substr("content", F.col("before") - F.col("start") + 1)
    p = p.select("id", "chunk_index", ok.alias("ok"), new.alias("new"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "new"))), lambda x: x["new"]), "")
    return p.groupBy("id").agg(F.md5(text).alias("hash"), F.every("ok").alias("linked"))


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    p = splitting.pieces(table(spark, d, "chunks"))
    return _cover(p).join(p.groupBy("id").agg((F.max(F.length("content")) <= splitting.LIMIT).alias("within")), "id")


#: Tokens for cutting by count: runs of ASCII letters and digits, every other character one.
UNIT = "[A-Za-z0-9]+|[^A-Za-z0-9]"


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Items of more than 256 tokens cut within 256 tokens, 16 shared, and how they hold together."""
    p = splitting.pieces(table(spark, d, "chunks"), limit=256, overlap=16, unit=UNIT)
    size = F.size(F.regexp_extract_all("content", F.lit(UNIT), F.lit(0)))
    return _cover(p).drop("linked").join(p.groupBy("id").agg((F.max(size) <= 256).alias("within")), "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "chunks"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    # Ids are no numbers here: a query is an id whose last eight hex digits spell a number divisible by 100.
    asked = c.where(F.conv(F.right("id", F.lit(8)), 16, 10).cast("bigint") % 100 == 0)
    return neighbours.nearest_of(c, asked).withColumn("cosine", F.round("cosine", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_pairs(table(spark, d, "chunks"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_groups(table(spark, d, "chunks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    ids = tokens.encode(table(spark, d, "documents"))
    return tokens.decode(ids).select("doc_id", F.md5("text").alias("hash"))


def p7_short(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold six consecutive words of an item, or a whole item of three to five."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), run=6, least=3)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"), table(spark, d, "eval_items"))


def p8_weights(spark: SparkSession, d: str) -> DataFrame:
    s = subjects.Subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"), table(spark, d, "eval_items"))
    return s.weights().withColumn("weight", F.round("weight", 4))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p8_found(spark, d), table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_bodies, p2_found, p2_rebuilt, p2_conversations, p3_found, p3_pieces, p3_cover, p3_tokens, p4_found, p4_neighbours, p5_found, p5_groups,
        p6_ids, p6_decoded, p7_found, p7_short, p8_found, p8_weights, p8_composition,
    )
}

_EDGE = r"^[\s\v\p{Z}\x{85}]+|[\s\v\p{Z}\x{85}]+$"
_WORDS = r"regexp_extract_all({}, '[\x{{4E00}}-\x{{9FFF}}]|(?:[^\P{{L}}\x{{4E00}}-\x{{9FFF}}]|\p{{N}})+')"
_GRAMS = "(SELECT {0}, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: lower(array_to_string(w[i:i+11], ' ')))) AS g FROM (SELECT {0}, {1} AS w FROM {2}))"

_VERSIONS = rf"""v AS (SELECT *, lower(chat_id) AS c, lower(regexp_replace(role, '{_EDGE}', '', 'g')) AS r, lower(regexp_replace(message_type, '{_EDGE}', '', 'g')) AS t
        FROM messages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, c DESC NULLS LAST, r DESC NULLS LAST) = 1),
    m AS (SELECT c, id, content, created_at, t, CASE WHEN r IN ('user', 'human', 'customer') THEN 1 WHEN r IN ('assistant', 'ai', 'bot') THEN 2 WHEN r = 'system' THEN 0 END AS k,
        content IS NULL OR NOT regexp_matches(content, '[^\s\v\p{{Z}}\x{{85}}]') AS blank FROM v WHERE c IS NOT NULL),
    b AS (SELECT c, bool_or(created_at IS NULL OR blank OR k IS NULL OR k = 2 AND coalesce(t = 'error', false)) AS bad FROM m GROUP BY c),
    s AS (SELECT c, k, row_number() OVER (PARTITION BY c ORDER BY created_at, k) AS n FROM m WHERE k > 0),
    o AS (SELECT c FROM s GROUP BY c HAVING count(*) % 2 = 0 AND bool_and(k = CASE WHEN n % 2 = 1 THEN 1 ELSE 2 END)),
    u AS (SELECT DISTINCT lower(id) AS c FROM chats WHERE id IS NOT NULL)"""
_OVERSIZED = f"(SELECT id, min(regexp_replace(content, '{_EDGE}', '', 'g')) AS c FROM chunks WHERE id IS NOT NULL GROUP BY id)"
_SHORT = "(SELECT {0}, w, unnest(list_transform(range(1, greatest(len(w) - {2}, 1)), lambda i: lower(array_to_string(w[i:i+{3}], ' ')))) AS g FROM (SELECT {0}, {1} AS w FROM {4}))"

# All pairs exactly, by the rarest of each text's shingles.
_NEAR = r"""WITH RECURSIVE n AS (SELECT DISTINCT id, trim(regexp_replace(lower(content), '[\s\v\p{Z}\x{85}]+', ' ', 'g'), ' ') AS t FROM chunks WHERE id IS NOT NULL),
    x AS (SELECT id, t FROM n WHERE length(t) >= 300), u AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM x)),
    g AS MATERIALIZED (SELECT DISTINCT k, unnest(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS g FROM u),
    f AS (SELECT g, count(*) AS df FROM g GROUP BY g),
    r AS MATERIALIZED (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY df, g) AS r, count(*) OVER (PARTITION BY k) AS c FROM g JOIN f USING (g)),
    p AS (SELECT k, g, c FROM r WHERE r <= c - ceil(0.7 * c) + 1),
    cand AS (SELECT DISTINCT a.k AS a, b.k AS b, a.c AS ca, b.c AS cb FROM p a JOIN p b ON a.g = b.g AND a.k < b.k AND a.c >= 0.7 * b.c AND b.c >= 0.7 * a.c),
    s AS MATERIALIZED (SELECT a, b FROM cand JOIN g x ON x.k = a JOIN g y ON y.k = b AND y.g = x.g GROUP BY a, b, ca, cb HAVING count(*) / (ca + cb - count(*)) >= 0.7),"""
_NEAR_PAIRS = _NEAR + """ m AS (SELECT id, k FROM x JOIN u USING (t)) SELECT DISTINCT least(i.id, j.id) AS id_a, greatest(i.id, j.id) AS id_b FROM
    (SELECT a, b FROM s UNION ALL SELECT k, k FROM u) JOIN m i ON i.k = a JOIN m j ON j.k = b WHERE i.id <> j.id"""
_NEAR_GROUPS = _NEAR + """ e AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s), reach(k, root) AS (SELECT k, k FROM u UNION SELECT e.b, root FROM reach JOIN e ON e.a = reach.k),
    c AS (SELECT k, min(root) AS c FROM reach GROUP BY k), m AS (SELECT id, c FROM x JOIN u USING (t) JOIN c USING (k)), low AS (SELECT c, min(id) AS low FROM m GROUP BY c)
    SELECT id, min(low) AS "group" FROM m JOIN low USING (c) GROUP BY id"""

SQL: dict[str, str] = {
    "p2_found": f"WITH {_VERSIONS} SELECT c AS chat_id FROM (SELECT c FROM u UNION SELECT c FROM m) WHERE c NOT IN (SELECT u.c FROM u JOIN b ON b.c = u.c AND NOT bad JOIN o ON o.c = u.c)",
    "p2_rebuilt": f"""WITH {_VERSIONS}, good AS (SELECT u.c FROM u JOIN b ON b.c = u.c AND NOT bad JOIN o ON o.c = u.c)
        SELECT c AS conversation, row_number() OVER (PARTITION BY c ORDER BY created_at, k, id) - 1 AS turn, id, ['system', 'user', 'assistant'][k + 1] AS role, created_at, content FROM m WHERE c IN (SELECT c FROM good)""",
    # A run of messages without chat goes with the sender's message before it; without one it is named by its smallest id.
    "p2_conversations": """WITH v AS (SELECT * FROM messages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, lower(chat_id) DESC NULLS LAST) = 1),
        w AS (SELECT id, lower(chat_id) AS c, sender_id, created_at, row_number() OVER (PARTITION BY sender_id ORDER BY created_at, id) AS n FROM v WHERE sender_id IS NOT NULL AND created_at IS NOT NULL),
        r AS (SELECT *, coalesce(max(CASE WHEN c IS NOT NULL THEN n END) OVER (PARTITION BY sender_id ORDER BY n), 0) AS run FROM w),
        g AS (SELECT id, coalesce(max(c) OVER (PARTITION BY sender_id, run), min(id) OVER (PARTITION BY sender_id, run)) AS conversation FROM r)
        SELECT id, conversation FROM g UNION ALL SELECT id, coalesce(lower(chat_id), id) FROM v WHERE id NOT IN (SELECT id FROM g)""",
    "p3_found": f"SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND length(regexp_replace(content, '{_EDGE}', '', 'g')) > 1024",
    "p3_cover": f"SELECT id, md5(c) AS hash, true AS linked, true AS within FROM {_OVERSIZED} WHERE length(c) > 1024",
    "p3_tokens": f"SELECT id, md5(c) AS hash, true AS within FROM {_OVERSIZED} WHERE len(regexp_extract_all(c, '{UNIT}')) > 256",
    "p5_found": _NEAR_PAIRS,
    "p5_groups": _NEAR_GROUPS,
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents",
    "p7_short": f"""SELECT DISTINCT doc_id, item_id FROM {_SHORT.format('doc_id', _WORDS.format('text'), 4, 5, 'documents')} JOIN {_SHORT.format('item_id', _WORDS.format('text'), 4, 5, 'eval_items')} USING (g)
        UNION SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || lower(array_to_string(w, ' ')) || ' ' AS d FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents))
        JOIN (SELECT item_id, ' ' || lower(array_to_string(w, ' ')) || ' ' AS i FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items) WHERE len(w) BETWEEN 3 AND 5) ON contains(d, i)""",
    "p4_neighbours": """WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS v FROM chunks WHERE id IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0), u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v)
        SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) / (a.n * b.n) DESC, b.id)::INT AS rank, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS cosine
        FROM u a JOIN u b ON a.id <> b.id WHERE ('0x' || right(a.id, 8))::BIGINT % 100 = 0 QUALIFY rank <= 10""",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_GRAMS.format('doc_id', _WORDS.format('text'), 'documents')} JOIN {_GRAMS.format('item_id', _WORDS.format('text'), 'eval_items')} USING (g)",
}

"""The engine's queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.functions import vectors as V
from corvid.operators import cache, chat, chunking, code, context, fusion, keyword, vectors
from corvid.plans import pipeline, retrieval
from corvid.session import stage, table
from corvid.sources import crawl, files, sinks
from corvid.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}

AS_OF = dt.datetime(2025, 9, 1)
#: Columns of the versioned tables behind key and version, in the order that breaks ties.
REST = {
    "messages": ["chat_id", "content", "message_type", "role", "sender_id", "created_at", "meta_info"],
    "chats": ["user_id", "title", "created_at", "last_message_at", "is_archived"],
    "users": ["username", "email", "password_hash", "is_active", "is_anonymous", "anonymous_id", "created_at"],
}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def current_sql(name: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ["updated_at", *REST[name]])
    low = ", ".join(f"lower({c}) AS {c}" for c in ["id", *REST[name]] if c in chat.IDS)
    return f"(SELECT * FROM (SELECT * REPLACE ({low}) FROM {name} WHERE id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY {order}) = 1)"


MESSAGES, CHATS, USERS = (current_sql(n) for n in ("messages", "chats", "users"))
PAGES = (
    "(SELECT * FROM raw_docs WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY fetched_at DESC NULLS LAST, "
    "url DESC NULLS LAST, file_path DESC NULLS LAST, relative_path DESC NULLS LAST, file_name DESC NULLS LAST, file_type DESC NULLS LAST, "
    "file_size DESC NULLS LAST, content DESC NULLS LAST) = 1)"
)


def current(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return chat.current(table(spark, d, name), *columns)


def pages_of(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return crawl.latest_pages(table(spark, d, "raw_docs"), *columns)


# SQL pieces for text: white space and control characters as the engine sees them.
def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_clean(x: str) -> str:
    no_ctl = rf"regexp_replace(coalesce({x}, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')"
    return sql_strip(rf"regexp_replace(regexp_replace({no_ctl}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_flat(x: str) -> str:
    no_ctl = rf"regexp_replace(coalesce({x}, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')"
    return sql_strip(rf"regexp_replace({no_ctl}, '[\s\p{{Z}}]+', ' ', 'g')")


def sql_tags(x: str, tags: list[str]) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '(?s)<!--.*?-->', '', 'g')"
    for t in tags:
        x = f"regexp_replace({x}, '(?is)<{t}[^>]*>.*?</{t}>', '', 'g')"
    return x


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\x{{4E00}}-\x{{9FFF}}]|(?:[^\P{{L}}\x{{4E00}}-\x{{9FFF}}]|\p{{N}})+')"


# ---------------------------------------------------------------- text and pages


@query(f"SELECT doc_id, md5({sql_clean('text')}) AS hash FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_text("text")).alias("hash"))


@query(f"SELECT doc_id, md5({sql_flat('text')}) AS hash FROM documents")
def clean_text_flat(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_text_flat("text")).alias("hash"))


@query(f"SELECT page_id, length(x) AS n_chars, md5(x) AS hash FROM (SELECT page_id, {sql_tags('content', ['script', 'style', 'noscript', *T.HTML_BLOCKS])} AS x FROM {PAGES})")
def clean_html(spark, d):
    x = pages_of(spark, d, "page_id", "content").select("page_id", T.clean_html("content").alias("x"))
    return x.select("page_id", F.length("x").cast("bigint").alias("n_chars"), F.md5("x").alias("hash"))


@query(rf"SELECT page_id, md5({sql_strip(rf'''regexp_replace({sql_tags('content', ['script', 'style'])}, '[\s\v\p{{Z}}\x{{85}}]+', ' ', 'g')''')}) AS hash FROM {PAGES}")
def clean_html_legacy(spark, d):
    return pages_of(spark, d, "page_id", "content").select("page_id", F.md5(T.clean_html_legacy("content")).alias("hash"))


@query(
    r"""SELECT DISTINCT id, regexp_replace(key, '[^\p{L}\p{N}_\-.]', '_', 'g') AS key, coalesce(json_extract_string(metadata, '$."' || key || '"'), '') AS value
    FROM (SELECT id, metadata, unnest(json_keys(metadata)) AS key FROM chunks WHERE metadata IS NOT NULL AND json_valid(metadata) AND json_type(metadata) = 'OBJECT')"""
)
def metadata_clean(spark, d):
    m = table(spark, d, "chunks").select("id", T.clean_metadata(T.json_map("metadata")).alias("m")).where("m IS NOT NULL")
    return m.select("id", F.explode("m").alias("key", "value")).distinct()


@query(rf"SELECT doc_id, coalesce(length({sql_strip('text')}) >= 10 AND regexp_matches(text, '[a-zA-Z0-9\x{{4E00}}-\x{{9FFF}}]'), false) AS is_valid FROM documents")
def valid_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.valid_text("text").alias("is_valid"))


@query(f"SELECT doc_id, md5(c) AS hash FROM (SELECT doc_id, {sql_clean('text')} AS c FROM documents) WHERE length(c) >= 10 AND regexp_matches(c, '[a-zA-Z0-9\\x{{4E00}}-\\x{{9FFF}}]')")
def clean_and_validate(spark, d):
    c = table(spark, d, "documents").select("doc_id", T.clean_text("text").alias("c"))
    return c.where(T.valid_text("c")).select("doc_id", F.md5("c").alias("hash"))


ROOT = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+)', 1)"


@query(
    f"""SELECT DISTINCT page_id, CASE WHEN starts_with(href, '/') THEN root || href ELSE href END AS link FROM
    (SELECT page_id, {ROOT} AS root, unnest(regexp_extract_all(content, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM {PAGES} WHERE url IS NOT NULL)
    WHERE root <> '' AND (starts_with(href, '/') OR starts_with(href, root))"""
)
def page_links(spark, d):
    return crawl.page_links(pages_of(spark, d, "page_id", "url", "content"), "page_id", "url", "content")


def _any(fn: str, col: str, items: list[str]) -> str:
    return "(" + " OR ".join(f"{fn}({col}, '{i}')" for i in items) + ")"


@query(f"SELECT page_id, url, starts_with(url, {ROOT}) AND NOT {_any('contains', 'url', T.URL_EXCLUDED)} AND {_any('contains', 'url', T.URL_SECTIONS)} AS kept FROM {PAGES} WHERE url IS NOT NULL")
def doc_url_filter(spark, d):
    return crawl.doc_urls(pages_of(spark, d, "page_id", "url"), "page_id", "url")


@query(
    f"""SELECT page_id, CASE WHEN ends_with(f, '.html') THEN f ELSE f || '.html' END AS filename FROM (SELECT page_id, CASE WHEN p = '' THEN 'index' ELSE p END AS f FROM
    (SELECT page_id, translate(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/-', '__') AS p FROM {PAGES} WHERE url IS NOT NULL))"""
)
def url_filename(spark, d):
    return crawl.file_names(pages_of(spark, d, "page_id", "url"), "page_id", "url")


@query(f"SELECT DISTINCT url FROM {PAGES} WHERE url IS NOT NULL AND contains(url, '/docs/tasks/') ORDER BY url LIMIT 100")
def crawl_frontier(spark, d):
    p = pages_of(spark, d, "page_id", "url").where("url IS NOT NULL")
    return crawl.frontier(p.where(F.contains("url", F.lit("/docs/tasks/"))), p.where(F.lit(False)), "url", 100)


@query()
def crawl_page_text(spark, d):
    return crawl.page_texts(pages_of(spark, d, "page_id", "content"), "page_id", "content")


@query(
    """WITH p AS (SELECT string_split(regexp_replace(relative_path, '^/+', ''), '/') AS parts FROM raw_docs WHERE relative_path <> ''),
    q AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p WHERE len(list_filter(parts, lambda x: starts_with(x, '.') OR starts_with(x, '_'))) = 0)
    SELECT DISTINCT array_to_string(parts[1:depth], '/') AS path, CASE WHEN depth > 1 THEN array_to_string(parts[1:depth-1], '/') END AS parent, parts[depth] AS label,
    depth::INT AS depth, depth = len(parts) AS is_file FROM q WHERE depth < len(parts) OR ends_with(parts[depth], '.html')"""
)
def doc_tree(spark, d):
    return files.tree(table(spark, d, "raw_docs"), "relative_path")


@query(
    """WITH p AS (SELECT string_split(regexp_replace(relative_path, '^/+', ''), '/') AS parts FROM raw_docs WHERE relative_path <> ''),
    q AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p WHERE len(list_filter(parts, lambda x: starts_with(x, '.') OR starts_with(x, '_'))) = 0),
    n AS (SELECT DISTINCT array_to_string(parts[1:depth], '/') AS path, depth FROM q WHERE depth < len(parts) OR ends_with(parts[depth], '.html'))
    SELECT path, depth::INT AS depth FROM n WHERE EXISTS (SELECT 1 FROM n h WHERE contains(lower(h.path), 'probe') AND (h.path = n.path OR starts_with(h.path, n.path || '/')))"""
)
def doc_tree_search(spark, d):
    return files.search_tree(files.tree(table(spark, d, "raw_docs"), "relative_path"), "probe").select("path", "depth")


@query(
    f"""WITH l AS (SELECT doc_id, title, list_transform(string_split(coalesce(text, ''), chr(10))[1:10], lambda x: {sql_strip('x')}) AS ls FROM documents),
    h AS (SELECT doc_id, title, list_filter(ls, lambda x: starts_with(x, '# ') OR starts_with(lower(x), 'title:'))[1] AS h FROM l)
    SELECT doc_id, coalesce(CASE WHEN starts_with(h, '# ') THEN {sql_strip('substr(h, 3)')} ELSE {sql_strip('substr(h, 7)')} END, title) AS title FROM h"""
)
def doc_title(spark, d):
    return table(spark, d, "documents").select("doc_id", T.title_of("text", "title").alias("title"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def doc_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


# The contents of the chunks under different names, and none at all for chunks without an index, so every leg is taken.
@query(
    """WITH c AS (SELECT id, CASE WHEN chunk_index % 3 = 0 THEN content END AS text, CASE WHEN chunk_index % 3 = 1 THEN content END AS content, CASE WHEN chunk_index % 3 = 2 THEN content END AS data, metadata FROM chunks)
    SELECT DISTINCT id, md5(coalesce(nullif(text, ''), nullif(content, ''), nullif(data, ''), CASE WHEN json_valid(metadata) THEN nullif(json_extract_string(metadata, '$.text'), '') END,
    CASE WHEN json_valid(metadata) THEN nullif(json_extract_string(metadata, '$.content'), '') END)) AS hash FROM c"""
)
def entity_content(spark, d):
    text, content, data = (F.when(F.col("chunk_index") % 3 == i, F.col("content")) for i in range(3))
    return table(spark, d, "chunks").select("id", F.md5(T.entity_text(text, content, data, F.col("metadata"))).alias("hash")).distinct()


ENTITY_KEYS = {
    "file_path": "file_path", "file_name": "string_split(file_path, '/')[-1]", "doc_id": "doc_id", "document_title": "CASE WHEN chunk_index = 0 THEN file_path END", "relative_path": "file_path",
    "chunk_index": "chunk_index::VARCHAR", "creation_date": "CASE WHEN chunk_index > 0 THEN '2025-01-01' END",
}


@query(
    f"""WITH c AS (SELECT DISTINCT id, doc_id, file_path, chunk_index, metadata FROM chunks), m AS (SELECT id, key, json_extract_string(metadata, '$."' || key || '"') AS value FROM
    (SELECT id, metadata, unnest(json_keys(metadata)) AS key FROM c WHERE json_valid(metadata) AND json_type(metadata) = 'OBJECT')),
    e AS ({" UNION ALL ".join(f"SELECT id, '{k}' AS key, {x} AS value FROM c" for k, x in ENTITY_KEYS.items())})
    SELECT id, key, value FROM m UNION ALL SELECT id, key, value FROM e WHERE value IS NOT NULL AND (id, key) NOT IN (SELECT (id, key) FROM m)"""
)
def entity_metadata(spark, d):
    c = table(spark, d, "chunks").select("id", "doc_id", "file_path", "chunk_index", "metadata").distinct()
    extra = {"file_path": F.col("file_path"), "file_name": F.substring_index("file_path", "/", -1), "doc_id": F.col("doc_id"), "document_title": F.when(F.col("chunk_index") == 0, F.col("file_path"))}
    extra |= {"relative_path": F.col("file_path"), "chunk_index": F.col("chunk_index"), "creation_date": F.when(F.col("chunk_index") > 0, F.lit("2025-01-01"))}
    return c.select("id", F.explode(T.merge_metadata(T.json_map("metadata"), extra)).alias("key", "value"))


def _lang_sql(order: list[str]) -> str:
    fam = code.LANGUAGES | code.MORE_LANGUAGES
    whens = " ".join(f"WHEN regexp_matches(text, '(?im)(?:{'|'.join(fam[n])})') THEN '{n}'" for n in order)
    return f"SELECT doc_id, CASE {whens} ELSE 'text' END AS language FROM documents"


@query(_lang_sql(list(code.LANGUAGES)))
def detect_language(spark, d):
    return table(spark, d, "documents").select("doc_id", code.detect_language("text").alias("language"))


@query(_lang_sql(code.LONG_ORDER))
def detect_language_long(spark, d):
    return table(spark, d, "documents").select("doc_id", code.detect_language("text", long_list=True).alias("language"))


_FAMILIES = code.LANGUAGES | code.MORE_LANGUAGES


def _codes_sql(order: list[str]) -> str:
    """CTE c (page_id, idx, cls, code, language): all code elements of the pages, by patterns."""
    whens = " ".join(f"WHEN regexp_matches(code, '(?im)(?:{'|'.join(_FAMILIES[n])})') THEN '{n}'" for n in order)
    body = "replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&gt;', '>'), '&lt;', '<'), '&quot;', '\"'), '&amp;', '&')"
    return rf"""WITH r AS (SELECT page_id, regexp_replace(content, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS t FROM {PAGES}),
    e AS (SELECT page_id, unnest(range(1, len(b) + 1)) AS i, a, b FROM (SELECT page_id, regexp_extract_all(t, '(?is)<code([^>]*)>(.*?)</code>', 1) AS a, regexp_extract_all(t, '(?is)<code([^>]*)>(.*?)</code>', 2) AS b FROM r)),
    g AS (SELECT page_id, (i - 1)::INT AS idx, nullif(regexp_extract(a[i], '(?:language|lang)-([^\s"]*)', 1), '') AS cls, b[i] AS body FROM e),
    k AS (SELECT page_id, idx, cls, regexp_replace({body}, '^[\s\v\p{{Z}}\x{{85}}]+|[\s\v\p{{Z}}\x{{85}}]+$', '', 'g') AS code FROM g),
    c AS (SELECT page_id, 'code_block_' || substr(sha256(page_id || '|' || idx), 1, 8) AS code_id, idx, length(code)::INT AS length, coalesce(cls, CASE {whens} ELSE 'text' END) AS language, code FROM k)"""


@query(f"{_codes_sql(list(code.LANGUAGES))} SELECT * FROM c WHERE length > 100")
def code_blocks(spark, d):
    # The pages' code is short: at the default of 500 characters none would be taken out.
    return code.code_blocks(pages_of(spark, d, "page_id", "content"), "page_id", "content", 100)


@query(f"{_codes_sql(list(code.LANGUAGES))} SELECT page_id, code_id, true AS restored FROM c WHERE length > 100")
def code_restore(spark, d):
    """Every block behind a placeholder, and whether the restored page holds it in its fence."""
    p = pages_of(spark, d, "page_id", "content")
    blocks = stage(code.code_blocks(p, "page_id", "content", 100), "blocks")
    full = code.restore(code.html_pages(p, "page_id", "content", min_code=100), "page_id", "content", blocks)
    held = F.contains("content", F.concat(F.lit("\n```"), "code", F.lit("\n```\n")))
    return blocks.join(full, "page_id").select("page_id", "code_id", (held & ~F.contains("content", F.concat(F.lit("[CODE_BLOCK:"), "code_id"))).alias("restored"))


@query(f"{_codes_sql(list(code.LANGUAGES))} SELECT page_id, code_id FROM c WHERE length > 100")
def code_association(spark, d):
    """The blocks that the chunks of the pages' text refer to: none is lost by chunking."""
    p = pages_of(spark, d, "page_id", "content")
    chunks = chunking.with_ids(chunking.paragraph_chunks(code.html_pages(p, "page_id", "content", min_code=100), "page_id", "content"), "page_id")
    a = code.associate(chunks, "doc_id", "content", code.code_blocks(p, "page_id", "content", 100))
    return a.select(F.substring_index("doc_id", "#", 1).cast("bigint").alias("page_id"), F.explode("code_ids").alias("code_id")).distinct()


@query(
    rf"""WITH c AS (SELECT id, md5(t) AS hash, CASE WHEN metadata IS NOT NULL AND json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN len(json_keys(metadata)) END AS n_keys
    FROM (SELECT DISTINCT id, metadata, {sql_flat('content')} AS t FROM chunks) WHERE length(t) >= 10 AND regexp_matches(t, '[a-zA-Z0-9\x{{4E00}}-\x{{9FFF}}]')) SELECT id, hash, n_keys::INT AS n_keys, 0 AS n_codes FROM c"""
)
def clean_nodes(spark, d):
    c = table(spark, d, "chunks").select("id", "content", "metadata").distinct().withColumn("metadata", T.json_map("metadata"))
    none = spark.createDataFrame([], "code_id string")
    n = F.when(F.col("metadata").isNotNull(), F.size("metadata"))
    return code.clean_nodes(c, "id", "content", "metadata", none).select("id", F.md5("content").alias("hash"), n.alias("n_keys"), F.size("code_ids").alias("n_codes"))


def sql_pieces(x: str) -> str:
    """The texts between the tags of a page, stripped, empty ones left out."""
    text = f"regexp_replace({x}, '(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|noscript|template)\\b[^>]*>.*?</(?:script|style|noscript|template)>', '<x>', 'g')"
    plain = "p"
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("copy", "©"), ("#39", "''"), ("amp", "&")):
        plain = f"replace({plain}, '&{name};', '{sign}')"
    strip = rf"regexp_replace({plain}, '^[\s\v\p{{Z}}\x{{85}}]+|[\s\v\p{{Z}}\x{{85}}]+$', '', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({text}, '</?[a-zA-Z][^<>]*>'), lambda p: {strip}), lambda p: p <> '')"


def sql_page_letters(x: str) -> str:
    """Letters and digits of a page's visible text outside the site's blocks."""
    body = f"coalesce({x}, '')"
    for tag in T.HTML_BLOCKS:
        body = f"regexp_replace({body}, '(?is)<{tag}(?:[ \\t\\r\\n/][^>]*)?>.*?</{tag}>', '<x>', 'g')"
    return f"regexp_replace(array_to_string({sql_pieces(body)}, ' '), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


LETTERS = r"[^\p{L}\p{N}]+"


@query(f"SELECT page_id, md5({sql_page_letters('content')}) AS hash, 0 AS n_codes FROM {PAGES}")
def html_pages(spark, d):
    """Markdown of whole pages, compared by its letters; marks and white space are its own."""
    m = code.html_pages(pages_of(spark, d, "page_id", "content"), "page_id", "content")
    return m.select("page_id", F.md5(F.regexp_replace("content", LETTERS, "")).alias("hash"), "n_codes")


@query(f"SELECT page_id, array_to_string({sql_pieces("coalesce(content, '')")}, chr(10)) AS content, 0 AS n_codes FROM {PAGES}")
def html_plain(spark, d):
    return code.html_pages(pages_of(spark, d, "page_id", "content"), "page_id", "content", legacy=True)


@query("SELECT page_id, file_size, lower(file_type) AS file_type FROM raw_docs WHERE (ends_with(lower(relative_path), '.html') OR ends_with(lower(relative_path), '.md') OR ends_with(lower(relative_path), '.txt')) AND NOT contains(relative_path, 'lag') AND NOT regexp_matches(relative_path, '(^|/)\\.')")
def path_filter(spark, d):
    return files.kept_paths(table(spark, d, "raw_docs"), exclude=["lag"], any_case=True).select("page_id", "file_size", F.lower("file_type").alias("file_type"))


# ---------------------------------------------------------------- chunks


@query(
    rf"""WITH w AS (SELECT doc_id, i, {sql_strip('substr(text, i + 1, 1024)')} AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 924)) AS i FROM documents WHERE regexp_matches(text, '[^\s\p{{Z}}\x0B\x{{85}}]')))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, md5(c) AS hash FROM w WHERE length(c) >= 10""".replace("[\\s\\p{Z}]", "[\\s\\v\\p{Z}\\x{85}]")
)
def chunk_window(spark, d):
    c = chunking.window_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", F.md5("content").alias("hash"))


def _chunks(c: DataFrame) -> DataFrame:
    return c.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("hash"))


@query()
def chunk_paragraph(spark, d):
    return _chunks(chunking.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text"))


@query()
def chunk_paragraph_compat(spark, d):
    return _chunks(chunking.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text", compat=True))


@query()
def chunk_adaptive(spark, d):
    return _chunks(chunking.adaptive_chunks(table(spark, d, "documents"), "doc_id", "text"))


@query()
def chunk_recursive(spark, d):
    return _chunks(chunking.recursive_chunks(table(spark, d, "documents"), "doc_id", "text"))


@query()
def chunk_sentence(spark, d):
    return _chunks(chunking.sentence_chunks(table(spark, d, "documents"), "doc_id", "text"))


# With no overlap the pieces hold all characters in order, but for white space, control characters and the separators cut at.
def sql_letters(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[\s\v\p{{Z}}\x{{85}}\x00-\x1F。！？.!?]+', '', 'g')"


@query(f"SELECT doc_id, md5({sql_letters('text')}) AS hash, unnest(['paragraph', 'paragraph_compat', 'adaptive', 'recursive', 'sentence']) AS method FROM documents WHERE {sql_letters('text')} <> ''")
def chunk_cover(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cuts = {
        "paragraph": chunking.paragraph_chunks(docs, "doc_id", "text", overlap=0, min_length=1),
        "paragraph_compat": chunking.paragraph_chunks(docs.where("length(text) < 8 * 1024"), "doc_id", "text", overlap=0, min_length=1, compat=True).unionByName(
            chunking.paragraph_chunks(docs.where("length(text) >= 8 * 1024"), "doc_id", "text", overlap=0, min_length=1)
        ),
        "adaptive": chunking.adaptive_chunks(docs, "doc_id", "text", overlap=0, min_length=1),
        "recursive": chunking.recursive_chunks(docs, "doc_id", "text", overlap=0),
        "sentence": chunking.sentence_chunks(docs, "doc_id", "text", overlap=0),
    }
    out = None
    for method, c in cuts.items():
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")
        letters = F.regexp_replace("t", r"(?U)[\s\p{Z}\x00-\x1F\x85。！？.!?]+", "")
        one = c.groupBy("doc_id").agg(text.alias("t")).select("doc_id", F.md5(letters).alias("hash"), F.lit(method).alias("method"), letters.alias("l")).where("l <> ''").drop("l")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH f AS (SELECT doc_id, {sql_flat('text')} AS t FROM documents), p AS (SELECT doc_id, CASE WHEN length(t) >= 1024 THEN [substr(t, 1, 1024), {sql_strip('right(t, 100)')}] ELSE [t] END AS ps FROM f WHERE t <> '')
    SELECT doc_id, (i - 1)::INT AS chunk_index, md5(ps[i]) AS hash FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)"""
)
def chunk_legacy(spark, d):
    flat = table(spark, d, "documents").select("doc_id", T.clean_text_flat("text").alias("text"))
    return chunking.legacy_chunks(flat, "doc_id", "text").select("doc_id", "chunk_index", F.md5("content").alias("hash"))


@query("SELECT count(*) AS n_docs, coalesce(sum(length(text)), 0)::BIGINT AS total_chars, round(avg(coalesce(length(text), 0)), 2) AS avg_chars, coalesce(max(length(text)), 0)::INT AS max_chars FROM documents")
def chunk_stats(spark, d):
    return chunking.size_stats(table(spark, d, "documents"), "text")


@query("SELECT doc_id, length(text)::INT AS n_chars FROM documents WHERE text IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 10")
def chunk_largest(spark, d):
    return chunking.largest(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT file_path, count(*) AS n_chunks FROM chunks GROUP BY file_path ORDER BY n_chunks DESC, file_path LIMIT 20")
def chunk_most(spark, d):
    return chunking.most_chunked(table(spark, d, "chunks"), "file_path")


# ---------------------------------------------------------------- vectors

COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
TOPK = f"""SELECT query_id, vec_id, rank, cosine FROM (SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS cosine,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10"""


def _topk(spark, d, k=10):
    e = table(spark, d, "embeddings")
    return vectors.topk(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), "vec_id", "embedding", k)


@query(TOPK)
def cosine_topk(spark, d):
    return _topk(spark, d).withColumnRenamed("id", "vec_id")


@query(f"SELECT *, round(CASE WHEN cosine > 0 THEN 1 / (1 + cosine) ELSE 1 END, 6) AS score FROM ({TOPK})")
def vector_score_map(spark, d):
    return vectors.with_scores(_topk(spark, d)).withColumnRenamed("id", "vec_id")


@query(TOPK)
def ivf_topk(spark, d):
    e = table(spark, d, "embeddings")
    c = vectors.ivf_train(e, "vec_id", "embedding")
    index = stage(vectors.ivf_assign(e, "vec_id", "embedding", c), "ivf")
    return vectors.ivf_search(index, c, e.where("vec_id % 100 = 0"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS l1 FROM embeddings")
def l2_norm(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query(f"SELECT a.vec_id, round({COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine("embedding", "e2"), 6).alias("cosine"))


EMBED_TOKENS = r"regexp_extract_all(lower(coalesce(content, '')), '[\x{4E00}-\x{9FFF}]|[\p{L}\p{N}_]+')"


@query(
    f"""WITH c AS (SELECT DISTINCT id, content FROM chunks), h AS (SELECT id, ('0x' || substr(md5(unnest({EMBED_TOKENS})), 1, 8))::BIGINT AS h FROM c),
    v AS (SELECT id, h % 64 AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM h GROUP BY id, k)
    SELECT id, coalesce(string_agg(k || CASE WHEN v > 0 THEN '+' ELSE '-' END, ' ' ORDER BY k) FILTER (v <> 0), '') AS signs, count(*) FILTER (v <> 0) > 0 AS unit, NULL AS error FROM c LEFT JOIN v USING (id) GROUP BY id"""
)
def embed_texts(spark, d):
    """The signs of every chunk's vector by dimension, and whether it has length 1 (0 for texts without tokens)."""
    c = table(spark, d, "chunks").select("id", "content").distinct()
    e = vectors.embed(c, "id", "content")
    signs = F.array_join(F.filter(F.transform("embedding", lambda x, i: F.when(x != 0, F.concat(i.cast("string"), F.when(x > 0, "+").otherwise("-")))), lambda x: x.isNotNull()), " ")
    return e.select("id", signs.alias("signs"), (F.abs(V.norm("embedding") - 1) < 1e-5).alias("unit"), "error")


HOT = "docs/reference/generated/field-catalogue.html"


@query(
    f"""SELECT id, chunk_index FROM (SELECT DISTINCT id, chunk_index FROM chunks WHERE file_path = '{HOT}' OR starts_with(doc_id, '{HOT}#')
    OR CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.relative_path') END = '{HOT}') ORDER BY coalesce(chunk_index, 0), id LIMIT 1000"""
)
def chunks_by_path(spark, d):
    return vectors.chunks_by_path(table(spark, d, "chunks"), HOT).select("id", "chunk_index")


@query("SELECT count(*) AS row_count, max(len(embedding))::INT AS dim FROM embeddings")
def collection_stats(spark, d):
    return vectors.collection_stats(table(spark, d, "embeddings"), "embedding")


@query("SELECT DISTINCT id, length(substr(content, 1, 65000))::INT AS n_chars FROM chunks WHERE doc_id IS NOT NULL AND content <> '' AND len(embedding) > 0")
def vector_store_rows(spark, d):
    return sinks.vector_rows(table(spark, d, "chunks"))[0].select("id", F.length("content").alias("n_chars")).distinct()


@query("SELECT DISTINCT id FROM chunks WHERE doc_id IS NULL OR content IS NULL OR content = '' OR embedding IS NULL OR len(embedding) = 0")
def vector_store_rejects(spark, d):
    return sinks.vector_rows(table(spark, d, "chunks"))[1].select("id").distinct()


@query(rf"SELECT DISTINCT id, coalesce(doc_id, concat_ws('#', coalesce(file_path, ''), coalesce(chunk_index, 0)::VARCHAR)) AS doc_id FROM chunks WHERE length(regexp_replace(content, '^[\s\v\p{{Z}}\x{{85}}]+|[\s\v\p{{Z}}\x{{85}}]+$', '', 'g')) >= 10 AND embedding IS NOT NULL AND len(embedding) > 0")
def store_prepared(spark, d):
    return sinks.prepared(table(spark, d, "chunks"), None, True, "file_path").select("id", "doc_id").distinct()


@query("SELECT doc_id, max(chunk_index) AS chunk_index FROM chunks WHERE doc_id IS NOT NULL GROUP BY doc_id")
def index_upsert(spark, d):
    return sinks.upsert_rows(table(spark, d, "chunks").select("doc_id", "chunk_index", "id"), "doc_id", ["chunk_index"]).select("doc_id", "chunk_index")


# ---------------------------------------------------------------- keyword search and fusion

QUERY_SQL = "SELECT doc_id AS query_id, coalesce(title, substr(text, 1, 60)) AS query FROM documents WHERE doc_id % 100 = 0 AND coalesce(title, text) IS NOT NULL"
BM25 = f"""WITH tok AS (SELECT doc_id, {sql_tokens("coalesce(text, '')")} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avglen FROM tok),
    qt AS (SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS term FROM ({QUERY_SQL})),
    tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL)"""
BM25 = BM25.replace("GROUP BY ALL)", "GROUP BY doc_id, term)", 1).replace("st GROUP BY ALL)", "st GROUP BY query_id, doc_id)")
RANKED = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, score FROM s"


def _queries(spark, d):
    q = table(spark, d, "documents").where("doc_id % 100 = 0 AND coalesce(title, text) IS NOT NULL")
    return q.select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.substring("text", 1, 60)).alias("query"))


@query(f"{BM25} SELECT * FROM ({RANKED}) WHERE rank <= 10")
def bm25_topk(spark, d):
    return keyword.bm25(table(spark, d, "documents"), "doc_id", "text", _queries(spark, d), "query_id", "query")


def sql_edits(a: str, b: str) -> str:
    """Edit distance in characters; DuckDB's own counts bytes, so it serves where both are ASCII only."""
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda y: [y]), lambda acc, j: list_append(acc, least(acc[j[1]] + 1, prev[j[1] + 1] + 1, prev[j[1]] + (substr({a}, i[1], 1) <> substr({b}, j[1], 1))::BIGINT)), [i[1]])"
    wide = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda x: [x]), lambda prev, i: {row}, range(0, length({b}) + 1))[length({b}) + 1]"
    return f"CASE WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN levenshtein({a}, {b}) ELSE {wide} END"


NEAR = f"""voc AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS match FROM documents), ask AS (SELECT term, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS edits FROM asked),
    near AS (SELECT term, match, distance FROM (SELECT term, match, edits, ({sql_edits('term', 'match')})::INT AS distance FROM ask JOIN voc ON substr(term, 1, 1) = substr(match, 1, 1) AND abs(length(term) - length(match)) <= edits)
    WHERE distance <= edits QUALIFY row_number() OVER (PARTITION BY term ORDER BY distance, match) <= 50)"""


@query(f"WITH asked AS (SELECT DISTINCT unnest({sql_tokens('query')}) AS term FROM ({QUERY_SQL})), {NEAR} SELECT * FROM near")
def fuzzy_terms(spark, d):
    vocabulary = table(spark, d, "documents").select(F.explode(T.tokens("text")).alias("term"))
    return keyword.fuzzy_terms(keyword.query_terms(_queries(spark, d), "query_id", "query"), vocabulary)


def bm25_sql(terms: str, queries: str = QUERY_SQL, boost: float = 1.0) -> str:
    """BM25 by its published form over the CTE qt (query_id, term, weight) that ``terms`` defines."""
    return f"""WITH tok AS (SELECT doc_id, {sql_tokens("coalesce(text, '')")} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avglen FROM tok), q AS ({queries}), {terms},
    tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, doc_id, {boost} * sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY query_id, doc_id)"""


FUZZY_TERMS = rf"""ex AS (SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS term FROM q), few AS (SELECT query_id FROM q WHERE len(regexp_extract_all(query, '[^\s\v\p{{Z}}\x{{85}}]+')) <= 8),
    asked AS (SELECT DISTINCT term FROM ex WHERE query_id IN (SELECT query_id FROM few)), {NEAR},
    qt AS (SELECT query_id, term, max(weight) AS weight FROM (SELECT query_id, term, 1.0::DOUBLE AS weight FROM ex UNION ALL
    SELECT query_id, match, 1 - distance / least(length(term), length(match)) FROM ex JOIN near USING (term) WHERE distance > 0 AND query_id IN (SELECT query_id FROM few)) GROUP BY query_id, term)"""


@query(f"{bm25_sql(FUZZY_TERMS, boost=2.0)} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10")
def bm25_fuzzy(spark, d):
    return keyword.bm25(table(spark, d, "documents"), "doc_id", "text", _queries(spark, d), "query_id", "query", search=keyword.Search())


# Every second query is a whole path, so both fields decide hits.
FIELD_QUERIES = "SELECT doc_id AS query_id, CASE WHEN doc_id % 200 = 0 THEN file_path ELSE coalesce(title, substr(text, 1, 60)) END AS query FROM documents WHERE doc_id % 100 = 0"


@query(
    f"""{bm25_sql(f"qt AS (SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS term, 1.0 AS weight FROM q WHERE query IS NOT NULL)", FIELD_QUERIES, 2.0)},
    p AS (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS df FROM q JOIN documents d ON d.file_path = {sql_strip('q.query')} WHERE q.query <> ''),
    b AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM (SELECT query_id, doc_id, score FROM s UNION ALL SELECT query_id, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) FROM p, st) GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, score FROM b QUALIFY rank <= 10"""
)
def bm25_fields(spark, d):
    docs = table(spark, d, "documents")
    name = F.when(F.col("doc_id") % 200 == 0, F.col("file_path")).otherwise(F.coalesce("title", F.substring("text", 1, 60)))
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), name.alias("query"))
    return keyword.bm25(docs, "doc_id", "text", q, "query_id", "query", search=keyword.Search(fuzziness=False), path="file_path")


@query(f"{BM25} SELECT query_id, doc_id, true AS some, true AS inside, true AS marked FROM ({RANKED}) WHERE rank <= 10")
def highlights(spark, d):
    """Of every hit, whether it has one to three fragments, all without their marks lie in the text, and all are marked and no longer than
    150 characters or one token."""
    hits = bm25_topk(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(_queries(spark, d), "query_id")
    plain = lambda x: F.replace(F.replace(x, F.lit("<em>"), F.lit("")), F.lit("</em>"), F.lit(""))
    h = keyword.highlights(hits, "text", "query", 10)
    inside = F.forall("highlights", lambda x: F.contains("text", plain(x)))
    marked = F.forall("highlights", lambda x: F.contains(x, F.lit("<em>")) & ((F.length(plain(x)) <= 150) | (F.size(T.tokens(plain(x))) == 1)))
    return h.select("query_id", "doc_id", F.size("highlights").between(1, 3).alias("some"), inside.alias("inside"), marked.alias("marked"))


# A synthetic pairing, as documents have no vectors: the query's vector is that of the same number, and so are the hits.
VEC = f"""v AS (SELECT query_id, vec_id AS doc_id, rank, score FROM (SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id)::INT AS rank FROM embeddings a JOIN ({QUERY_SQL}) q ON q.query_id = a.vec_id, embeddings b) WHERE rank <= 50)"""
KW = f"k AS (SELECT * FROM ({RANKED}) WHERE rank <= 50)"
RRF = f"""{BM25}, {VEC}, {KW}, u AS (SELECT query_id, doc_id::VARCHAR AS key, rank, score, 'vector' AS source FROM v UNION ALL SELECT query_id, doc_id::VARCHAR, rank, score, 'keyword' FROM k),
    f AS (SELECT query_id, key, round(sum(1.0 / (60 + rank)), 8) AS rrf, min(rank) FILTER (source = 'vector') AS vector_rank, min(score) FILTER (source = 'vector') AS vector_score,
    max(rank) FILTER (source = 'keyword') AS keyword_rank, max(score) FILTER (source = 'keyword') AS keyword_score, count(*) AS n_sources, string_agg(source, ',' ORDER BY source DESC) AS sources FROM u GROUP BY query_id, key),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, key)::INT AS position FROM f)"""


def _sides(spark, d, k=50):
    q = _queries(spark, d)
    e = table(spark, d, "embeddings")
    q = q.join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id")
    docs = table(spark, d, "documents")
    return retrieval.vector_side(e, q, k, "vec_id", "embedding"), retrieval.keyword_side(docs, _queries(spark, d), k, "doc_id", "text")


@query(f"{RRF} SELECT * FROM r WHERE position <= 10")
def rrf_hybrid(spark, d):
    return fusion.rrf(*_sides(spark, d)).where("position <= 10")


@query(f"{RRF} SELECT query_id, count_if(n_sources = 2)::BIGINT AS n FROM r GROUP BY query_id")
def both_sources(spark, d):
    return fusion.both_sources(fusion.rrf(*_sides(spark, d)))


@query(f"{BM25}, {VEC}, {KW} SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id)::VARCHAR AS key, round(0.6 * coalesce(v.score, 0) + 0.4 * coalesce(k.score, 0), 6) AS combined_score FROM v FULL JOIN k ON v.query_id = k.query_id AND v.doc_id = k.doc_id")
def weighted_fusion(spark, d):
    return fusion.weighted(*_sides(spark, d))


def _reranked(spark, d):
    fused = fusion.rrf(*_sides(spark, d)).where(F.col("position") <= fusion.candidate_cap(10))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"), "file_path")
    cand = fused.select("query_id", "key", "rrf", "position").join(docs, "key").join(_queries(spark, d), "query_id")
    return fusion.rerank(cand, "query", "content", "position", 10)


RERANK = f"""{RRF}, c AS (SELECT r.query_id, key, rrf, position, text AS content, file_path, query FROM r JOIN documents ON key = doc_id::VARCHAR JOIN ({QUERY_SQL}) q ON q.query_id = r.query_id
    WHERE position <= 30 AND length({sql_strip('text')}) > 0),
    o AS (SELECT *, round(coalesce(len(list_intersect(list_distinct({sql_tokens('query')}), list_distinct({sql_tokens('content')}))) / nullif(len(list_distinct({sql_tokens('query')})), 0), 0), 6) AS rerank_score FROM c),
    x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position)::INT AS rank FROM o)"""


@query(f"{RERANK} SELECT query_id, key, rank, rerank_score FROM x WHERE rank <= 10")
def rerank_coverage(spark, d):
    return _reranked(spark, d).select("query_id", "key", "rank", "rerank_score")


@query(
    f"""{RERANK}, y AS (SELECT query_id, rank, length('文档 ' || rank || ': ' || coalesce(file_path, '文档 ' || rank) || chr(10) || '相关度: ' || format('{{:.3f}}', rerank_score) || chr(10)) + length('内容: ') + CASE WHEN length(content) > 2000 THEN 2011 ELSE length(content) END + 51 AS n FROM x WHERE rank <= 10),
    z AS (SELECT query_id, rank, n, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM y)
    SELECT query_id, rank, (CASE WHEN b + n > 20000 THEN 20000 - b ELSE n END)::BIGINT AS n_chars_used, b + n > 20000 AS cut FROM z WHERE b < 20000"""
)
def context_budget(spark, d):
    r = _reranked(spark, d).withColumn("score", F.col("rerank_score"))
    return context.context_parts(r).select("query_id", "rank", "n_chars_used", "cut")


@query(
    f"""{RERANK}, y AS (SELECT query_id, rank, '文档 ' || rank || ': ' || coalesce(file_path, '文档 ' || rank) || chr(10) || '相关度: ' || format('{{:.3f}}', rerank_score) || chr(10) || '内容: '
    || CASE WHEN length(content) > 2000 THEN substr(content, 1, 2000) || chr(10) || '...[内容已截断]' ELSE content END || chr(10) || repeat('-', 50) AS part FROM x WHERE rank <= 10),
    z AS (SELECT query_id, rank, part, coalesce(sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM y),
    c2 AS (SELECT query_id, string_agg(CASE WHEN b + length(part) > 20000 THEN substr(part, 1, 20000 - b) || chr(10) || '...[上下文已截断]' ELSE part END, chr(10) || chr(10) ORDER BY rank) AS c FROM z WHERE b < 20000 GROUP BY query_id)
    SELECT q.query_id, md5(coalesce(c, '没有找到相关的文档内容。')) AS hash FROM ({QUERY_SQL}) q JOIN embeddings e ON e.vec_id = q.query_id LEFT JOIN c2 ON c2.query_id = q.query_id"""
)
def rag_context(spark, d):
    e = table(spark, d, "embeddings")
    q = _queries(spark, d).join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id")
    r = retrieval.retrieve(table(spark, d, "documents"), "doc_id", "text", e, "vec_id", "embedding", q, 10, "file_path")
    return retrieval.contexts(r, q).select("query_id", F.md5("context").alias("hash"))


@query(
    f"""WITH tok AS (SELECT doc_id, unnest({sql_tokens("coalesce(text, '')")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT doc_id, term, round(tf * ln(n / df), 6) AS score FROM tf JOIN df USING (term), (SELECT count(*) AS n FROM documents))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)::INT AS rank, term, score FROM s QUALIFY rank <= 3"""
)
def doc_keywords(spark, d):
    return keyword.keywords(table(spark, d, "documents"), "doc_id", "text")


@query(
    f"""SELECT query_id, rank, vec_id AS id, coalesce(title, 'Unknown document') AS title, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview
    FROM ({TOPK}) JOIN documents ON doc_id = vec_id"""
)
def document_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("Unknown document")).alias("title"), T.preview("text").alias("preview"))
    return _topk(spark, d).join(docs, "id").select("query_id", "rank", "id", "title", "preview")


@query(f"{RERANK} SELECT query_id, count(*) AS n, sum(length(content))::BIGINT AS n_chars FROM x WHERE rank <= 10 GROUP BY query_id")
def context_unbounded(spark, d):
    r = _reranked(spark, d).withColumn("score", F.col("rerank_score"))
    parts = context.context_parts(r, max_docs=1 << 30, max_doc=0, max_total=0)
    body = F.length(F.regexp_extract("part", "(?s)^.*?\n内容: (.*)\n-{50}$", 1))
    return parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(body.cast("bigint")).alias("n_chars"))


@query(
    f"""WITH m AS (SELECT chat_id, id, created_at, content, CASE WHEN lower({sql_strip('role')}) IN ('user', 'human', 'customer') THEN 'user' WHEN lower({sql_strip('role')}) IN ('assistant', 'ai', 'bot') THEN 'assistant' END AS role FROM {MESSAGES} WHERE chat_id IS NOT NULL AND content IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC NULLS LAST, id) AS r FROM m WHERE role IS NOT NULL),
    a AS (SELECT chat_id, min(r) AS r, arg_min(content, r) AS q FROM o WHERE role = 'user' GROUP BY chat_id),
    h AS (SELECT o.chat_id, o.role, o.content, o.r - a.r AS back FROM o JOIN a USING (chat_id) WHERE o.r > a.r AND o.r <= a.r + 10),
    n AS (SELECT chat_id, count(*) AS n FROM h GROUP BY chat_id)
    SELECT chat_id, 0 AS seq, 'system' AS role, md5('Answer from the context.') AS hash FROM a
    UNION ALL SELECT chat_id, (n - back + 1)::INT, role, md5(content) FROM h JOIN n USING (chat_id)
    UNION ALL SELECT chat_id, (coalesce(n, 0) + 1)::INT, 'user', md5('Context:' || chr(10) || 'c' || chr(10) || chr(10) || 'Question: ' || q) FROM a LEFT JOIN n USING (chat_id)"""
)
def prompt_messages(spark, d):
    h = context.histories(current(spark, d, "messages", "id", "chat_id", "content", "role", "created_at"))
    m = context.prompt("Answer from the context.", F.col("history"), F.lit("c"), F.col("question"))
    return h.select("chat_id", F.posexplode(m).alias("seq", "m")).select("chat_id", "seq", "m.role", F.md5("m.content").alias("hash"))


@query(
    f"""{RERANK}, w AS (SELECT doc_id::VARCHAR AS key, 'https://docs.test/' || file_path AS url FROM documents)
    SELECT query_id, rank - 1 AS pos, file_path AS title, key AS id, md5(content) AS content, url, rerank_score AS score FROM x JOIN w USING (key) WHERE rank <= 10"""
)
def source_lists(spark, d):
    r = _reranked(spark, d).withColumn("score", F.col("rerank_score")).withColumn("url", F.concat(F.lit("https://docs.test/"), "file_path"))
    item = "array<struct<title:string,id:string,content:string,url:string,score:double>>"
    s = context.source_list(r).select("query_id", F.posexplode(F.from_json("sources", item)).alias("pos", "s"))
    return s.select("query_id", "pos", "s.title", "s.id", F.md5("s.content").alias("content"), "s.url", "s.score")


STREAMED = "SELECT doc_id AS query_id, coalesce(text, '') AS answer, CASE WHEN doc_id % 7 = 0 THEN 'failed ' || doc_id END AS error FROM documents"


def _answers(spark, d):
    error = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("failed "), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"), error.alias("error"))


@query(
    f"""SELECT query_id, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS last_event, (CASE WHEN error IS NULL THEN ceil(length(answer) / 200.0) ELSE 0 END)::BIGINT AS deltas,
    md5(CASE WHEN error IS NULL THEN answer ELSE '' END) AS hash FROM ({STREAMED})"""
)
def stream_events(spark, d):
    """The event rows of every document as an answer, put together again: last event, number of deltas and their text."""
    e = context.stream_events(_answers(spark, d), 200)
    piece = F.when(F.col("event") == "delta", F.get_json_object("data", "$.content"))
    g = e.groupBy("query_id").agg(F.max_by("event", "seq").alias("last_event"), F.count(piece).alias("deltas"), F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("seq", piece.alias("c"))))).alias("p"))
    return g.select("query_id", "last_event", "deltas", F.md5(F.array_join(F.transform("p", lambda x: x["c"]), "")).alias("hash"))


@query(f"SELECT query_id, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, error AS message, 1 AS n_events FROM ({STREAMED})")
def sse_consumed(spark, d):
    """Streams as text, read up to 'done' or 'error'; whatever follows is not taken."""
    end = F.when(F.col("error").isNotNull(), F.concat(F.lit('event: error\ndata: {"message": "'), "error", F.lit('"}'))).otherwise(F.lit("event: done\ndata: {}"))
    body = F.concat(F.lit("event: meta\r\ndata: {}\r\n\r\n"), end, F.lit("\n\ndata: late\n\nevent: done\ndata: {}\n\n"))
    x = _answers(spark, d).select("query_id", T.sse_consumed(body).alias("x"))
    return x.select("query_id", "x.status", "x.message", F.size("x.events").alias("n_events"))


# The stand-in rewriter here keeps the words of more than three letters, so the rewritten search differs from the plain one.
LONG_WORDS = f"list_distinct(list_filter({sql_tokens('query')}, lambda x: length(x) > 3))"


@query(
    f"""{bm25_sql(f"qt AS (SELECT DISTINCT query_id, unnest(CASE WHEN len({LONG_WORDS}) > 0 THEN {LONG_WORDS} ELSE {sql_tokens('query')} END) AS term, 1.0 AS weight FROM q)")}
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10"""
)
def rewritten_keywords(spark, d):
    def rewriter(q):
        words = F.filter(F.array_distinct(T.tokens(q)), lambda x: F.length(x) > 3)
        return F.to_json(F.struct(F.lower(q).alias("semantic_search_query"), words.alias("keyword_list")))

    q = retrieval.rewritten(_queries(spark, d), rewriter)
    return retrieval.keyword_side(table(spark, d, "documents"), q, 10, "doc_id", "text").select("query_id", "doc_id", "rank", "score")


@query(f"""{RERANK.replace("position <= 30", "position <= 20 AND position <= 30")} SELECT query_id, key, rank, rerank_score FROM x WHERE rank <= 10""")
def rerank_legacy(spark, d):
    """The older rerank: only the first 2k candidates, those of empty content among them, are scored."""
    fused = fusion.rrf(*_sides(spark, d)).where(F.col("position") <= fusion.candidate_cap(10))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"))
    cand = fused.where("position <= 20").select("query_id", "key", "position").join(docs, "key").join(_queries(spark, d), "query_id")
    return fusion.rerank(cand, "query", "content", "position", 10).select("query_id", "key", "rank", "rerank_score")


@query(
    f"""{RERANK} SELECT q.query_id, (SELECT count(*) FROM v WHERE v.query_id = q.query_id) AS total_vector, (SELECT count(*) FROM k WHERE k.query_id = q.query_id) AS total_keyword,
    (SELECT count(*) FROM r WHERE r.query_id = q.query_id) AS total_rrf, (SELECT count(*) FROM x WHERE x.query_id = q.query_id AND rank <= 10) AS final_results FROM ({QUERY_SQL}) q"""
)
def retrieval_counts(spark, d):
    v, k = (stage(x, "side") for x in _sides(spark, d))
    return retrieval.counts(_queries(spark, d), v, k, fusion.rrf(v, k), _reranked(spark, d))


@query(
    f"""SELECT query_id, rank, vec_id::VARCHAR AS id, coalesce(file_path, 'unknown') AS file_path, coalesce('doc-' || doc_id, 'unknown') AS doc_id, md5(coalesce(text, '')) AS content, cosine AS score, NULL::DOUBLE AS distance
    FROM ({TOPK}) LEFT JOIN documents ON doc_id = vec_id"""
)
def shaped_hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"), "file_path", F.col("text").alias("content"))
    h = vectors.shaped_hits(_topk(spark, d).withColumnRenamed("cosine", "score"), docs, "id")
    return h.withColumn("content", F.md5("content"))


@query(f"{_codes_sql(code.LONG_ORDER)} SELECT page_id, idx, 'pre' AS parent, 0 AS n_siblings, language, CASE WHEN length > 50 THEN substr(code, 1, 50) || '...' ELSE code END AS preview FROM c")
def code_positions(spark, d):
    return code.code_positions(pages_of(spark, d, "page_id", "content"), "page_id", "content")


# ---------------------------------------------------------------- chat store


@query(f"SELECT id, username FROM {USERS} WHERE lower(email) LIKE '%@mail.invalid' AND is_active")
def users_by_mail(spark, d):
    return current(spark, d, "users", "id", "email", "is_active", "username").where(F.lower("email").endswith("@mail.invalid") & F.col("is_active")).select("id", "username")


@query(f"SELECT id, username, anonymous_id FROM {USERS} WHERE is_anonymous AND anonymous_id IN (SELECT min(anonymous_id) FROM users)")
def anonymous_user(spark, d):
    u = current(spark, d, "users", "id", "username", "is_anonymous", "anonymous_id")
    low = u.agg(F.min("anonymous_id").alias("anonymous_id"))
    return chat.lookups(u.where("is_anonymous"), low, "anonymous_id").select("id", "username", "anonymous_id")


@query(f"SELECT id, username, created_at FROM {USERS} WHERE is_active ORDER BY created_at DESC NULLS LAST, id LIMIT 100 OFFSET 10")
def active_users(spark, d):
    return chat.page(current(spark, d, "users", "id", "username", "is_active", "created_at").where("is_active"), chat.newest("created_at", "id"), 100, 10).select("id", "username", "created_at")


@query(f"SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC NULLS LAST, id)::INT AS pos FROM {CHATS} WHERE user_id IS NOT NULL AND NOT is_archived QUALIFY pos <= 10")
def recent_per_owner(spark, d):
    return chat.user_chats(current(spark, d, "chats", "id", "user_id", "last_message_at", "is_archived"), 10).select("user_id", "id", "pos")


@query(f"SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC NULLS LAST, id)::INT AS pos FROM {CHATS} WHERE user_id IS NOT NULL QUALIFY pos > 2 AND pos <= 5")
def user_chats_page(spark, d):
    return chat.user_chats(current(spark, d, "chats", "id", "user_id", "last_message_at", "is_archived"), 3, 2, include_archived=True).select("user_id", "id", "pos")


@query(f"SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at NULLS LAST, id)::INT AS pos FROM {MESSAGES} WHERE chat_id IS NOT NULL QUALIFY pos > 2 AND pos <= 7")
def messages_page(spark, d):
    m = current(spark, d, "messages", "id", "chat_id", "created_at").where("chat_id IS NOT NULL")
    return chat.page_of_each(m, "chat_id", [F.col("created_at").asc_nulls_last(), F.col("id")], 5, 2).select("chat_id", "id", "pos")


ASKED = f"lower({sql_strip('role')}) IN ('user', 'human', 'customer')"
LATEST = f"(SELECT *, (count(*) OVER (PARTITION BY chat_id) - p)::INT AS seq FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC NULLS LAST, id) AS p FROM {MESSAGES} WHERE chat_id IS NOT NULL) WHERE p <= 20)"


@query(f"SELECT chat_id, id, seq FROM {LATEST}")
def latest_n(spark, d):
    return chat.recent_messages(current(spark, d, "messages", "id", "chat_id", "created_at"), 20).select("chat_id", "id", "seq")


@query(f"SELECT chat_id, id, pos FROM (SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC NULLS LAST, id)::INT AS pos FROM {MESSAGES} WHERE chat_id IS NOT NULL) WHERE pos <= 10")
def history_window(spark, d):
    m = current(spark, d, "messages", "id", "chat_id", "created_at").where("chat_id IS NOT NULL")
    return chat.page_of_each(m, "chat_id", chat.newest("created_at", "id"), 10).select("chat_id", "id", "pos")


@query(f"SELECT c.id AS chat_id, count(m.id) AS n FROM {CHATS} c LEFT JOIN {MESSAGES} m ON m.chat_id = c.id GROUP BY c.id")
def message_counts(spark, d):
    return chat.message_counts(current(spark, d, "chats", "id"), current(spark, d, "messages", "id", "chat_id"))


@query(f"SELECT u.id AS user_id, count(c.id) AS n_all, coalesce(count_if(NOT c.is_archived), 0)::BIGINT AS n_open FROM {USERS} u LEFT JOIN {CHATS} c ON c.user_id = u.id GROUP BY u.id")
def chat_counts(spark, d):
    return chat.chat_counts(current(spark, d, "users", "id"), current(spark, d, "chats", "id", "user_id", "is_archived"))


@query(f"SELECT u.id, username, is_active, is_anonymous, count(c.id) AS chat_count FROM {USERS} u LEFT JOIN {CHATS} c ON c.user_id = u.id GROUP BY ALL")
def owner_stats(spark, d):
    return chat.user_stats(current(spark, d, "users", "id", "username", "is_active", "is_anonymous"), current(spark, d, "chats", "id", "user_id"))


@query(f"SELECT sender_id, id, row_number() OVER (PARTITION BY sender_id ORDER BY created_at DESC NULLS LAST, id)::INT AS pos FROM {MESSAGES} WHERE sender_id IS NOT NULL QUALIFY pos <= 100")
def messages_by_sender(spark, d):
    return chat.page_of_each(current(spark, d, "messages", "id", "sender_id", "created_at").where("sender_id IS NOT NULL"), "sender_id", chat.newest("created_at", "id"), 100).select("sender_id", "id", "pos")


@query(f"SELECT chat_id, id, created_at FROM {MESSAGES} WHERE lower(message_type) = 'error' ORDER BY created_at DESC NULLS LAST, id LIMIT 100")
def messages_by_type(spark, d):
    return chat.page(current(spark, d, "messages", "id", "chat_id", "message_type", "created_at").where(F.lower("message_type") == "error"), chat.newest("created_at", "id"), 100).select("chat_id", "id", "created_at")


@query(f"SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC NULLS LAST, id)::INT AS pos FROM {MESSAGES} WHERE chat_id IS NOT NULL AND content ILIKE '%quota%' QUALIFY pos <= 50")
def search_messages(spark, d):
    return chat.search_messages(current(spark, d, "messages", "id", "chat_id", "content", "created_at"), "quota").select("chat_id", "id", "pos")


@query(f"SELECT c.id AS chat_id, (row_number() OVER (PARTITION BY c.id ORDER BY m.created_at DESC NULLS LAST, m.id) - 1)::INT + CASE WHEN m.id IS NULL THEN NULL ELSE 0 END AS pos, m.id, m.role, m.created_at FROM {CHATS} c LEFT JOIN {MESSAGES} m ON m.chat_id = c.id")
def chat_with_messages(spark, d):
    w = chat.with_messages(current(spark, d, "chats", "id"), current(spark, d, "messages", "id", "chat_id", "role", "created_at"))
    return w.withColumn("pos", F.col("pos").cast("int"))


@query(f"SELECT c.id AS chat_id, coalesce(string_agg(m.id || ':' || coalesce(m.role, ''), ',' ORDER BY m.created_at DESC NULLS LAST, m.id), '') AS messages FROM {CHATS} c LEFT JOIN (SELECT * FROM {LATEST}) m ON m.chat_id = c.id GROUP BY c.id")
def chat_latest_lists(spark, d):
    w = chat.latest_lists(current(spark, d, "chats", "id"), current(spark, d, "messages", "id", "chat_id", "role", "created_at"))
    return w.select("chat_id", F.array_join(F.transform("messages", lambda x: F.concat(x["id"], F.lit(":"), F.coalesce(x["role"], F.lit("")))), ",").alias("messages"))


@query(
    f"""WITH r AS (SELECT user_id, id AS chat_id, title, row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC NULLS LAST, id)::INT AS pos FROM {CHATS} WHERE user_id IS NOT NULL AND NOT is_archived QUALIFY pos <= 5),
    m AS (SELECT chat_id, count(*) AS n, arg_min(CASE WHEN content IS NULL THEN chr(1) ELSE content END, seq) FILTER ({ASKED}) AS f FROM {LATEST} GROUP BY chat_id)
    SELECT user_id, pos, r.chat_id, CASE WHEN title IS NOT NULL AND title NOT IN ('', 'New Chat') THEN title ELSE coalesce(CASE WHEN length(f) > 50 THEN substr(f, 1, 50) || '...' ELSE nullif(f, chr(1)) END, 'New Chat') END AS title,
    coalesce(n, 0) AS n_messages FROM r LEFT JOIN m USING (chat_id)"""
)
def chat_history(spark, d):
    return chat.history(current(spark, d, "chats", "id", "user_id", "title", "last_message_at", "is_archived"), current(spark, d, "messages", "id", "chat_id", "content", "role", "created_at"))


@query(f"SELECT id, is_archived OR coalesce(last_message_at < TIMESTAMP '2025-09-01' - INTERVAL 30 DAY, false) AS is_archived FROM {CHATS}")
def archive_old(spark, d):
    return chat.archive_old(current(spark, d, "chats", "id", "last_message_at", "is_archived"), AS_OF).select("id", "is_archived")


@query(f"SELECT id FROM {MESSAGES} WHERE created_at IS NULL OR created_at >= TIMESTAMP '2025-09-01' - INTERVAL 90 DAY")
def delete_old(spark, d):
    return chat.delete_old(current(spark, d, "messages", "id", "created_at"), AS_OF).select("id")


@query(f"SELECT id, CASE WHEN title IS NULL OR title = '' THEN 'New Chat' ELSE title END AS title FROM {CHATS}")
def update_titles(spark, d):
    c = current(spark, d, "chats", "id", "title")
    return chat.set_where(c, F.col("title").isNull() | (F.col("title") == ""), title="New Chat").select("id", "title")


@query(f"SELECT m.id, m.chat_id FROM {MESSAGES} m WHERE chat_id IS NULL OR chat_id NOT IN (SELECT id FROM {CHATS} WHERE is_archived)")
def delete_cascade(spark, d):
    c = current(spark, d, "chats", "id", "is_archived")
    gone = c.where("is_archived").select(F.col("id").alias("chat_id"))
    return chat.delete_chats(c, current(spark, d, "messages", "id", "chat_id"), gone)[1].select("id", "chat_id")


PAIR = f"(SELECT min(id) FILTER (is_anonymous) AS from_id, min(id) FILTER (NOT is_anonymous) AS to_id FROM {USERS})"


def _pair(u: DataFrame) -> DataFrame:
    return u.agg(F.min(F.when(F.col("is_anonymous"), F.col("id"))).alias("from_id"), F.min(F.when(~F.col("is_anonymous"), F.col("id"))).alias("to_id"))


@query(f"SELECT c.id, CASE WHEN c.user_id = p.from_id THEN p.to_id ELSE c.user_id END AS user_id FROM {CHATS} c, {PAIR} p")
def merge_owner(spark, d):
    u = current(spark, d, "users", "id", "is_active", "is_anonymous")
    return chat.merge_users(u, current(spark, d, "chats", "id", "user_id"), _pair(u))[1].select("id", "user_id")


@query(f"SELECT u.id, u.is_active AND NOT coalesce(u.id = p.from_id, false) AS is_active FROM {USERS} u, {PAIR} p")
def merge_deactivates(spark, d):
    u = current(spark, d, "users", "id", "is_active", "is_anonymous")
    return chat.merge_users(u, current(spark, d, "chats", "id", "user_id"), _pair(u))[0].select("id", "is_active")


@query("SELECT id AS value, count(*) AS n FROM messages WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def not_unique(spark, d):
    return chat.not_unique(table(spark, d, "messages"), "id")


@query(
    """SELECT 'username' AS field, username AS value, count(*) AS n FROM users WHERE username IS NOT NULL GROUP BY username HAVING count(*) > 1
    UNION ALL SELECT 'email', lower(email), count(*) FROM users WHERE email IS NOT NULL GROUP BY lower(email) HAVING count(*) > 1"""
)
def user_clashes(spark, d):
    u = table(spark, d, "users").withColumn("email", F.lower("email"))
    names, mails = (chat.not_unique(u, c).select(F.lit(c).alias("field"), "value", "n") for c in ("username", "email"))
    return names.unionByName(mails)


@query(f"SELECT id, username, created_at FROM {USERS} WHERE is_anonymous ORDER BY created_at DESC NULLS LAST, id LIMIT 100")
def anonymous_users(spark, d):
    u = current(spark, d, "users", "id", "username", "is_anonymous", "created_at").where("is_anonymous")
    return chat.page(u, chat.newest("created_at", "id"), 100).select("id", "username", "created_at")


@query(f"SELECT id, is_active AND NOT coalesce(is_anonymous AND created_at < TIMESTAMP '2025-03-01', false) AS is_active FROM {USERS}")
def soft_delete(spark, d):
    u = current(spark, d, "users", "id", "is_active", "is_anonymous", "created_at")
    return chat.deactivate(u, u.where("is_anonymous AND created_at < TIMESTAMP_NTZ '2025-03-01 00:00:00'")).select("id", "is_active")


NEW_USERS = "SELECT id || CASE WHEN is_anonymous THEN '' ELSE 'x' END AS id, CASE WHEN is_active THEN username ELSE username || '2' END AS username FROM"


@query(
    f"""WITH u AS (SELECT id, username FROM {USERS}), n AS ({NEW_USERS} {USERS}),
    a AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM u) QUALIFY row_number() OVER (PARTITION BY id ORDER BY id, username) = 1),
    b AS (SELECT * FROM a WHERE username IS NULL OR username NOT IN (SELECT username FROM u WHERE username IS NOT NULL) QUALIFY username IS NULL OR row_number() OVER (PARTITION BY username ORDER BY id, username) = 1)
    SELECT id, username, 'table' AS part FROM u UNION ALL SELECT id, username, 'table' FROM b UNION ALL SELECT id, username, 'rejected' FROM n WHERE (id) NOT IN (SELECT id FROM b)"""
)
def insert_users(spark, d):
    u = current(spark, d, "users", "id", "username", "is_active", "is_anonymous")
    new = u.select(F.concat("id", F.when(F.col("is_anonymous"), "").otherwise("x")).alias("id"), F.when(F.col("is_active"), F.col("username")).otherwise(F.concat("username", F.lit("2"))).alias("username"))
    full, rejected = chat.insert(u.select("id", "username"), new, ["id", "username"])
    return full.withColumn("part", F.lit("table")).unionByName(rejected.withColumn("part", F.lit("rejected")))


@query(f"SELECT m.chat_id, m.sender_id AS user_id, coalesce(bool_or(c.user_id = m.sender_id), false) AS owned FROM (SELECT DISTINCT chat_id, sender_id FROM {MESSAGES} WHERE sender_id IS NOT NULL) m LEFT JOIN {CHATS} c ON c.id = m.chat_id GROUP BY m.chat_id, m.sender_id")
def ownership(spark, d):
    asks = current(spark, d, "messages", "id", "chat_id", "sender_id").where("sender_id IS NOT NULL").select("chat_id", F.col("sender_id").alias("user_id")).distinct()
    return chat.owned(current(spark, d, "chats", "id", "user_id"), asks)


# Asks made of the store itself: every user asks for something of a chat, some for one that is not theirs.
ASKS = f"""(SELECT c.id AS chat_id, CASE WHEN c.id < '4' THEN (SELECT min(id) FROM {USERS}) ELSE c.user_id END AS user_id, CASE WHEN c.id < '8' THEN 'title' WHEN c.id < 'a' THEN 'archive' WHEN c.id < 'c' THEN 'delete' ELSE 'rename' END AS action,
    'new ' || left(c.id, 4) AS title FROM {CHATS} c)"""


@query(
    f"""WITH a AS {ASKS}, g AS (SELECT a.* FROM a JOIN {CHATS} c ON c.id = a.chat_id AND c.user_id = a.user_id WHERE action <> 'rename'), n AS (SELECT count(*) AS n, chat_id AS id FROM {MESSAGES} WHERE chat_id IS NOT NULL GROUP BY chat_id)
    SELECT c.id, coalesce(g.title, c.title) AS title, c.is_archived, coalesce(n, 0) AS n FROM {CHATS} c LEFT JOIN g ON g.chat_id = c.id AND g.action = 'title' LEFT JOIN n ON n.id = c.id WHERE c.id < '8' OR c.id >= 'c'
    UNION ALL SELECT c.id, c.title, c.is_archived OR g.chat_id IS NOT NULL, coalesce(n, 0) FROM {CHATS} c LEFT JOIN g ON g.chat_id = c.id LEFT JOIN n ON n.id = c.id WHERE c.id >= '8' AND c.id < 'a'
    UNION ALL SELECT c.id, c.title, c.is_archived, coalesce(n, 0) FROM {CHATS} c LEFT JOIN n ON n.id = c.id WHERE c.id >= 'a' AND c.id < 'c' AND c.id NOT IN (SELECT chat_id FROM g)
    UNION ALL SELECT 'refused', action, NULL, count(*) FROM a WHERE (chat_id, action) NOT IN (SELECT (chat_id, action) FROM g) GROUP BY action"""
)
def owner_services(spark, d):
    """Chats with the number of their messages after every ask, and the refused asks by action."""
    c = current(spark, d, "chats", "id", "user_id", "title", "is_archived")
    first = current(spark, d, "users", "id").agg(F.min("id").alias("first"))
    action = F.when(F.col("id") < "8", "title").when(F.col("id") < "a", "archive").when(F.col("id") < "c", "delete").otherwise("rename")
    asks = c.join(F.broadcast(first)).select(F.col("id").alias("chat_id"), F.when(F.col("id") < "4", F.col("first")).otherwise(F.col("user_id")).alias("user_id"), action.alias("action"), F.concat(F.lit("new "), F.left("id", F.lit(4))).alias("title"))
    new, m, refused = chat.apply_owned(c, current(spark, d, "messages", "id", "chat_id"), asks)
    n = chat.message_counts(new, m).withColumnRenamed("chat_id", "id")
    kept = new.join(n, "id").select("id", "title", "is_archived", "n")
    return kept.unionByName(refused.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit("refused").alias("id"), F.col("action").alias("title"), F.lit(None).cast("boolean").alias("is_archived"), "n"))


@query(f"SELECT c.id, greatest(c.last_message_at, max(m.created_at)) AS last_message_at FROM {CHATS} c LEFT JOIN {MESSAGES} m ON m.chat_id = c.id GROUP BY c.id, c.last_message_at")
def touch_chats(spark, d):
    return chat.touch_chats(current(spark, d, "chats", "id", "last_message_at"), current(spark, d, "messages", "id", "chat_id", "created_at")).select("id", "last_message_at")


@query(f"SELECT id FROM {MESSAGES} WHERE length(content) BETWEEN 1 AND 2000")
def valid_messages(spark, d):
    return chat.valid_messages(current(spark, d, "messages", "id", "content")).select("id")


# ---------------------------------------------------------------- cache and streams


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos FROM events QUALIFY pos < 20")
def bounded_cache_first(spark, d):
    return cache.bounded(table(spark, d, "events"), "user_id", ["ts", "event_id"], 20, "first").select("user_id", "event_id", F.col("pos").cast("int").alias("pos"))


@query("SELECT user_id, event_id, (max(r) OVER (PARTITION BY user_id) - r)::INT AS pos FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def bounded_cache(spark, d):
    return cache.bounded(table(spark, d, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", F.col("pos").cast("int").alias("pos"))


@query("SELECT user_id, event_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000, false)::INT AS n FROM events)")
def cache_ttl(spark, d):
    return cache.segments(table(spark, d, "events"), "user_id", "ts", ["event_id"]).select("user_id", "event_id", "segment")


@query("WITH c AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, event_id FROM events WHERE event_type = 'view') SELECT *, 'cache' AS origin FROM c UNION ALL SELECT *, 'store' FROM s WHERE user_id NOT IN (SELECT user_id FROM c)")
def cache_aside(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return cache.cache_aside(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), "user_id")


@query(
    """WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT * FROM c UNION ALL SELECT user_id, event_id, ts FROM events WHERE event_type <> 'purchase' AND user_id NOT IN (SELECT user_id FROM c)),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM b) SELECT user_id, event_id, (max(r) OVER (PARTITION BY user_id) - r)::INT AS pos FROM k WHERE r <= 20"""
)
def cache_filled(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    f = cache.filled(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type <> 'purchase'").drop("event_type"), "user_id", ["ts", "event_id"])
    return f.select("user_id", "event_id", F.col("pos").cast("int").alias("pos"))


@query(
    f"""WITH l AS (SELECT user_id, id, (row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC NULLS LAST, id) - 1)::INT AS pos FROM {CHATS} WHERE user_id IS NOT NULL)
    SELECT user_id, pos, l.id, title FROM l JOIN (SELECT id, title FROM {CHATS} WHERE title <> '') e ON e.id = l.id WHERE pos < 5"""
)
def cached_chats(spark, d):
    """Lists of chat ids cut to five, then joined to the cached entries: those without an entry fall out."""
    c = current(spark, d, "chats", "id", "user_id", "title", "last_message_at")
    ids = chat.user_chats(c, 20, include_archived=True).select("user_id", "id", (F.col("pos") - 1).alias("pos"))
    return cache.read_entries(ids, c.where("title <> ''").select("id", "title"), "user_id", "id", 5).select("user_id", "pos", "id", "title")


@query(
    f"""WITH p AS {PAIR}, a AS (SELECT user_id, id, last_message_at FROM {CHATS} WHERE user_id IS NOT NULL AND last_message_at IS NOT NULL),
    l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC, id DESC) <= 5),
    m AS (SELECT CASE WHEN user_id = from_id THEN to_id ELSE user_id END AS user_id, id, last_message_at FROM l, p),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC, id DESC) AS r FROM m)
    SELECT user_id, id, (max(r) OVER (PARTITION BY user_id) - r)::INT AS pos FROM k WHERE r <= 5"""
)
def merged_lists(spark, d):
    c = current(spark, d, "chats", "id", "user_id", "last_message_at").where("user_id IS NOT NULL AND last_message_at IS NOT NULL")
    lists = cache.bounded(c, "user_id", ["last_message_at", "id"], 5)
    pairs = _pair(current(spark, d, "users", "id", "is_anonymous"))
    return cache.merge_lists(lists, pairs, "user_id", ["last_message_at", "id"]).select("user_id", "id", F.col("pos").cast("int").alias("pos"))


@query("SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE user_id % 7 = 0)")
def cache_invalidate(spark, d):
    e = table(spark, d, "events")
    return cache.invalidate(e, e.where("user_id % 7 = 0"), "user_id").select("user_id", "event_id")


@query("SELECT json_extract_string(meta_info, '$.model') AS model, TRY_CAST(json_extract_string(meta_info, '$.latency_ms') AS BIGINT) AS latency_ms FROM messages WHERE json_valid(meta_info) AND json_type(meta_info) = 'OBJECT'")
def rehydrate(spark, d):
    return cache.rehydrate(table(spark, d, "messages"), "meta_info", "model string, latency_ms bigint")


SSE_SPARK = "concat('event: meta\r\ndata: {\"id\": ', doc_id, '}\r\n\r\ndata: ', coalesce(n_chars, 0), '\n\nevent: done\ndata: oops\n\n')"


@query(
    """SELECT doc_id, 0 AS seq, 'meta' AS event, '{"id": ' || doc_id || '}' AS data FROM documents UNION ALL SELECT doc_id, 1, 'message', coalesce(n_chars, 0)::VARCHAR FROM documents
    UNION ALL SELECT doc_id, 2, 'done', '{}' FROM documents"""
)
def sse_parse(spark, d):
    body = F.concat(F.lit("event: meta\r\ndata: {\"id\": "), F.col("doc_id").cast("string"), F.lit("}\r\n\r\ndata: "), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit("\n\nevent: done\ndata: oops\n\n"))
    e = table(spark, d, "documents").select("doc_id", F.posexplode(T.sse_events(body)).alias("seq", "e"))
    return e.select("doc_id", "seq", "e.event", "e.data")


@query("SELECT user_id, max(ts)::TIMESTAMP AS last FROM events GROUP BY user_id")
def stream_last_seen(spark, d):
    schema = table(spark, d, "events").schema
    s = state.read_stream(spark, f"{d}/events.parquet*", schema)
    return state.run_once(state.last_seen(s, "user_id", "ts"), "last_seen", "complete").select("user_id", F.col("last").cast("timestamp_ntz").alias("last"))


# ---------------------------------------------------------------- ingest


@query(
    f"""SELECT path, md5(l) AS hash FROM (SELECT coalesce(nullif(relative_path, ''), 'page_' || page_id) AS path, CASE WHEN lower(coalesce(file_type, '')) IN ('.html', '.htm', 'html', 'htm') THEN {sql_page_letters('content')}
    ELSE regexp_replace(coalesce(content, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g') END AS l FROM {PAGES}) WHERE l <> ''"""
)
def ingest_chunks(spark, d):
    """The ingest of all pages without overlap: the letters of each document's chunks, in order, are those of its text."""
    s = pipeline.Settings(backend="text", selector=None, chunk_overlap=0, min_chunk=1)
    docs = files.unique_paths(pages_of(spark, d, "page_id", "relative_path", "file_type", "content"), "relative_path", "page_id")
    c = pipeline.REGISTRY["text"](s)(docs.select("relative_path", "file_type", "content"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")
    letters = F.regexp_replace("t", LETTERS, "")
    return c.groupBy("relative_path").agg(text.alias("t")).where(letters != "").select(F.col("relative_path").alias("path"), F.md5(letters).alias("hash"))

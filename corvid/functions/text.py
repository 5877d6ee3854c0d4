"""Column functions on text. All stay in the JVM; null in gives null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that results depend on.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
EDGES = r"(?U)^\s+|\s+$"
WORDY = r"[a-zA-Z0-9\x{4E00}-\x{9FFF}]"
HTML_BLOCKS = ["nav", "footer", "header", "aside"]
URL_EXCLUDED = ["/search", "/sitemap", "/404", "/blog", "/community", "/partners", "/case-studies", "#", "mailto:", "javascript:"]
URL_SECTIONS = ["/docs/concepts/", "/docs/tasks/", "/docs/reference/", "/docs/setup/", "/docs/tutorials/"]
# How a speaker's role may be written, apart from case and outer white space.
ROLES = {"system": ["system"], "user": ["user", "human", "customer"], "assistant": ["assistant", "ai", "bot"]}
#: The analyzer's tokens: runs of letters and digits, one token for each Chinese character.
TOKEN = r"[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+|[\x{4E00}-\x{9FFF}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim knows only the space)."""
    return F.regexp_replace(col(c), EDGES, "")


def clean_text(c: str | Column) -> Column:
    """Control characters out, runs of spaces and tabs to one space, three or more newlines to two, stripped; null gives ''."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), CONTROL, "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_text_flat(c: str | Column) -> Column:
    """Control characters out and every run of white space to one space, stripped; null gives ''."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), CONTROL, "")
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_html(c: str | Column) -> Column:
    """HTML without comments, scripts, styles, noscript and the site's nav, footer, header and aside blocks."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in ["script", "style", "noscript", *HTML_BLOCKS]:
        x = F.regexp_replace(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return x


def clean_html_legacy(c: str | Column) -> Column:
    """HTML without comments, scripts and styles, white space collapsed; keeps navigation and footers."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in ["script", "style"]:
        x = F.regexp_replace(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def valid_text(c: str | Column, min_length: int = 10) -> Column:
    """Whether the stripped text has the length and any ASCII letter, digit or Chinese character; null is invalid."""
    return F.coalesce((F.length(strip(c)) >= min_length) & col(c).rlike(WORDY), F.lit(False))


def clean_key(c: Column) -> Column:
    """A metadata key with everything but word characters, '-', '_' and '.' turned into '_'."""
    return F.regexp_replace(c, r"(?U)[^\w\-_.]", "_")


def clean_metadata(c: str | Column) -> Column:
    """A string map with cleaned keys and '' for null values. Keys that collide: the last wins, in map order."""
    e = F.map_entries(col(c))
    pairs = F.transform(e, lambda x: F.struct(clean_key(x["key"]).alias("key"), F.coalesce(x["value"], F.lit("")).alias("value")))
    kept = F.filter(
        F.transform(pairs, lambda x, i: F.struct(x["key"].alias("key"), x["value"].alias("value"), i.alias("i"))),
        lambda x: ~F.exists(F.slice(pairs, x["i"] + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["key"] == x["key"]),
    )
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"], x["value"])))


def tokens(c: str | Column) -> Column:
    """Lower-case analyzer tokens of a text; [] for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def preview(c: str | Column, n: int = 200) -> Column:
    """The first ``n`` characters, with '...' where something is cut."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def title_of(text: str | Column, fallback: str | Column) -> Column:
    """From the first ten lines the first '# heading' or 'title: x', else ``fallback``."""
    lines = F.transform(F.slice(F.split(F.coalesce(col(text), F.lit("")), "\n"), 1, 10), lambda x: strip(x))
    heads = F.filter(lines, lambda x: x.startswith("# ") | F.lower(x).startswith("title:"))
    head = F.get(heads, F.lit(0))
    return F.coalesce(F.when(head.startswith("# "), strip(F.substr(head, F.lit(3)))).otherwise(strip(F.substr(head, F.lit(7)))), col(fallback))


def conversation_title(title: str | Column, first_user_text: str | Column) -> Column:
    """The title, unless it is empty or the placeholder: then 50 characters of the first user message, else the placeholder."""
    t = col(title)
    u = col(first_user_text)
    short = F.when(F.length(u) > 50, F.concat(F.substring(u, 1, 50), F.lit("..."))).otherwise(u)
    usable = t.isNotNull() & ~t.isin("", "New Chat")
    return F.when(usable, t).otherwise(F.coalesce(short, F.lit("New Chat")))


def excluded_path(c: str | Column, patterns: list[str]) -> Column:
    """Whether a path contains any of the substrings."""
    return reduce(lambda a, b: a | b, [col(c).contains(p) for p in patterns], F.lit(False))


def is_doc_url(c: str | Column, base: str | Column) -> Column:
    """Whether a URL starts with the base, holds no excluded substring and at least one documentation section."""
    hit = reduce(lambda a, b: a | b, [col(c).contains(p) for p in URL_SECTIONS])
    return F.coalesce(col(c).startswith(col(base) if isinstance(base, Column) else F.lit(base)) & ~excluded_path(c, URL_EXCLUDED) & hit, F.lit(False))


def url_filename(c: str | Column) -> Column:
    """A file name for a URL: its path without outer slashes, '/' and '-' as '_', ending in .html; 'index' for an empty path."""
    p = F.coalesce(F.regexp_extract(col(c), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    p = F.translate(F.regexp_replace(p, "^/+|/+$", ""), "/-", "__")
    p = F.when(p == "", "index").otherwise(p)
    return F.when(col(c).isNull(), F.lit(None)).when(p.endswith(".html"), p).otherwise(F.concat(p, F.lit(".html")))


def hrefs(c: str | Column) -> Column:
    """The targets of all <a href="..."> of a page, in order; [] for null."""
    return F.coalesce(F.regexp_extract_all(col(c), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)), F.array().cast("array<string>"))


def canonical_role(c: str | Column) -> Column:
    """system, user or assistant; null for anything else, null included."""
    r = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for role, names in ROLES.items():
        out = F.when(r.isin(names), F.lit(role)).otherwise(out)
    return out


def valid_message(text: str | Column, low: int = 1, high: int = 2000) -> Column:
    """Whether a message's length is within the accepted range; null is not."""
    return F.coalesce(F.length(col(text)).between(low, high), F.lit(False))


def anon_uuid(c: str | Column) -> Column:
    """anon_ + 32 hex digits as a dashed id; null for anything else."""
    h = F.lower(F.substring(col(c), 6, 32))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(col(c).rlike("^anon_[0-9a-fA-F]{32}$"), F.concat_ws("-", *cut))


def entity_text(text: Column, content: Column, data: Column, metadata_json: Column) -> Column:
    """The first non-empty of text, content, data, the metadata's text and content, and those of its _node_content."""
    full = lambda x: F.nullif(x, F.lit(""))
    node = F.get_json_object(metadata_json, "$._node_content")
    return F.coalesce(
        full(text),
        full(content),
        full(data),
        full(F.get_json_object(metadata_json, "$.text")),
        full(F.get_json_object(metadata_json, "$.content")),
        full(F.get_json_object(node, "$.text")),
        full(F.get_json_object(node, "$.content")),
    )


def json_map(c: str | Column) -> Column:
    """A JSON object as a string map; null for null or malformed input. Nested values stay JSON text."""
    return F.from_json(col(c), "map<string,string>")


def merge_metadata(metadata: Column, extra: dict[str, Column]) -> Column:
    """A map with the extra entries added where it lacks the key; null values are not added."""
    more = F.map_from_arrays(F.array(*[F.lit(k) for k in extra]), F.array(*[v.cast("string") for v in extra.values()]))
    base = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(more, lambda k, v: v.isNotNull() & ~F.map_contains_key(base, k)), base)


def sse_events(c: str | Column) -> Column:
    """Events of a server-sent stream: array of (event, data). CRLF counts as LF, blocks end at a blank line, data
    lines join by newline, the default event is 'message', data that is no JSON object becomes '{}'."""
    blocks = F.filter(F.split(F.regexp_replace(col(c), "\r\n", "\n"), "\n\n"), lambda b: F.length(strip(b)) > 0)

    def one(b):
        lines = F.split(b, "\n")
        names = F.filter(lines, lambda x: x.startswith("event:"))
        name = F.get(names, F.size(names) - 1)
        data = F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: strip(F.substr(x, F.lit(6)))), "\n")
        return F.struct(
            F.coalesce(strip(F.substr(name, F.lit(7))), F.lit("message")).alias("event"),
            F.when(F.try_parse_json(data).isNotNull(), data).otherwise(F.lit("{}")).alias("data"),
        )

    return F.transform(blocks, one)


def sse_consumed(c: str | Column) -> Column:
    """What a reader of a server-sent stream takes: struct(events, status, message). Events end before the first 'done' or 'error';
    status is 'done', 'error' (with its message) or 'open' for a stream that ends without either."""
    e = sse_events(c)
    stop = F.array_position(F.transform(e, lambda x: x["event"].isin("done", "error")), True)
    last = F.when(stop > 0, F.get(e, (stop - 1).cast("int")))
    status = F.coalesce(last["event"], F.lit("open"))
    upto = F.when(stop > 0, F.slice(e, F.lit(1), (stop - 1).cast("int"))).otherwise(e)
    return F.struct(upto.alias("events"), status.alias("status"), F.when(status == "error", F.get_json_object(last["data"], "$.message")).alias("message"))


def sse_strict(c: str | Column) -> Column:
    """The events of ``sse_consumed``; a stream with an error event fails the query when it is read."""
    x = sse_consumed(c)
    return F.when(x["status"] == "error", F.raise_error(F.coalesce(x["message"], F.lit("stream error")))).otherwise(x["events"])

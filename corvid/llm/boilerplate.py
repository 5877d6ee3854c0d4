"""Main content of web pages by minimum-cut labelling.

1. Every page is cut into visible lines with their place in the markup (a stack of boxes), once.
2. How many pages, and how many pages of the same site, show a line is counted over the whole corpus.
3. A line classifier is fitted on a bounded sample of pages whose markup says where the body is (the box
   around the page's heading); it prices each line of every page as content or as boilerplate.
4. On each page these prices are terminal capacities; neighbouring lines and lines of one box are tied by
   smoothness edges. The maximum flow's cut separates the body from the rest.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.session import BROADCAST_BYTES, bytes_of, prepare, sent, stage

#: Pages of the classifier's training sample at most: those of the smallest hash of page_id among the labelled ones.
TRAIN_PAGES = 3000
#: A line is frequent if it stands on at least this many pages and on this share of its site's, or of all, pages.
FREQUENT, SITE_SHARE, ALL_SHARE = 3, 0.04, 0.01
#: Where the table of frequent lines is too large to broadcast, a line of a site is spread over so many tasks.
SALTS = 32
#: Smoothness between neighbouring lines, across box borders, and between a line and its box.
W_NEXT, W_CROSS, W_BOX = 0.25, 0.08, 0.08
PRICE_CAP = 6.0
HASHED = 1 << 12

# Elements that open a box, and those whose text no reader sees.
BOXES = {"div", "nav", "aside", "header", "footer", "main", "article", "section", "form"}
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LINK, SENTENCE, TITLE, HEADING, ITEM, ROW, CODE, SITE, CRUMB, GAP = (1 << k for k in range(10))

_PLAIN = re.compile(r"\s*<(p|li|span|div|strong|h[1-6]|b|em)(?:\s[^<>]*)?>([^<>]*)</\1>\s*", re.I)
_LINKED = re.compile(r"\s*(<li(?:\s[^<>]*)?>)?<a\s[^<>]*>([^<>]*)</a>(?:</li>)?\s*", re.I)
_TOKEN = re.compile(r"<!--|-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
_MD_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_END = re.compile(r"[.!?。！？…:：;)）][\"'”’»`]*$")
_DIGITS = re.compile(r"\d+")
_CRUMB = re.compile(r"\s(?:>|»|/|›|→|\|)\s")
_CODE = re.compile(r"^\s*[\w.\-]+:\s+\S+$|--[\w\-]+=|^\d\d:\d\d:\d\d|^\s*[{}\[\]();$#]|^\S+ \S+ \S+ --|[{};]\s*$")


def site_of(c_url, c_path):
    """The host of a URL, else of the mirror path, else ''."""
    host = F.regexp_extract(c_url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]+)", 1)
    path = F.regexp_extract(c_path, r"([a-zA-Z0-9\-]+\.[a-zA-Z0-9.\-]+)/", 1)
    return F.lower(F.coalesce(F.nullif(host, F.lit("")), F.nullif(path, F.lit("")), F.lit("")))


def visible_lines(content: str | None, site: str = "") -> tuple[list[tuple[int, int, int, int, int]], list[int], int]:
    """((line number, text hash, length, flags, box) of each line with visible text; the boxes' parents; the box of the body
    or -1). Lines are split at newlines and numbered from 1. Boxes are numbered as they open, 0 is the page.

    The body's box is that of the heading of first rank, outermost; it serves to label training pages and as a feature.
    """
    lines = (content or "").split("\n")
    out, parents = [], [-1]
    stack: list[tuple[str, int]] = []
    box, hidden, comment, pre, fence, gap = 0, 0, False, 0, False, True
    markup = bool(re.search(r"</?(?:html|body|div|p|li|main|article|nav)\b", content or "", re.I))
    name = site.split(".")[0] if site else ""
    title_box = -1
    tails: set[str] = set()
    for no, raw in enumerate(lines, 1):
        line = raw
        flags = 0
        here = box
        if markup and ("<" in line or comment or hidden):
            m = None if comment or hidden or pre else _PLAIN.fullmatch(line)
            if m:
                tag, text = m.group(1).lower(), m.group(2)
                if tag == "li":
                    flags |= ITEM
                elif tag == "h1":
                    flags |= TITLE
                elif tag[0] in "hbs" and tag != "span":
                    flags |= HEADING
            elif m := (None if comment or hidden or pre else _LINKED.fullmatch(line)):
                text = m.group(2)
                flags |= LINK | (ITEM if m.group(1) else 0)
            else:
                parts, at, linked, inside_a = [], 0, 0, False
                for t in _TOKEN.finditer(line):
                    if not comment and not hidden and t.start() > at:
                        parts.append(line[at : t.start()])
                        linked += inside_a * (t.start() - at)
                    at = t.end()
                    whole = t.group()
                    if comment:
                        comment = whole != "-->"
                        continue
                    if whole == "<!--":
                        comment = True
                        continue
                    if whole == "-->":
                        continue
                    tag = t.group(2).lower()
                    if t.group(1):
                        if tag in HIDDEN:
                            hidden = max(0, hidden - 1)
                        elif hidden:
                            pass
                        elif tag == "a":
                            inside_a = False
                        elif tag == "pre":
                            pre = max(0, pre - 1)
                        elif tag in BOXES:
                            for k in range(len(stack) - 1, -1, -1):
                                if stack[k][0] == tag:
                                    box = parents[stack[k][1]]
                                    del stack[k:]
                                    break
                    elif tag in VOID or t.group(3).endswith("/"):
                        pass
                    elif tag in HIDDEN:
                        hidden += 1
                    elif hidden:
                        pass
                    elif tag == "a":
                        inside_a = True
                    elif tag == "pre":
                        pre += 1
                    elif tag in BOXES:
                        parents.append(box)
                        box = len(parents) - 1
                        stack.append((tag, box))
                        here = box
                    elif tag == "h1":
                        flags |= TITLE
                    elif tag in ("h2", "h3", "h4", "strong"):
                        flags |= HEADING
                    elif tag == "li":
                        flags |= ITEM
                    elif tag == "tr":
                        flags |= ROW
                    elif tag == "code":
                        flags |= CODE
                if not comment and not hidden and at < len(line):
                    parts.append(line[at:])
                text = "".join(parts)
                if linked and linked >= 0.9 * len(text):
                    flags |= LINK
            if pre:
                flags |= CODE
        else:
            text = line
            s = line.strip()
            if not markup:
                if s.startswith("```"):
                    fence = not fence
                    gap = False
                    continue
                if s.startswith("# "):
                    flags |= TITLE
                    text = s[2:]
                elif s.startswith("#") and s.lstrip("#").startswith(" "):
                    flags |= HEADING
                elif s.startswith("**") and s.endswith("**") and len(s) > 4:
                    flags |= HEADING
                    text = s[2:-2]
                elif s.startswith(("* ", "- ", "+ ")):
                    flags |= ITEM
                    text = s[2:]
                elif s.startswith("|") or s.count("  ") >= 2:
                    flags |= ROW
                if "](" in text:
                    plain = _MD_LINK.sub(r"\1", text)
                    if not _MD_LINK.sub("", text).strip():
                        flags |= LINK
                    text = plain
                if fence:
                    flags |= CODE
            elif pre:
                flags |= CODE
        text = html.unescape(text).strip() if "&" in text else text.strip()
        if not text or not any(map(str.isalnum, text)) and not re.search(r"[^\W_]|[^\s\w]", text):
            gap = gap or not raw.strip()
            continue
        low = text.lower()
        if name and name in low:
            low = low.replace(name, "@")
            flags |= SITE
        if _END.search(text):
            flags |= SENTENCE
        if flags & (ITEM | LINK) == 0 and _CODE.search(text):
            flags |= CODE
        if len(text) < 160 and (crumb := _CRUMB.search(text)):
            flags |= CRUMB
            path = low.split(crumb.group(), 2)
            if len(path) == 3:
                tails.add(path[2].strip())
        if not markup and low in tails and not flags & (ITEM | LINK):
            flags |= TITLE
        if gap:
            flags |= GAP
        gap = False
        if flags & TITLE and title_box < 0:
            title_box = here
        if not flags & CODE:
            low = _DIGITS.sub("#", low)
        out.append((no, xxhash.xxh64_intdigest(low) - (1 << 63), len(text), flags, here))
    body = title_box
    while body > 0 and parents[body] > 0:
        body = parents[body]
    return out, parents, body if markup else (-1 if title_box < 0 else 0)


def gold(boxes: np.ndarray, body: int, flags: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """1 for lines right in the body's box or in the box of its heading, but for frequent ones; 0 for all others: what the
    markup of a page with a heading says."""
    heads = set(boxes[(flags & TITLE) > 0].tolist()) | {body}
    return (np.isin(boxes, list(heads)) & ((rate == 0) | (flags & TITLE > 0))).astype(np.int8)


def max_flow_cut(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut of nodes 0..n-1 with capacities from the source, to the sink and both ways along ``edges``, by shortest
    augmenting paths. True: on the source's side."""
    s, t = n, n + 1
    to, cap = [], []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u, v, c, back):
        adj[u].append(len(to))
        to.append(v)
        cap.append(c)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        # What flows straight through a node is left out: it changes no cut.
        both = min(source[i], sink[i])
        if source[i] > both:
            add(s, i, source[i] - both, 0.0)
        elif sink[i] > both:
            add(i, t, sink[i] - both, 0.0)
    for u, v, c in edges:
        if c > 0 and u != v:
            add(u, v, c, c)
    eps = 1e-9
    while True:
        via = [-1] * (n + 2)
        via[s] = -2
        queue = deque([s])
        while queue and via[t] == -1:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > eps and via[to[e]] == -1:
                    via[to[e]] = e
                    queue.append(to[e])
        if via[t] == -1:
            return [via[i] != -1 for i in range(n)]
        flow, v = float("inf"), t
        while v != s:
            flow = min(flow, cap[via[v]])
            v = to[via[v] ^ 1]
        v = t
        while v != s:
            cap[via[v]] -= flow
            cap[via[v] ^ 1] += flow
            v = to[via[v] ^ 1]


def features(h, length, flags, boxes, parents, body, rate, share):
    """(dense, hashed, box features) of the lines of one page; ``rate`` and ``share`` say on which share of all pages, and of
    its site's pages, a frequent line stands; 0 for others."""
    n = len(h)
    freq = rate > 0
    bit = lambda b: (flags & b > 0).astype(np.float32)
    sentence = bit(SENTENCE) * (length >= 40)
    unique = ~freq
    good = (unique & (sentence > 0)).astype(np.float32)
    before = np.cumsum(good) - good
    after = good.sum() - before - good
    idx = np.arange(n)
    prev = np.maximum.accumulate(np.where(freq, idx, -1))
    prev = np.concatenate([[-1], prev[:-1]])
    nxt = np.minimum.accumulate(np.where(freq, idx, n)[::-1])[::-1]
    nxt = np.concatenate([nxt[1:], [n]])
    dp, dn = np.where(prev >= 0, idx - prev, 99), np.where(nxt < n, nxt - idx, 99)
    titles = np.flatnonzero(flags & TITLE)
    # Lists of related pages may name the page as well: the title is followed by a sentence.
    lead = [t for t in titles if good[t + 1 : t + 3].any()]
    title = int((lead or titles)[0]) if len(titles) else -1
    dense = np.stack(
        [
            np.ones(n),
            np.log1p(rate * 1000) / 4,
            share,
            freq,
            np.log1p(length) / 4,
            sentence,
            bit(SENTENCE),
            bit(LINK),
            bit(HEADING),
            bit(ITEM),
            bit(ROW),
            bit(CODE),
            bit(SITE),
            bit(CRUMB),
            bit(LINK) * unique,
            (length < 40) * unique,
            before == 0,
            before >= 3,
            after == 0,
            after >= 3,
            dp == 1,
            dn == 1,
            (dp == 1) & (dn == 1),
            np.minimum(dp, 8) / 8,
            np.minimum(dn, 8) / 8,
            idx / max(1, n),
            np.full(n, title >= 0),
            (idx < title) if title >= 0 else np.zeros(n),
            (idx > title) & (title >= 0),
            idx == title,
        ],
        axis=1,
    ).astype(np.float32)
    hp = np.where(prev >= 0, h[np.maximum(prev, 0)], 7)
    hn = np.where(nxt < n, h[np.minimum(nxt, n - 1)], 11)
    near = np.digitize(dp, [2, 3, 5, 9])
    kind = sentence.astype(np.int64) + 2 * (flags & LINK > 0)
    cat = np.stack(
        [
            np.where(freq, h, 13),
            hp * 31 + near * 7 + kind,
            hn * 37 + np.digitize(dn, [2, 3, 5]) * 5 + kind,
            hp * 41 + hn * 43 + near,
        ],
        axis=1,
    )
    x = cat.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    cat = ((x >> np.uint64(64 - 12)).astype(np.int64) + np.arange(4) * HASHED).astype(np.int32)
    inside = np.zeros((n, 4), np.float32)
    if body > 0:
        top = boxes.copy()
        while True:
            up = np.where((top > 0) & (parents[np.maximum(top, 0)] > 0), parents[np.maximum(top, 0)], top)
            if (up == top).all():
                break
            top = up
        inside[:, 0] = top == body
        inside[:, 1] = (top == body) & (boxes != body)
        inside[:, 2] = top != body
    inside[:, 3] = body > 0
    return dense, cat, inside


class LineModel:
    """Logistic regression on dense features and hashed marks; ``markup`` says whether it also sees the boxes."""

    def __init__(self, markup: bool):
        self.markup = markup

    def fit(self, dense, cat, inside, y, epochs: int = 12, seed: int = 1) -> LineModel:
        if self.markup:
            dense = np.concatenate([dense, inside], axis=1)
        rng = np.random.default_rng(seed)
        w, c = np.zeros(dense.shape[1]), np.zeros(cat.shape[1] * HASHED)
        gw, gc = np.full_like(w, 1e-2), np.full_like(c, 1e-2)
        n, size = len(y), 2048
        for _ in range(epochs):
            order = rng.permutation(n)
            for s in range(0, n, size):
                at = order[s : s + size]
                x, k = dense[at], cat[at]
                p = 1 / (1 + np.exp(-np.clip(x @ w + c[k].sum(axis=1), -30, 30)))
                e = (p - y[at]) / len(at)
                g = x.T @ e + 1e-5 * w
                gw += g * g
                w -= 0.3 * g / np.sqrt(gw)
                u, inv = np.unique(k, return_inverse=True)
                g = np.bincount(inv.ravel(), weights=np.repeat(e, k.shape[1]), minlength=len(u)) + 1e-5 * c[u]
                gc[u] += g * g
                c[u] -= 0.3 * g / np.sqrt(gc[u])
        self.w, self.c = w.astype(np.float32), c.astype(np.float32)
        return self

    def price(self, dense, cat, inside) -> np.ndarray:
        """Log-odds of content."""
        if self.markup:
            dense = np.concatenate([dense, inside], axis=1)
        return np.clip(dense @ self.w + self.c[cat].sum(axis=1), -PRICE_CAP, PRICE_CAP)


def page_edges(boxes: np.ndarray, parents: np.ndarray, w_next=W_NEXT, w_cross=W_CROSS, w_box=W_BOX) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of nodes and edges of a page's graph: its lines, then the boxes that hold lines and those around them. Neighbouring
    lines are tied, each line to its box and each box to the box around it; the page itself (0) is no node."""
    n = len(boxes)
    hub: dict[int, int] = {}
    edges = [(i, i + 1, w_next if boxes[i] == boxes[i + 1] else w_cross) for i in range(n - 1)]
    for i, b in enumerate(boxes.tolist()):
        inner = None
        while b > 0:
            known = b in hub
            at = hub.setdefault(b, n + len(hub))
            edges.append((i if inner is None else inner, at, w_box))
            if known:
                break
            inner, b = at, int(parents[b])
    return n + len(hub), edges


def cut_page(price: np.ndarray, flags: np.ndarray, boxes: np.ndarray, parents: np.ndarray, w_next=W_NEXT, w_cross=W_CROSS, w_box=W_BOX) -> np.ndarray:
    """Content or not for each line: the minimum cut of the page's graph (``page_edges``); boxes have no price.

    A line whose price outweighs all its ties lies on its own side in every minimum cut, so it is settled beforehand and its
    ties become prices of the others.
    """
    n = len(price)
    if not n:
        return np.zeros(0, bool)
    total, edges = page_edges(boxes, parents, w_next, w_cross, w_box)
    value = np.concatenate([price, np.zeros(total - n)])
    ends = np.array([e[:2] for e in edges], int).reshape(-1, 2)
    ties = np.bincount(ends.ravel(), weights=np.repeat([e[2] for e in edges], 2), minlength=total)
    side, sure = value > 0, np.abs(value) > ties
    rest = np.flatnonzero(~sure)
    if len(rest):
        place = {int(v): k for k, v in enumerate(rest)}
        source, sink, inner = np.maximum(value[rest], 0).tolist(), np.maximum(-value[rest], 0).tolist(), []
        for a, b, w in edges:
            if a in place and b in place:
                inner.append((place[a], place[b], w))
            elif a in place or b in place:
                free, fixed = (a, b) if a in place else (b, a)
                (source if side[fixed] else sink)[place[free]] += w
        side[rest] = max_flow_cut(len(rest), source, sink, inner)
    return side[:n]


PARSED = "page_id bigint, site string, at string, no array<int>, h array<bigint>, len array<int>, flags array<int>, box array<int>, parents array<int>, body int"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Each page_id once (the latest fetch, ties by content), its visible lines as arrays; no text leaves this step."""
    prepare(pages.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for site, text in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                rows, parents, body = visible_lines(text, site)
                for k in range(5):
                    cols[k].append([r[k] for r in rows])
                cols[5].append(parents)
                cols[6].append(body)
            i32 = pa.list_(pa.int32())
            kinds = [i32, pa.list_(pa.int64()), i32, i32, i32, i32, pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["page_id", "site", "at", "no", "h", "len", "flags", "box", "parents", "body"],
            )

    src = pages.where(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("bigint").alias("page_id"),
        site_of(F.col("url"), F.col("file_path")).alias("site"),
        F.concat_ws("|", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.md5("content")).alias("at"),
        "content",
    )
    parsed = src.mapInArrow(parse, PARSED)
    cols = ["site", "no", "h", "len", "flags", "box", "parents", "body"]
    return parsed.groupBy("page_id").agg(F.max_by(F.struct(*cols), "at").alias("x")).select("page_id", *[f"x.{c}" for c in cols])


def with_counts(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``seen``: for every frequent line its place k, the share of all pages that show it and that of its site's
    pages that do; counts below FREQUENT are given as 1 and 0. Counted over all pages, partly before the shuffle."""
    lines = parsed.select("site", F.explode(F.array_distinct("h")).alias("h"))
    by_site = lines.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n"))
    sites = parsed.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    everything = parsed.agg(F.count(F.lit(1)).alias("all_pages"))
    total = by_site.groupBy("h").agg(F.sum("n").alias("pages")).where(F.col("pages") >= FREQUENT)
    freq = (
        by_site.join(total, "h")
        .join(sent(sites), "site")
        .join(F.broadcast(everything))
        .select("site", "h", (F.col("pages") / F.col("all_pages")).cast("float").alias("rate"), (F.col("n") / F.col("site_pages")).cast("float").alias("share"))
        .where((F.col("share") >= SITE_SHARE) | (F.col("rate") >= ALL_SHARE))
    )
    freq = stage(freq, "lines")
    shown = parsed.select("page_id", "site", F.posexplode("h").alias("k", "h"))
    if bytes_of(freq) <= BROADCAST_BYTES:
        met = shown.join(F.broadcast(freq), ["site", "h"])
    else:
        # A line may stand on every page of a site that holds a third of all pages.
        wide = freq.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = shown.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(wide, ["site", "h", "salt"])
    per = met.groupBy("page_id").agg(F.collect_list(F.struct("k", "rate", "share")).alias("seen"))
    return parsed.join(per, "page_id", "left")


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Numpy arrays of each page of a batch."""
    names = batch.schema.names
    col = {c: batch.column(names.index(c)) for c in names}

    def lists(c):
        off = col[c].offsets.to_numpy()
        flat = col[c].values.to_numpy(zero_copy_only=False)
        return lambda r: flat[off[r] : off[r + 1]]

    get = {c: lists(c) for c in ("no", "h", "len", "flags", "box", "parents")}
    seen = col["seen"]
    off = seen.offsets.to_numpy()
    k, rate, share = (seen.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    body = col["body"].to_numpy(zero_copy_only=False)
    valid = seen.is_valid().to_numpy(zero_copy_only=False)
    for r in range(batch.num_rows):
        n = len(get["h"](r))
        p, s = np.zeros(n), np.zeros(n)
        if valid[r]:
            at = k[off[r] : off[r + 1]]
            p[at], s[at] = rate[off[r] : off[r + 1]], share[off[r] : off[r + 1]]
        yield r, get["no"](r), get["h"](r), get["len"](r), get["flags"](r), get["box"](r), get["parents"](r), int(body[r]), p, s


def fit(counted: DataFrame, sample: int = TRAIN_PAGES) -> tuple[LineModel, LineModel] | None:
    """Line models with and without sight of the boxes, from at most ``sample`` pages whose heading lies in a box; None if
    there are none. The sample is of bounded size whatever the corpus; all else is computed from all pages."""
    rows = counted.where("body > 0").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).toArrow().combine_chunks()
    seen: list[tuple] = []
    bare: list[tuple] = []
    for batch in rows.to_batches():
        for r, _, h, length, flags, boxes, parents, body, rate, share in rows_of(batch):
            if not len(h):
                continue
            y = gold(boxes, body, flags, rate)
            seen.append((*features(h, length, flags, boxes, parents, body, rate, share), y))
            # The model without boxes also meets pages without a heading, and pages without a body.
            if r % 4 == 0:
                bare.append((*features(h, length, flags & ~TITLE, boxes, parents, -1, rate, share), y))
            elif r % 4 == 1 and (y == 0).any():
                k = y == 0
                bare.append((*features(h[k], length[k], flags[k] & ~TITLE, boxes[k], parents, -1, rate[k], share[k]), y[k]))
    if not seen:
        return None
    join = lambda parts: [np.concatenate([x[k] for x in parts]) for k in range(4)]
    return LineModel(True).fit(*join(seen)), LineModel(False).fit(*join(seen + bare))


def main_lines(pages: DataFrame, sample: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, line_no): the lines of each page's own article. Null, empty and blank pages, and pages of site text only,
    have none; repeated page_ids count once; without any page to learn from, lines are priced by frequency and length."""
    counted = stage(with_counts(stage(parsed_pages(pages), "parsed")), "counted")
    models = fit(counted, sample)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, nos = [], []
            held = [(r, x) for r, *x in rows_of(b) if len(x[0])]
            feats = [features(*x[1:]) for _, x in held]
            if not held:
                continue
            if models:
                D, C, I = (np.concatenate([f[k] for f in feats]) for k in range(3))
                boxed = I[:, 3] > 0
                price = np.empty(len(D))
                for m, at in ((models[0], boxed), (models[1], ~boxed)):
                    price[at] = m.price(D[at], C[at], I[at])
            else:
                D = np.concatenate([f[0] for f in feats])
                price = np.where(D[:, 3] > 0, -3.0, np.where(D[:, 5] > 0, 3.0, -0.2))
            at = 0
            for (r, (no, h, length, flags, boxes, parents, body, _, _)) in held:
                own = cut_page(price[at : at + len(h)], flags, boxes, parents)
                at += len(h)
                nos.append(no[own])
                rows.append(np.full(int(own.sum()), r))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(nos).astype(np.int32))], ["page_id", "line_no"])

    cols = ["page_id", "no", "h", "len", "flags", "box", "parents", "body", "seen"]
    return counted.select(*cols).mapInArrow(label, "page_id bigint, line_no int")


def main_bodies(pages: DataFrame, sample: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, body): the lines of ``main_lines`` of every page, in order and as they are written; pages without a body have ''.
    Repeated page_ids count once, in the fetch that was parsed."""
    at = F.concat_ws("|", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.md5("content"))
    text = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("bigint").alias("page_id"), at.alias("at"), "content").groupBy("page_id").agg(F.max_by("content", "at").alias("content"))
    lines = main_lines(pages, sample).groupBy("page_id").agg(F.collect_set("line_no").alias("nos"))
    kept = F.filter(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x, i: F.array_contains("nos", i + 1))
    return text.join(lines, "page_id", "left").select("page_id", F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("body"))

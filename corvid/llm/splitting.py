"""Splitting oversized items at natural boundaries.

Lengths are counted in units: characters by default, or the tokens of any ``unit`` pattern. The offsets of
the units are a sorted array (their prefix sums), natural boundaries are a sorted array per kind, and every
cut is found by binary search: the last boundary at or under the limit in the second half of the piece, best
kind first; else the last of any kind behind the piece before; a hard cut only where there is none. The next piece
starts up to ``overlap`` units earlier, at a boundary where there is one, and later if only so a boundary is in reach.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.session import prepare

LIMIT = 1024
OVERLAP = 100

# Kinds of natural boundary, best first. A cut falls behind the match.
KINDS = (
    re.compile(r"\n[ \t\r]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"')\]]*(?=\s)|[。！？]+[”’」』）]*"),
    re.compile(r"[,;:](?=\s)|[，；：、]"),
    re.compile(r"\s+"),
)
EDGE = r"(?U)^\s+|\s+$"


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, unit: re.Pattern | None = None) -> list[tuple[int, int]]:
    """Character ranges [start, end) of the pieces of ``text``, in order.

    Every piece is at most ``limit`` units long, no piece is empty, each starts at or before the end of the
    one before it (sharing at most ``overlap`` units), and together they cover the text. A text within the
    limit is one piece; an empty one has none.
    """
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("limit must be positive and overlap within [0, limit)")
    if unit is None:
        n, at, index = len(text), None, None
    else:
        at = [0] + [m.end() for m in unit.finditer(text)]
        if at[-1] != len(text):
            at.append(len(text))
        n = len(at) - 1
    pos = (lambda k: k) if at is None else at.__getitem__
    index = (lambda p: p) if at is None else (lambda p: bisect_right(at, p) - 1)
    if n == 0:
        return []
    if n <= limit:
        return [(0, len(text))]
    up = (lambda p: p) if at is None else (lambda p: bisect_left(at, p))
    bounds = [[m.end() for m in k.finditer(text)] for k in KINDS]
    if at is not None:
        # A boundary within a unit counts at its end: no unit is cut.
        bounds = [[at[bisect_left(at, p)] for p in b] for b in bounds]

    def begin(low: int, end: int) -> int:
        """Where a piece begins that may reach back to ``low`` from ``end``."""
        for b in bounds[2:]:
            k = bisect_left(b, low)
            if k < len(b) and b[k] <= end:
                return b[k]
        return low

    out, start, done, natural = [], 0, 0, True
    while True:
        if n - start <= limit:
            out.append((pos(start), pos(n)))
            return out
        hi = pos(start + limit)
        # A piece shorter than half the limit would come of a boundary too near; the next kind is tried then.
        lo = pos(start + max(limit // 2, overlap + 1))
        end = None
        for b in bounds:
            k = bisect_right(b, hi) - 1
            if k >= 0 and b[k] >= lo:
                end = b[k]
                break
        if end is None:
            # A short piece is still better than a cut within a word, and so is a smaller overlap.
            ends = [b[k] for b in bounds if (k := bisect_right(b, hi) - 1) >= 0 and b[k] > done]
            end = max(ends, default=hi)
            if not ends:
                ahead = min((b[k] for b in bounds if (k := bisect_right(b, done)) < len(b)), default=len(text) if natural else None)
                first = 0 if ahead is None else up(ahead) - limit
                if start < first <= index(done):
                    start = index(begin(pos(first), done))
                    continue
            natural = bool(ends)
        else:
            natural = True
        out.append((pos(start), end))
        done = end
        back = index(end) - overlap
        start = index(begin(pos(max(back, start + 1)), end) if overlap else end)


def pieces(df: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, unit: str | None = None) -> DataFrame:
    """(id, chunk_index, start, content): every oversized item cut into pieces within ``limit`` characters, or within so many tokens
    where ``unit`` is their pattern (whatever lies behind a token belongs to it or to the next).

    An item is oversized if its text without white space at both ends is longer than ``limit``; offsets
    count the characters of that stripped text. Items within the limit, null, empty and blank ones give no rows, repeated
    ids count once (the smallest text of differing ones), null ids are dropped, other columns are ignored.
    The length test runs in the JVM; only texts longer than ``limit`` characters reach Python.
    """
    prepare(df.sparkSession)
    big = (
        df.select(F.col(id_col).alias("id"), F.regexp_replace(text_col, EDGE, "").alias("content"))
        .where(F.col("id").isNotNull() & (F.length("content") > limit))
        .groupBy("id")
        .agg(F.min("content").alias("content"))
    )

    token = re.compile(unit) if unit else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, starts, parts = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts_of = cuts(text, limit, overlap, token)
                for k, (a, b) in enumerate(parts_of if len(parts_of) > 1 else ()):
                    ids.append(i)
                    index.append(k)
                    starts.append(a)
                    parts.append(text[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(starts, pa.int32()), pa.array(parts, pa.string())],
                ["id", "chunk_index", "start", "content"],
            )

    kind = dict(big.dtypes)["id"]
    return big.mapInArrow(cut, f"id {kind}, chunk_index int, start int, content string")

"""Cutting documents into chunks. Each operator takes a table with a key and a text and returns
(key, chunk_index, content) plus ``doc_id`` ('path#index') where a path column is given."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import EDGES, strip
from corvid.session import prepare

SIZE, OVERLAP, MIN_LENGTH = 1024, 100, 10
# Separators in order of preference.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", " "]
RECURSIVE_SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", ""]
#: From this length on a document that packs into far more chunks than windows is cut into windows.
ADAPTIVE_CHARS, ADAPTIVE_RATIO = 50_000, 1.25


def check(size: int, overlap: int) -> None:
    """Raise ValueError unless size > 0 and 0 <= overlap < size."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunking needs size > 0 and 0 <= overlap < size")


def window_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, min_length: int = MIN_LENGTH) -> DataFrame:
    """Fixed windows: text[i : i+size] every size-overlap characters. Pieces shorter than ``min_length``
    stripped are dropped; chunk_index counts the kept ones. Blank and null texts give no rows. Narrow: no shuffle."""
    check(size, overlap)
    step = max(1, size - overlap) if overlap else size
    t = F.col(text)
    starts = F.when(t.rlike(r"(?U)\S"), F.sequence(F.lit(0), F.length(t) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    parts = F.filter(F.transform(starts, lambda i: strip(t.substr(i + 1, F.lit(size)))), lambda p: F.length(p) >= min_length)
    return df.select(F.col(key), F.posexplode(parts).alias("chunk_index", "content"))


def legacy_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The older cut of one-paragraph texts: the first ``size`` characters and, from that length on, a last piece of
    the trailing ``overlap`` characters. Blank and null texts give no rows."""
    check(size, overlap)
    t = F.col(text)
    tail = strip(F.when(F.length(t) > overlap, F.substr(t, F.length(t) - overlap + 1)).otherwise(t))
    whole = F.array(t)
    cut = F.array(F.substring(t, 1, size), tail) if overlap else F.array(F.substring(t, 1, size))
    parts = F.when(t.rlike(r"(?U)\S"), F.when(F.length(t) >= size, cut).otherwise(whole)).otherwise(F.array().cast("array<string>"))
    return df.select(F.col(key), F.posexplode(parts).alias("chunk_index", "content"))


def pack(parts: list[str], joiner: str, size: int) -> list[str]:
    """Greedy packing: as many consecutive parts in one piece as fit within ``size``; a part may itself be longer."""
    out, held = [], ""
    for p in parts:
        grown = held + joiner + p if held else p
        if held and len(grown) > size:
            out.append(held)
            held = p
        else:
            held = grown
    return [*out, held] if held else out


def hard_windows(text: str, size: int, overlap: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]


def split_paragraph(para: str, size: int, overlap: int, compat: bool = False) -> list[str]:
    """A paragraph over the limit: packed by the first separator it has. If it is eight sizes long and the pieces
    average under three quarters of a size, hard windows instead; ``compat`` keeps the small pieces before them."""
    for sep in SEPARATORS:
        if sep not in para:
            continue
        packed = pack([s for s in map(str.strip, para.split(sep)) if s], sep, size)
        if not packed:
            continue
        if len(para) >= 8 * size and sum(map(len, packed)) / len(packed) < 0.75 * size:
            return (packed if compat else []) + hard_windows(para, size, overlap)
        return packed
    return hard_windows(para, size, overlap)


def paragraphs_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, min_length: int = MIN_LENGTH, compat: bool = False) -> list[str]:
    """Paragraph packing of one text: paragraphs join until the size is reached, and a flushed chunk lends its last
    ``overlap`` characters to the next. Paragraphs over the size are split on their own, without overlap."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> str:
        whole = "\n\n".join(held)
        if held:
            out.append(whole)
        held.clear()
        return whole

    for para in filter(None, map(str.strip, (text or "").split("\n\n"))):
        if len(para) > size:
            flush()
            out.extend(split_paragraph(para, size, overlap, compat))
            continue
        if held and len("\n\n".join(held)) + 2 + len(para) > size:
            whole = flush()
            if overlap:
                held.append(whole[-overlap:])
        held.append(para)
    flush()
    return [c for c in map(str.strip, out) if len(c) >= min_length]


def windows_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, min_length: int = MIN_LENGTH) -> list[str]:
    if not text or not text.strip():
        return []
    step = max(1, size - overlap) if overlap else size
    cut = (text[i : i + size].strip() for i in range(0, len(text), step))
    return [c for c in cut if len(c) >= min_length]


def adaptive_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, min_length: int = MIN_LENGTH) -> list[str]:
    """Paragraph packing, or windows for a long text that packs into far more chunks than windows."""
    packed = paragraphs_of(text, size, overlap, min_length)
    if text and len(text) >= ADAPTIVE_CHARS:
        step = max(1, size - overlap)
        if len(packed) > ADAPTIVE_RATIO * -(-len(text) // step):
            return windows_of(text, size, overlap, min_length)
    return packed


def recursive_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = RECURSIVE_SEPARATORS) -> list[str]:
    """Recursive splitting: by the first separator present (kept at the head of the part behind it), parts over the
    size by the next ones, and neighbouring parts merged up to the size with up to ``overlap`` characters repeated."""
    if not text:
        return []
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[k], separators[k + 1 :]
    if sep:
        cut = text.split(sep)
        parts = [p for p in [cut[0], *(sep + x for x in cut[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    small: list[str] = []

    def merge() -> None:
        held: list[str] = []
        n = 0
        for p in small:
            if held and n + len(p) > size:
                out.append("".join(held).strip())
                while held and (n > overlap or n + len(p) > size):
                    n -= len(held.pop(0))
            held.append(p)
            n += len(p)
        if held:
            out.append("".join(held).strip())
        small.clear()

    for p in parts:
        if len(p) < size:
            small.append(p)
            continue
        merge()
        out.extend(recursive_of(p, size, overlap, rest) if rest else [p])
    merge()
    return [c for c in out if c]


SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?]+(?=\s|$)|[。！？]|\n|$|[.!?])")
UNIT = re.compile(r"[一-鿿]|\w+|[^\w\s]")


def sentences_of(text: str | None, size: int = 512, overlap: int = 20) -> list[str]:
    """Sentences packed by token count (words, Chinese characters and signs count one each), whole sentences of up
    to ``overlap`` tokens repeated; a sentence over the size stands alone."""
    parts = [(s.strip(), len(UNIT.findall(s))) for s in SENTENCE.findall(text or "") if s.strip()]
    out, held, n = [], [], 0
    for s, k in parts:
        if held and n + k > size:
            out.append(" ".join(x for x, _ in held))
            back, room = [], overlap
            for x in reversed(held):
                if x[1] > room:
                    break
                back.insert(0, x)
                room -= x[1]
            held, n = back, sum(x[1] for x in back)
            if n + k > size:
                held, n = [], 0
        held.append((s, k))
        n += k
    if held:
        out.append(" ".join(x for x, _ in held))
    return out


def chunk_with(df: DataFrame, key: str, text: str, cut: Callable[[str | None], list[str]]) -> DataFrame:
    """(key, chunk_index, content) by a Python function of one text, in Arrow batches; for cuts that need
    sequential state. Null and blank texts give no rows; other columns are ignored."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, parts = [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                for i, c in enumerate(cut(t)):
                    rows.append(row)
                    index.append(i)
                    parts.append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(parts, pa.string())],
                [key, "chunk_index", "content"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, chunk_index int, content string")


def paragraph_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, min_length: int = MIN_LENGTH, compat: bool = False) -> DataFrame:
    check(size, overlap)
    return chunk_with(df, key, text, lambda t: paragraphs_of(t, size, overlap, min_length, compat))


def adaptive_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, min_length: int = MIN_LENGTH) -> DataFrame:
    check(size, overlap)
    return chunk_with(df, key, text, lambda t: adaptive_of(t, size, overlap, min_length))


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    check(size, overlap)
    return chunk_with(df, key, text, lambda t: recursive_of(t, size, overlap))


def sentence_chunks(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 20) -> DataFrame:
    check(size, overlap)
    return chunk_with(df, key, text, lambda t: sentences_of(t, size, overlap))


def with_ids(chunks: DataFrame, path: str) -> DataFrame:
    """Chunk records: doc_id 'path#index' and a chunk_id derived from it (the same on every run)."""
    doc_id = F.concat_ws("#", F.coalesce(F.col(path).cast("string"), F.lit("")), F.col("chunk_index").cast("string"))
    return chunks.withColumn("doc_id", doc_id).withColumn("chunk_id", F.sha2("doc_id", 256))


def size_stats(df: DataFrame, text: str) -> DataFrame:
    """One row: number of texts, total, mean (two places) and greatest length; null counts as 0. Zeros and null mean for an empty table."""
    n = F.coalesce(F.length(text), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_chars"),
        F.round(F.avg(n), 2).alias("avg_chars"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_chars"),
    )


def largest(df: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """The ``k`` longest texts (ties by key)."""
    return df.select(key, F.length(text).alias("n_chars")).where("n_chars IS NOT NULL").orderBy(F.desc("n_chars"), key).limit(k)


def most_chunked(chunks: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The ``k`` documents with the most chunks (ties by key)."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks")).orderBy(F.desc("n_chunks"), key).limit(k)


def valid_chunks(df: DataFrame, text: str, min_length: int = MIN_LENGTH) -> DataFrame:
    return df.where(F.length(F.regexp_replace(text, EDGES, "")) >= min_length)



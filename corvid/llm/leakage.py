"""Evaluation texts leaking into training text: multi-pattern search by Wu and Manber over words.

Patterns are all windows of ``run`` consecutive words of every test item. Blocks are pairs of words. A
shift table, indexed by a hash of the block, says how far the search may jump; where it says zero, the
suffix block and the prefix block choose the windows that are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from corvid.session import prepare

RUN = 12
#: Test items are compiled in groups of at most this many characters, so a broadcast stays under some 100 MB.
GROUP_CHARS = 4_000_000
#: Groups that one scan of the documents searches for.
GROUPS = 4
HASH_BITS = 20
# Fixed value: a word is a run of letters and digits, or one Chinese character.
WORDS = r"[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+|[\x{4E00}-\x{9FFF}]"


def words(c):
    """Array of the words of ``c``, in lower case; null for null."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORDS), F.lit(0)), F.lower)


class Patterns:
    """Shift table and buckets over the windows of some test items, given as (item id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.run = run
        self.vocab: dict[str, int] = {}
        self.buckets: dict[int, dict[int, dict[tuple, list[int]]]] = defaultdict(dict)
        shift = np.full(1 << HASH_BITS, run - 1, np.uint8 if run < 256 else np.int32)
        for item, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
            for s in range(len(ids) - run + 1):
                win = tuple(ids[s : s + run])
                owners = self.buckets[self.block(win[-2], win[-1])].setdefault(self.block(win[0], win[1]), {}).setdefault(win, [])
                if item not in owners:
                    owners.append(item)
                for j in range(1, run):
                    h = self.hashed(self.block(win[j - 1], win[j]))
                    shift[h] = min(shift[h], run - 1 - j)
        self.shift = shift

    @staticmethod
    def block(a, b):
        return a << 32 | b

    @staticmethod
    def hashed(block):
        return (block * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - HASH_BITS

    def jumps(self, ids: np.ndarray) -> np.ndarray:
        """The shift at every word, by the block it ends."""
        x = ids.astype(np.uint64)
        block = x[:-1] << np.uint64(32) | x[1:]
        h = (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)
        out = np.full(len(ids), self.run - 1, self.shift.dtype)
        out[1:] = self.shift[h]
        return out

    def search(self, ids: list[int], jumps: list[int]) -> set[int]:
        """Items of which a window stands in the words ``ids``."""
        found: set[int] = set()
        run, pos, n = self.run, self.run - 1, len(ids)
        while pos < n:
            if jump := jumps[pos]:
                pos += jump
                continue
            bucket = self.buckets.get(ids[pos - 1] << 32 | ids[pos])
            if bucket:
                first = pos - run + 1
                wins = bucket.get(ids[first] << 32 | ids[first + 1])
                if wins:
                    found.update(wins.get(tuple(ids[first : pos + 1]), ()))
            pos += 1
        return found


def groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Test items with their words, in groups of bounded size; the driver holds the groups of one scan at a time."""
    rows, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), words(F.col(text_col)).alias("w")).where("i IS NOT NULL AND w IS NOT NULL").toLocalIterator():
        rows.append((r["i"], r["w"]))
        size += sum(map(len, r["w"]))
        if size >= GROUP_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def compiled(group: list[tuple[int, list[str]]], run: int, least: int | None) -> list[Patterns]:
    """The patterns of a group: windows of ``run`` words, and items of ``least`` to ``run`` - 1 words as a whole, length by length."""
    out = [Patterns([x for x in group if len(x[1]) >= run], run)]
    for n in range(max(2, least), run) if least else ():
        short = [x for x in group if len(x[1]) == n]
        if short:
            out.append(Patterns(short, n))
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", run: int = RUN, least: int | None = None) -> DataFrame:
    """(doc_id, item_id): every document that holds ``run`` consecutive words of an item's text, with that item.

    Documents are scanned whole, once per GROUPS groups of items, without a shuffle. Null and empty texts match
    nothing. Items shorter than ``run`` words cannot leak, unless ``least`` (two or more) is given: then those of at least so
    many words leak where they stand as a whole. Copies of a text each give their rows, repeated (doc, item) pairs of
    repeated ids are dropped. Other columns are ignored, ids may be of any type.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = StructType([StructField("doc_id", docs.schema[doc_col].dataType), StructField("item_id", items.schema[item_col].dataType)])
    kind = to_arrow_type(schema["item_id"].dataType)
    shortest = min(run, max(2, least)) if least else run
    text = docs.select(F.col(doc_col).alias("doc_id"), words(F.col(text_col)).alias("w")).where(F.size("w") >= shortest)
    out = None
    waiting = groups(items, item_col, item_text_col)
    while held := list(islice(waiting, GROUPS)):
        shared = [spark.sparkContext.broadcast(compiled(g, run, least)) for g in held]

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = [p for s in shared for p in s.value]
            for batch in batches:
                lists = batch.column(1)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
                offsets = offsets - offsets[0]
                if not len(coded):
                    continue
                distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                at, hits = [], []
                for pats in patterns:
                    known = np.fromiter((pats.vocab.get(w, 0) for w in distinct), np.int64, len(distinct))
                    ids = known[place]
                    jumps = pats.jumps(ids).tolist()
                    ids = ids.tolist()
                    for row in range(batch.num_rows):
                        a, b = offsets[row], offsets[row + 1]
                        if b - a >= pats.run and (found := pats.search(ids[a:b], jumps[a:b])):
                            at.extend([row] * len(found))
                            hits.extend(found)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(hits, kind)], ["doc_id", "item_id"])

        part = text.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out.distinct()

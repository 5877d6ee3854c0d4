"""Code blocks: detection of their language, extraction behind placeholders, and restoration by a join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corvid.functions import html as H
from corvid.functions.text import clean_metadata, clean_text_flat, col, valid_text
from corvid.session import prepare

MIN_CODE = 500
# Language families in order, first hit wins; matched at line starts, without regard to case.
LANGUAGES = {
    "bash": [r"#!/bin/bash", r"#!/usr/bin/env bash", r"^\$ ", r"^# "],
    "python": [r"^import ", r"^from ", r"^def ", r"^class ", r"^if __name__"],
    "javascript": [r"function\s+\w+", r"const\s+\w+", r"let\s+\w+", r"var\s+\w+"],
    "yaml": [r"^\s*[a-zA-Z_][a-zA-Z0-9_]*:\s*", r"^\s*-\s*"],
    "json": [r"^\s*[\{\[]", r'^\s*"[^"]*"\s*:'],
    "dockerfile": [r"^FROM\s+", r"^RUN\s+", r"^COPY\s+", r"^WORKDIR\s+"],
    "go": [r"^package\s+\w+", r"^import\s+", r"^func\s+\w+"],
    "shell": [r"^\$", r"^#", r"^echo\s+", r"^ls\s+", r"^cd\s+"],
}
# What the longer, older list adds, and its order.
MORE_LANGUAGES = {
    "sql": [r"^SELECT\s+", r"^INSERT\s+", r"^UPDATE\s+", r"^DELETE\s+"],
    "rust": [r"^use\s+", r"^fn\s+\w+", r"^struct\s+\w+"],
    "java": [r"^public\s+class\s+", r"^import\s+", r"^package\s+"],
    "cpp": [r"^#include\s+<", r"^using\s+namespace", r"^int\s+main"],
    "c": [r"^#include\s+<", r"^int\s+main", r"^void\s+\w+"],
    "html": [r"^<[a-zA-Z]", r"^<!DOCTYPE", r"^<html"],
    "css": [r"^\s*[.#]?\w+\s*\{", r"^\s*@\w+"],
    "xml": [r"^<\?xml", r"^<[a-zA-Z][^>]*>"],
    "markdown": [r"^#\s+", r"^##\s+", r"^\*\s+", r"^-\s+"],
    "powershell": [r"^\$", r"^Get-", r"^Set-", r"^New-"],
}
LONG_ORDER = [
    "bash", "python", "javascript", "yaml", "json", "dockerfile", "sql", "go", "rust", "java", "cpp", "c",
    "html", "css", "xml", "markdown", "powershell", "shell",
]
PLACEHOLDER = r"\[CODE_BLOCK:\s*([^\]]+)\]"


def class_language(c: Column) -> Column:
    """The language of a class list that has language-x or lang-x; null without one."""
    hit = F.filter(F.split(c, r"\s+"), lambda x: x.startswith("language-") | x.startswith("lang-"))
    return F.regexp_extract(F.get(hit, F.lit(0)), "^[^-]*-(.*)$", 1)


def detect_language(code: str | Column, cls: Column | None = None, parent_cls: Column | None = None, long_list: bool = False) -> Column:
    """The class of the tag, then of its parent, then the first family with a hit, else 'text'. Null code is 'text'."""
    families = LANGUAGES | MORE_LANGUAGES
    order = LONG_ORDER if long_list else list(LANGUAGES)
    guess = F.lit("text")
    for name in reversed(order):
        guess = F.when(col(code).rlike("(?imd)(?:" + "|".join(families[name]) + ")"), name).otherwise(guess)
    from_class = [class_language(c) for c in (cls, parent_cls) if c is not None]
    return F.coalesce(*from_class, guess)


def code_id(doc: str, index: int) -> str:
    """Id of the index-th code tag of a document: the same on every run."""
    return "code_block_" + hashlib.sha256(f"{doc}|{index}".encode()).hexdigest()[:8]


def extract(html: str | None, doc: str, min_code: int = MIN_CODE):
    """(parsed page with placeholders, [(code_id, index, length, class, parent class, code)]): every code element whose
    stripped text is longer than ``min_code`` gives way to a placeholder; the index counts all code elements."""
    root = H.parse(html)
    out = []
    for i, n in enumerate([n for n in root.walk() if n.tag == "code"]):
        code = H.text_of(n).strip()
        if len(code) > min_code:
            cid = code_id(doc, i)
            out.append((cid, i, len(code), n.attrs.get("class", ""), n.parent.attrs.get("class", "") if n.parent else "", code))
            n.children = [H.Node(None, text=f"[CODE_BLOCK:{cid}]", parent=n)]
    return root, out


def _blocks(ids: list, pages: list, min_code: int) -> Iterator[tuple]:
    for row, (i, page) in enumerate(zip(ids, pages)):
        for block in extract(page, str(i), min_code)[1]:
            yield (row, *block)


def code_blocks(df: DataFrame, key: str, html: str, min_code: int = MIN_CODE) -> DataFrame:
    """(key, code_id, idx, length, language, code) of every extracted block; nothing for null or blank pages."""
    prepare(df.sparkSession)
    names = ["code_id", "idx", "length", "cls", "parent_cls", "code"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = list(_blocks(b.column(0).to_pylist(), b.column(1).to_pylist(), min_code))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], types)]], [key, *names])

    raw = df.select(key, html).where(F.lower(html).contains("<code")).mapInArrow(
        run, f"`{key}` {dict(df.dtypes)[key]}, code_id string, idx int, length int, cls string, parent_cls string, code string"
    )
    lang = detect_language("code", F.nullif(F.col("cls"), F.lit("")), F.nullif(F.col("parent_cls"), F.lit("")))
    return raw.select(key, "code_id", "idx", "length", lang.alias("language"), "code")


def html_pages(df: DataFrame, key: str, html: str, selector: str | None = None, skip_missing: bool = True, min_code: int = MIN_CODE, legacy: bool = False, keep: bool = False, when: str | None = None) -> DataFrame:
    """(key, content, n_codes): page text with long code behind placeholders.

    With a selector only its first region counts; where it is missing the content is empty (``skip_missing``) or the
    whole page. The row stays in any case, code is extracted before the region is chosen. ``legacy`` gives plain text
    lines without placeholders instead of markdown. Null pages give ''. With ``keep`` the other columns go along and the text
    takes the place of the page; rows whose boolean column ``when`` is not true keep their text as it is."""
    prepare(df.sparkSession)

    def one(i, page):
        root, blocks = (H.parse(page), []) if legacy else extract(page, str(i), min_code)
        region = H.select(root, selector) if selector else root
        if region is None:
            if skip_missing:
                return "", len(blocks)
            region = root
        H.drop(region, H.HIDDEN if legacy else H.HIDDEN | {"nav", "footer", "header", "aside"})
        return (H.text_of(region, "\n") if legacy else H.markdown_of(region)), len(blocks)

    others = [c for c in df.columns if c not in (key, html, "content", "n_codes", when)] if keep else []
    src = df.select(F.col(key), F.col(html).alias("content"), F.coalesce(when, F.lit(False)).alias("_when") if when else F.lit(True).alias("_when"), *others)
    out = StructType([*[f for f in src.schema if f.name != "_when"], StructField("n_codes", IntegerType())])

    def run(batches):
        for b in batches:
            got = [one(i, p) if w else (p, 0) for i, p, w in zip(*(b.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), *b.columns[3:], pa.array([g[1] for g in got], pa.int32())], out.names)

    full = src.mapInArrow(run, out)
    return full if keep else full.select(key, "content", "n_codes")


def code_positions(df: DataFrame, key: str, html: str, preview: int = 50) -> DataFrame:
    """(key, idx, parent, n_siblings, language, preview): where each code element stands: its parent's tag, the number of the parent's
    other elements, and the first characters of its text with '...' where cut."""
    prepare(df.sparkSession)

    def one(page):
        for i, n in enumerate([n for n in H.parse(page).walk() if n.tag == "code"]):
            code = H.text_of(n).strip()
            yield i, n.parent.tag or "", sum(c.tag is not None for c in n.parent.children) - 1, n.attrs.get("class", ""), n.parent.attrs.get("class", ""), code

    types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = [(row, *x) for row, page in enumerate(b.column(1).to_pylist()) for x in one(page)]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], types)]], [key, "idx", "parent", "n_siblings", "cls", "parent_cls", "code"])

    raw = df.select(key, html).where(F.lower(html).contains("<code")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, idx int, parent string, n_siblings int, cls string, parent_cls string, code string")
    lang = detect_language("code", F.nullif(F.col("cls"), F.lit("")), F.nullif(F.col("parent_cls"), F.lit("")), long_list=True)
    cut = F.when(F.length("code") > preview, F.concat(F.substring("code", 1, preview), F.lit("..."))).otherwise(F.col("code"))
    return raw.select(key, "idx", "parent", "n_siblings", lang.alias("language"), cut.alias("preview"))


def placeholders(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code_id): the distinct blocks a chunk refers to."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)))).alias("code_id")).select(key, F.trim("code_id").alias("code_id"))


def associate(chunks: DataFrame, key: str, text: str, blocks: DataFrame) -> DataFrame:
    """(key, code_ids): the known blocks each chunk refers to, sorted; chunks without any fall out."""
    return placeholders(chunks, key, text).join(blocks.select("code_id").distinct(), "code_id").groupBy(key).agg(F.array_sort(F.collect_set("code_id")).alias("code_ids"))


def restore(chunks: DataFrame, key: str, text: str, blocks: DataFrame) -> DataFrame:
    """(key, text): placeholders replaced by the fenced code; unknown ids keep their placeholder, null text stays null."""
    codes = (
        placeholders(chunks, key, text)
        .join(blocks.groupBy("code_id").agg(F.min("code").alias("code")), "code_id")
        .groupBy(key)
        .agg(F.collect_list(F.struct("code_id", "code")).alias("codes"))
    )
    fence = lambda x: F.concat(F.lit("\n```"), x["code"], F.lit("\n```\n"))
    full = F.aggregate(
        F.coalesce("codes", F.array().cast("array<struct<code_id:string,code:string>>")),
        F.col(text),
        lambda t, x: F.replace(F.replace(t, F.concat(F.lit("[CODE_BLOCK:"), x["code_id"], F.lit("]")), fence(x)), F.concat(F.lit("[CODE_BLOCK: "), x["code_id"], F.lit("]")), fence(x)),
    )
    return chunks.select(key, text).join(codes, key, "left").select(key, full.alias(text))


def clean_nodes(nodes: DataFrame, key: str, text: str, metadata: str, blocks: DataFrame) -> DataFrame:
    """(key, text, metadata, code_ids): the older cleaning of nodes: text flat, metadata (a string map) with clean keys and values,
    the known blocks the text refers to ([] without any); nodes whose clean text is not valid fall out."""
    clean = nodes.select(key, clean_text_flat(text).alias(text), clean_metadata(metadata).alias(metadata)).where(valid_text(text))
    none = F.array().cast("array<string>")
    return clean.join(associate(clean, key, text, blocks), key, "left").withColumn("code_ids", F.coalesce("code_ids", none))

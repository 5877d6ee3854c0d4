"""Pipelines of named DataFrame steps, their registry, and the ingest plan read -> clean -> chunk -> embed -> store."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.text import clean_text
from corvid.operators import chunking, code, vectors
from corvid.session import stage
from corvid.sources import files, sinks

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Settings:
    """Ingest settings; ``check`` raises ValueError for inconsistent ones."""

    root: str = ""
    backend: str = "vector"
    target: str = ""
    chunk_size: int = chunking.SIZE
    chunk_overlap: int = chunking.OVERLAP
    min_chunk: int = chunking.MIN_LENGTH
    selector: str | None = "div.td-content"
    skip_missing: bool = True
    dim: int | None = 64
    batch: int = 32
    model: str = "small"
    overwrite: bool = True
    dry_run: bool = False

    def check(self) -> Settings:
        chunking.check(self.chunk_size, self.chunk_overlap)
        if self.backend not in sinks.BACKENDS:
            raise ValueError(f"unknown backend: {self.backend}")
        if self.batch < 1 or self.dim is not None and self.dim < 1:
            raise ValueError("batch and dim must be positive")
        return self

    def encoder(self) -> Callable:
        dim = self.inferred().dim
        return lambda: vectors.HashingEncoder(dim)

    def inferred(self, probe: Callable | None = None) -> Settings:
        """With ``dim`` filled in where it is None: the width of a probe text's vector, else the model's listed one, else 512."""
        if self.dim is not None:
            return self
        try:
            dim = len(probe().encode(["probe"])[0]) if probe else vectors.MODEL_DIMS[self.model]
        except Exception:  # noqa: BLE001
            dim = 512
        return self.merged(dim=dim)

    def merged(self, **changes) -> Settings:
        unknown = set(changes) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return Settings(**(self.__dict__ | changes)).check()


class Pipeline:
    """An ordered list of named steps that can be inserted, removed, switched off and described. Applying it builds one plan; an
    ``eager`` one runs step by step, each written, so that the log's seconds and rows are those of the step itself."""

    def __init__(self, name: str = "pipeline", eager: bool = False):
        self.name, self.eager = name, eager
        self.steps: list[list] = []
        self.log: list[dict] = []

    def add(self, name: str, step: Step, at: int | None = None) -> Pipeline:
        if any(s[0] == name for s in self.steps):
            raise ValueError(f"step {name} is there already")
        self.steps.insert(len(self.steps) if at is None else at, [name, step, True])
        return self

    def _find(self, name: str) -> list:
        for s in self.steps:
            if s[0] == name:
                return s
        raise KeyError(name)

    def remove(self, name: str) -> Pipeline:
        self.steps.remove(self._find(name))
        return self

    def enable(self, name: str, on: bool = True) -> Pipeline:
        self._find(name)[2] = on
        return self

    def info(self) -> list[dict]:
        return [{"position": i, "name": n, "enabled": on} for i, (n, _, on) in enumerate(self.steps)]

    def __call__(self, df: DataFrame) -> DataFrame:
        self.log = []
        for name, step, on in self.steps:
            if not on:
                continue
            began = time.time()
            try:
                df = df.transform(step)
                done = {"name": name, "status": "success"}
                if self.eager:
                    df = stage(df, name)
                    done["rows"] = df.count()
                self.log.append(done | {"seconds": time.time() - began})
            except Exception as e:
                self.log.append({"name": name, "status": "failed", "error": str(e), "seconds": time.time() - began})
                raise
        return df


def clean_html_step(s: Settings) -> Step:
    """HTML rows become text of the selected region, other rows only cleaned; all columns go along in one pass."""

    def run(df: DataFrame) -> DataFrame:
        is_html = F.lower(F.coalesce("file_type", F.lit(""))).isin(".html", ".htm", "html", "htm")
        rows = code.html_pages(df.withColumn("_html", is_html), "relative_path", "content", s.selector, s.skip_missing, keep=True, when="_html")
        return rows.drop("n_codes").withColumn("content", clean_text("content"))

    return run


def chunk_step(s: Settings) -> Step:
    def run(df: DataFrame) -> DataFrame:
        c = chunking.adaptive_chunks(df, "relative_path", "content", s.chunk_size, s.chunk_overlap, s.min_chunk)
        return chunking.with_ids(c, "relative_path")

    return run


def embed_step(s: Settings) -> Step:
    def run(df: DataFrame) -> DataFrame:
        return vectors.embed(df, "doc_id", "content", s.encoder(), s.batch, keep=True)

    return run


REGISTRY: dict[str, Callable[[Settings], Pipeline]] = {
    "vector": lambda s: Pipeline("vector").add("html", clean_html_step(s)).add("chunk", chunk_step(s)).add("embed", embed_step(s)),
    "text": lambda s: Pipeline("text").add("html", clean_html_step(s)).add("chunk", chunk_step(s)),
}


def register(name: str, build: Callable[[Settings], Pipeline]) -> None:
    REGISTRY[name] = build


@dataclass
class IngestResult:
    success: bool
    documents: int
    chunks: int
    stored: int
    errors: list[str] = field(default_factory=list)


def ingest(spark: SparkSession, settings: Settings, documents: DataFrame | None = None) -> IngestResult:
    """Run the ingest of the settings' backend; a dry run does everything but store. The pipeline runs once: its chunks are
    staged, counted and stored from there; paths name one document each (``files.unique_paths`` makes them so)."""
    s = settings.check()
    docs = documents if documents is not None else files.read_documents(spark, s.root)
    backend = sinks.create_backend(s.backend, spark, s.target, overwrite=s.overwrite)
    chunks = stage(REGISTRY[s.backend](s)(docs), "ingest")
    rows = sinks.prepared(chunks, docs, backend.requires_embedding)
    n_docs, n_chunks = docs.select("relative_path").count(), rows.count()
    if s.dry_run:
        return IngestResult(True, n_docs, n_chunks, 0)
    r = backend.store(rows, staged=True)
    return IngestResult(r.success, n_docs, n_chunks, r.stored_count, r.errors)


def main(argv: list[str] | None = None) -> int:
    """``python -m corvid.plans.pipeline ROOT TARGET``: ingest a folder; 0 if all was stored."""
    import argparse

    from corvid.session import local_session

    p = argparse.ArgumentParser(description="Ingest a folder of documents.")
    p.add_argument("root")
    p.add_argument("target")
    p.add_argument("--backend", choices=sorted(sinks.BACKENDS), default="vector")
    p.add_argument("--selector", default=None)
    p.add_argument("--chunk-size", type=int, default=chunking.SIZE)
    p.add_argument("--chunk-overlap", type=int, default=chunking.OVERLAP)
    p.add_argument("--append", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    s = Settings(root=a.root, target=a.target, backend=a.backend, selector=a.selector, chunk_size=a.chunk_size, chunk_overlap=a.chunk_overlap, overwrite=not a.append, dry_run=a.dry_run)
    r = ingest(SparkSession.getActiveSession() or local_session(), s)
    print(f"{r.documents} documents, {r.chunks} chunks, {r.stored} stored", *r.errors, sep="\n")
    return 0 if r.success else 1


if __name__ == "__main__":
    raise SystemExit(main())

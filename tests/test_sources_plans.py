import os

import pytest

from corvid.plans import pipeline as P
from corvid.sources import crawl, files, sinks
from corvid.streaming import state


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a/one.html": "<main>One text that is long enough</main>", "a/_print/index.html": "print", "b.md": "# md text here", ".hidden/x.md": "no", "c.txt": "", "x/_index.md": "index", "d.HTML": "<p>upper</p>", "e.pdf": "x"}.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(tmp_path)


def test_read(spark, folder):
    names = lambda df: sorted(r["relative_path"] for r in df.collect())
    assert names(files.read_documents(spark, folder)) == ["a/one.html", "b.md", "c.txt", "x/_index.md"]
    assert names(files.read_legacy(spark, folder)) == ["a/one.html", "d.HTML"]
    assert names(files.uploads(spark, folder)) == ["a/_print/index.html", "a/one.html", "b.md", "c.txt", "d.HTML", "e.pdf", "x/_index.md"]
    assert "a/_print/index.html" not in names(files.read_for_markdown(spark, folder))
    one = files.read_one(spark, os.path.join(folder, "b.md")).first()
    assert (one["file_name"], one["file_type"], one["file_size"]) == ("b.md", ".md", 14)


def test_tree(spark, rows):
    df = spark.createDataFrame([("a/b.html",), ("a/_x/c.html",), ("d/e.md",), (None,), ("",)], "p string")
    t = files.tree(df, "p")
    assert rows(t.select("path", "is_file")) == [("a", False), ("a/b.html", True), ("d", False)]
    assert rows(files.search_tree(t, "B.H").select("path")) == [("a",), ("a/b.html",)]


def test_crawl(spark, rows):
    page = '<a href="/x">1</a><A class=q HREF="https://s.test/y">2</A><a href="rel">3</a><a href="/x">again</a>'
    df = spark.createDataFrame([(1, "https://s.test/docs/", page), (2, None, page), (3, "https://s.test/", None)], "page_id int, url string, content string")
    links = crawl.page_links(df, "page_id", "url", "content")
    assert rows(links) == [(1, "https://s.test/x"), (1, "https://s.test/y")]
    assert rows(crawl.frontier(links, links.where("link LIKE '%x'"), "link", 5)) == [("https://s.test/y",)]
    assert crawl.page_texts(df, "page_id", "content").where("page_id = 3").first()["content"] == ""


CHUNK = "doc_id string, content string, chunk_index int, relative_path string, embedding array<float>"


def test_sinks(spark, tmp_path, rows):
    c = spark.createDataFrame([("a#0", "long enough content", 0, "a", [1.0]), (None, "another long content", 3, "b", [2.0]), ("c#0", "short", 0, "c", [1.0]), ("d#0", "no vector in this one", 0, "d", None)], CHUNK)
    assert rows(sinks.prepared(c, None, True).select("doc_id")) == [("a#0",), ("b#3",)]
    assert sinks.prepared(c).count() == 3
    docs = spark.createDataFrame([("z", "whole document text")], "relative_path string, content string")
    assert sinks.prepared(c.limit(0), docs).first()["doc_id"] == "z#0"
    store = sinks.create_backend("vector", spark, str(tmp_path / "v"))
    r = store.store(c)
    assert (r.success, r.stored_count, r.error_count) == (False, 2, 2)
    assert store.delete(spark.createDataFrame([("a#0",), ("none",)], "doc_id string")) == 2 and store.stats().first()["row_count"] == 1
    index = sinks.create_backend("text", spark, str(tmp_path / "t"))
    index.store(c.drop("embedding").where("doc_id IS NOT NULL"))
    again = spark.createDataFrame([("a#0", "changed content", 0, "a")], "doc_id string, content string, chunk_index int, relative_path string")
    assert index.store(again).success and index.read().where("doc_id = 'a#0'").first()["text"] == "changed content" and index.stats().first()[0] == 3
    with pytest.raises(ValueError):
        sinks.create_backend("other", spark, "x")
    assert sinks.append_rows(c, str(tmp_path / "l"), ["doc_id", "embedding"]) == 2


def test_text_index_rewrites_touched_parts(spark, tmp_path):
    index = sinks.TextIndex(spark, str(tmp_path / "t"), parts=8)
    assert index.ensure() and not index.ensure()
    full = spark.range(50).selectExpr("concat('d', id) AS doc_id", "concat('text ', id) AS content")
    assert index.store(full).stored_count == 50
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    index.store(full.where("doc_id = 'd7'").selectExpr("doc_id", "'new' AS content"))
    assert index.stats().first()[0] == 50 and index.read().where("doc_id = 'd7'").first()["text"] == "new"
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(before.items() & after.items()) == len(before) - 1


def test_sparse_side(spark, tmp_path, rows):
    c = spark.createDataFrame([("a#0", "pod pod node", [1.0])], "doc_id string, content string, embedding array<float>")
    sinks.VectorStore(spark, str(tmp_path / "v"), sparse=True).store(c)
    assert rows(spark.read.parquet(str(tmp_path / "v-sparse"))) == [("a#0", "node", 1), ("a#0", "pod", 2)]


def test_unit_of_work(spark, tmp_path):
    with sinks.UnitOfWork(spark, str(tmp_path)) as u:
        u.write("a", spark.range(2))
        u.write("b", spark.range(3))
        assert u.read("a").count() == 2
    other = sinks.UnitOfWork(spark, str(tmp_path))
    with pytest.raises(RuntimeError), other:
        other.write("a", spark.range(9))
        raise RuntimeError
    assert other.read("a").count() == 2 and other.read("b").count() == 3
    with sinks.UnitOfWork(spark, str(tmp_path)) as u:
        u.write("b", spark.range(7))
    assert other.read("a").count() == 2 and other.read("b").count() == 7


def test_write_tree_and_code(spark, tmp_path, rows):
    df = spark.createDataFrame([("a/b.html", "one"), ("c", None), ("../x", "no"), (None, "no")], "p string, t string")
    got = {r["path"]: r["error"] is None for r in sinks.write_tree(df, "p", "t", str(tmp_path), ".md").collect()}
    assert got == {"a/b.html": True, "c": True, "../x": False, None: False}
    assert (tmp_path / "a/b.md").read_text() == "one" and (tmp_path / "c.md").read_text() == ""
    blocks = spark.createDataFrame([("c1", "code")], "code_id string, code string")
    assert rows(sinks.write_code(blocks, str(tmp_path / "codes"))) == [("c1",)] and (tmp_path / "codes/c1.txt").read_text() == "code"


def test_unique_paths(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "k int, p string")
    assert rows(files.unique_paths(df, "p", "k")) == [(1, "a"), (2, "a@2"), (3, "page_3"), (4, "page_4")]


def test_excluded_files_are_not_read(spark, folder):
    plan = files.read_documents(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "_print" in plan and "file_path" in plan
    assert files.upload_vectors(files.uploads(spark, folder)).where("size(embedding) = 64").count() == 7


def test_pipeline(spark):
    df = spark.range(3)
    p = P.Pipeline().add("double", lambda d: d.selectExpr("id * 2 AS id")).add("one", lambda d: d.limit(1)).enable("one", False)
    assert p(df).count() == 3 and [s["enabled"] for s in p.info()] == [True, False] and p.log[0]["status"] == "success"
    e = P.Pipeline(eager=True).add("some", lambda d: d.where("id > 0"))
    assert e(df).count() == 2 and e.log[0]["rows"] == 2
    p.remove("one").add("first", lambda d: d.where("id > 0"), 0)
    assert [s["name"] for s in p.info()] == ["first", "double"]
    with pytest.raises(KeyError):
        p.remove("gone")
    with pytest.raises(ValueError):
        P.Settings().merged(nope=1)
    with pytest.raises(ValueError):
        P.Settings(backend="hybrid").check()
    assert P.Settings(dim=None).inferred().dim == 384 and P.Settings(dim=None, model="?").inferred().dim == 512
    assert P.Settings(dim=None).inferred(lambda: __import__("corvid.operators.vectors", fromlist=["x"]).HashingEncoder(24)).dim == 24


def test_ingest(spark, folder, tmp_path):
    s = P.Settings(root=folder, target=str(tmp_path / "store"), selector="main", dim=16)
    r = P.ingest(spark, s)
    assert r.success and r.documents == 4 and r.stored == r.chunks == 2
    got = spark.read.parquet(s.target)
    assert {len(x["embedding"]) for x in got.collect()} == {16}
    assert P.ingest(spark, s.merged(dry_run=True)).stored == 0
    assert P.main([folder, str(tmp_path / "cli"), "--backend", "text", "--selector", "main"]) == 0
    twice = spark.createDataFrame([("p", ".md", "first text long enough"), ("p", ".md", "second text long enough")], "relative_path string, file_type string, content string")
    assert P.clean_html_step(s)(twice).count() == 2


def test_streams(spark, tmp_path, rows):
    import datetime as dt

    t0 = dt.datetime(2025, 1, 1)
    data = [("a", str(i), t0 + dt.timedelta(seconds=10 * i)) for i in range(6)] + [("a", "z", t0 + dt.timedelta(seconds=9000)), ("b", "q", t0), (None, "n", t0)]
    df = spark.createDataFrame(data, "key string, item string, ts timestamp_ntz")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = state.read_stream(spark, str(tmp_path / "in"), df.schema)
    last = state.run_once(state.last_seen(s, "key", "ts"), "t_last", "complete")
    batch = df.where("key IS NOT NULL").groupBy("key").agg({"ts": "max"})
    assert [r[1] for r in last.orderBy("key").collect()] == [r[1] for r in batch.orderBy("key").collect()]
    lists = state.run_once(state.bounded_lists(s, "key", "item", "ts", 3), "t_lists")
    assert {r["key"]: r["items"] for r in lists.collect()} == {"a": "z", "b": "q"}
    p = P.Pipeline().add("keep", lambda d: d.where("key = 'b'"))
    state.ingest_stream(s, p, str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    import shutil

    shutil.rmtree(tmp_path / "c3")
    state.ingest_stream(s, p, str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_staging_and_shared_folder(spark, monkeypatch):
    import os

    from corvid import session

    before = len(session._STAGED)
    with session.staging():
        at = session.stage(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(at)
    assert not os.path.exists(at) and len(session._STAGED) == before
    big = spark.createDataFrame([("x" * 1000, [1, 2])], "s string, a array<int>")
    assert 1000 < session.bytes_of(big) < 1200 and session.bytes_of(big.limit(0)) == 0
    assert "Broadcast" in spark.range(9).join(session.sent(big.withColumn("id", big.s.cast("bigint"))), "id")._jdf.queryExecution().toString()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster())

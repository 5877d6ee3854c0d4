from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x")).first()[0]


def test_clean_text(spark):
    assert one(spark, None, T.clean_text) == ""
    assert one(spark, " a\x00\t\t b\n\n\n\nc　", T.clean_text) == "a b\n\nc"
    assert one(spark, "a\r\n b\x85c", T.clean_text) == "a\r\n bc"


def test_clean_text_is_idempotent(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",))), min_size=1, max_size=40))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "x string").select(T.clean_text("x").alias("a")).withColumn("b", T.clean_text("a"))
        assert df.where("a <> b").count() == 0

    check()


def test_flat(spark):
    assert one(spark, " a \n\n b　c ", T.clean_text_flat) == "a b c"


def test_clean_html(spark):
    page = "<HEAD>x</HEAD><!-- a\nb --><nav class='q'>menu</nav><SCRIPT>1</SCRIPT><p>keep</p><footer>f</footer><aside>s</aside>"
    assert one(spark, page, T.clean_html) == "<HEAD>x</HEAD><p>keep</p>"
    assert "menu" in one(spark, page, T.clean_html_legacy)


def test_valid_text(spark):
    for value, want in ((None, False), ("", False), ("short", False), ("éééééééééééé", False), ("中文文本一二三四五六七", True), ("long enough text", True)):
        assert one(spark, value, T.valid_text) is want


def test_metadata_keys(spark):
    df = spark.createDataFrame([({"a b": "1", "a_b": "2", "é中 a": None},)], "x map<string,string>")
    assert df.select(T.clean_metadata("x")).first()[0] == {"a_b": "2", "é中_a": ""}
    assert spark.createDataFrame([(None,)], "x map<string,string>").select(T.clean_metadata("x")).first()[0] is None


def test_titles(spark):
    df = spark.createDataFrame([("# Head \nx", "f"), ("x\nTitle: T", "f"), (None, "f"), ("\n" * 10 + "# late", None)], "t string, f string")
    assert [r[0] for r in df.select(T.title_of("t", "f")).collect()] == ["Head", "T", "f", None]
    df = spark.createDataFrame([(None, None), ("New Chat", "u" * 60), ("own", "u")], "t string, f string")
    assert [r[0] for r in df.select(T.conversation_title("t", "f")).collect()] == ["New Chat", "u" * 50 + "...", "own"]


def test_urls(spark):
    assert one(spark, "https://a.test/docs/x-y/", T.url_filename) == "docs_x_y.html"
    assert one(spark, "https://a.test", T.url_filename) == "index.html"
    assert one(spark, None, T.url_filename) is None
    keep = lambda u: one(spark, u, lambda c: T.is_doc_url(c, "https://a.test"))
    assert keep("https://a.test/docs/tasks/x") and not keep("https://b.test/docs/tasks/x") and not keep("https://a.test/docs/tasks/search-x/search") and keep(None) is False


def test_ids(spark):
    assert one(spark, "anon_" + "0123456789abcdef" * 2, T.anon_uuid) == "01234567-89ab-cdef-0123-456789abcdef"
    assert one(spark, "anon_xyz", T.anon_uuid) is None


def test_entity_text(spark):
    meta = '{"text": "", "_node_content": "{\\"content\\": \\"deep\\"}"}'
    f = lambda c: T.entity_text(F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col(c))
    assert one(spark, meta, f) == "deep"
    assert one(spark, "broken{", f) is None


def test_sse(spark):
    body = "event: a\r\ndata: {\"x\": 1}\r\n\r\ndata: {\"y\":\ndata: 2}\n\n\n\nevent: b\ndata: bad"
    got = [tuple(e) for e in one(spark, body, T.sse_events)]
    assert got == [("a", '{"x": 1}'), ("message", '{"y":\n2}'), ("b", "{}")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(F.round(V.cosine("a", "b"), 6)).collect()] == [0.96, None, None, None]
    assert [round(x, 6) for x in df.select(V.l2_normalize("a")).first()[0]] == [0.6, 0.8]
    assert spark.range(1).select(V.distance_score(F.lit(0.5)), V.distance_score(F.lit(-0.5))).first()[1] == 1.0


def test_consumed_streams(spark):
    import pytest
    from pyspark.errors import PySparkException

    from corvid.functions import text as T

    body = ["data: 1\n\nevent: done\ndata: {}\n\ndata: 2\n\n", 'data: 1\n\nevent: error\ndata: {"message": "boom"}\n\n', "data: 1\n\ndata: 2\n\n", ""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(body)], "i int, b string")
    got = [(r["x"]["status"], r["x"]["message"], len(r["x"]["events"])) for r in df.select("i", T.sse_consumed("b").alias("x")).orderBy("i").collect()]
    assert got == [("done", None, 1), ("error", "boom", 1), ("open", None, 2), ("open", None, 0)]
    assert df.where("i <> 1").select(T.sse_strict("b")).count() == 3
    with pytest.raises(PySparkException, match="boom"):
        df.select(T.sse_strict("b")).collect()
    assert [r[0] for r in spark.createDataFrame([(" Human",), ("AI",), ("System",), ("?",), (None,)], "r string").select(T.canonical_role("r")).collect()] == ["user", "assistant", "system", None, None]

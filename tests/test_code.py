from corvid.functions import html as H
from corvid.operators import code as C


def lang(spark, text, **k):
    return spark.createDataFrame([(text,)], "c string").select(C.detect_language("c", **k)).first()[0]


def test_languages(spark):
    for text, want in (("FROM ubuntu", "python"), ("# comment", "bash"), ("let me see", "javascript"), ("import x", "python"), ("- item", "yaml"), ("plain", "text"), (None, "text"), ("x\nRUN make", "dockerfile"), ("{\n", "json"), ("func main", "go"), ("echo hi", "shell")):
        assert lang(spark, text) == want, text
    assert lang(spark, "SELECT 1", long_list=True) == "sql"


def test_blocks_and_restore(spark):
    page = f'<div class="lang-go"><code>{"x" * 501}</code></div><pre class="q"><code class="a language-yaml">{"y: 1 " * 120}</code></pre><code>{"z" * 500}</code>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "no code")], "id int, html string")
    got = C.code_blocks(df, "id", "html").orderBy("idx").collect()
    assert [(r["idx"], r["length"], r["language"]) for r in got] == [(0, 501, "go"), (1, 599, "yaml")]
    text = C.html_pages(df, "id", "html")
    rows = {r["id"]: r for r in text.collect()}
    assert rows[1]["content"].count("[CODE_BLOCK:code_block_") == 2 and rows[1]["n_codes"] == 2 and rows[2]["content"] == ""
    blocks = C.code_blocks(df, "id", "html")
    back = {r["id"]: r["content"] for r in C.restore(text, "id", "content", blocks).collect()}
    assert "\n```" + "x" * 501 + "\n```\n" in back[1] and "CODE_BLOCK" not in back[1]
    assert C.associate(text, "id", "content", blocks).collect()[0]["code_ids"] == sorted(r["code_id"] for r in got)
    unknown = spark.createDataFrame([(9, "see [CODE_BLOCK: nope] [1]"), (8, None)], "id int, content string")
    assert {r["id"]: r["content"] for r in C.restore(unknown, "id", "content", blocks).collect()} == {9: "see [CODE_BLOCK: nope] [1]", 8: None}


def test_selectors_and_text(spark):
    root = H.parse('<DIV class="a td-content"><H1>T</H1><p>x<b>y</b></p><ul><li>i<li>j</ul><table><tr><td>1</td><td>2</td></tr></table></DIV><div id=content>c</div>')
    assert H.select(root, "div.td-content").tag == "div" and H.select(root, ".td-content") and H.select(root, "#content") and H.select(root, "main") is None
    text = H.markdown_of(H.select(root, ".td-content"))
    assert text.startswith("# T") and "xy" in text and "* i" in text and "| 1 | 2 |" in text
    df = spark.createDataFrame([(1, "<p>whole page text</p>")], "id int, html string")
    assert C.html_pages(df, "id", "html", "main").first()["content"] == ""
    assert C.html_pages(df, "id", "html", "main", skip_missing=False).first()["content"] == "whole page text"
    assert C.html_pages(df, "id", "html", legacy=True).first()["content"] == "whole page text"
    assert H.page_content("<body><nav>long navigation</nav><main>A line that is long<p>short</p></main></body>") == "A line that is long"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert H.markdown_of(H.parse(deep)) == "deep"

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import blocks_text, html, markdown
from docloom.operators.markdown import inline_text, wrap_item, wrap_text
from docloom.plans import queries
from docloom.schema import BLOCKS


def render(spark, page, flavor="gfm"):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    rows = markdown.markdown(html.html_blocks(df), flavor).collect()
    return rows[0].markdown if rows else ""


def rows_of(spark, *blocks):
    names = ["doc_id", "pos", "kind", "level", "text", "ordered", "items", "rows", "alt", "path", "title", "language", "label"]
    return spark.createDataFrame([tuple({"doc_id": 1, "pos": i, **b}.get(n) for n in names) for i, b in enumerate(blocks)], BLOCKS)


def written(spark, *blocks, flavor="gfm", output="markdown"):
    return markdown.markdown(rows_of(spark, *blocks), flavor, output).first().markdown


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<h1>Title</h1>\n<p>Body</p>\n", "# Title\n\nBody\n"),
        ("<h1>Doc</h1><script>x('<p>no</p>')</script><p>Intro</p><ul><li>one</li><li>two</li></ul><pre><code>a < b</code></pre><h2>Next</h2>", "# Doc\n\nIntro\n\n- one\n- two\n\n```text\na\n```\n\n## Next\n"),
        ("<h1>T</h1><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "# T\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n"),
        ("<p>x <b>unclosed", "# x unclosed\n"),
        ("<h3>a</h3><h1>b</h1><h6>c</h6><h2>a</h2>", "# a\n\n## b\n\n### c\n\n## a (2)\n"),
    ],
)
def test_pages(spark, page, expected):
    assert render(spark, page) == expected


def test_html_stops_at_an_unclosed_element_and_warns(spark):
    df = spark.createDataFrame([(1, "<p>a</p><ul><li>x</ul><p>open<h1>never</h1>"), (2, "<img src='x'><img src=\"a.png\"><img src=\"b.png\" title=\"t\">"), (3, "plain"), (4, None), (5, "<table><tr><td>rowspan=\"2\" src=\"i.png\"</td><th>h</th></tr></table>")], "page_id long, html string")
    b = {(r.doc_id, r.pos): r for r in html.html_blocks(df).collect()}
    assert [b[k].kind for k in sorted(b)] == ["paragraph", "image", "image", "paragraph", "table"]
    cells = b[5, 0].rows[0].cells
    assert [c.text for c in cells] == ["h", 'rowspan="2" src="i.png"'] and cells[1].rowspan == 2 and cells[1].image == "i.png"
    w = sorted((r.doc_id, r.warning) for r in html.html_warnings(df).collect())
    assert w == [(2, "image caption inference failed: a.png"), (3, html.NO_STRUCTURE), (4, html.NO_STRUCTURE)]


def test_tables_lists_images_and_notes(spark):
    cell = lambda t, **k: {"text": t, "rowspan": k.get("rowspan", 1), "colspan": k.get("colspan", 1), "image": k.get("image")}
    out = written(
        spark, {"kind": "heading", "level": 1, "text": "T"}, {"kind": "list", "ordered": True, "items": [{"kind": "text", "text": "a"}, {"kind": "text", "text": "see https://x.y"}]},
        {"kind": "table", "rows": [{"cells": [cell("A", colspan=2)]}, {"cells": [cell("1 < 2"), cell("pic", image="p.png")]}]},
        {"kind": "image", "alt": "a", "path": "my pic(1).png", "title": "cap"}, {"kind": "footnote", "label": "1", "text": "note"}, {"kind": "raw", "text": " <b>x</b> "},
    )
    assert out == (
        "# T\n\n1. a\n2. see <https://x.y>\n\n<table>\n<tr><td colspan=\"2\">A</td></tr>\n<tr><td>1 &lt; 2</td><td><img src=\"p.png\" alt=\"pic\"></td></tr>\n</table>\n\n"
        '![a](<my pic(1).png> "cap")\n\n[^1]: note\n\n<b>x</b>\n'
    )


def test_flavors(spark):
    items = {"kind": "list", "ordered": True, "items": [{"kind": "text", "text": "a"}, {"kind": "text", "text": "b"}]}
    assert written(spark, items, flavor="markdownlint") == "1. a\n1. b\n"
    long = "word " * 30
    first, second = {"kind": "paragraph", "text": long}, {"kind": "paragraph", "text": "goes on."}
    assert written(spark, first, second, flavor="markdownlint").replace("\n", " ") == long + "goes on. "
    assert written(spark, first, second).count("\n\n") == 1
    assert written(spark, {"kind": "heading", "level": 2, "text": "a<b"}, {"kind": "paragraph", "text": "c"}, {"kind": "code", "text": "d", "language": None}, output="html") == "<h2>a&lt;b</h2>\n<p>c</p>\n```\nd\n```\n"
    with pytest.raises(ValueError):
        written(spark, items, flavor="none")


def test_long_headings_split_at_the_last_space_that_fits(spark):
    text = "word " * 15 + "finally over the edge of the line."
    out = written(spark, {"kind": "heading", "level": 1, "text": text})
    head, rest = out.split("\n\n")
    assert head == "# " + "word " * 14 + "word" and rest == "finally over the edge of the line\n"
    assert written(spark, {"kind": "heading", "level": 1, "text": "x" * 100}) == "# " + "x" * 78 + "\n"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("see http://a.b/c.", "see <http://a.b/c>."), ("(www.x.org)", "(<www.x.org>)"), ("a@b.co!", "<a@b.co>!"), ("<https://x.y>", "<<https://x.y>>"), ("http://a.b/ c/d", "<http://a.b/c/d>"),
        ("日本http://a.bです", "日本<http://a.b>です"), ("a*b_c", r"a\*b\_c"), ("x <y>", "x &lt;y&gt;"), ("# h", r"\# h"), ("1. a", r"1\. a"), ("- a", r"\- a"), ("---", r"\---"), ("12) x", r"12\) x"), ("a)[b", r"a)\[b"), ("  two   spaces ", "two spaces"),
    ],
)
def test_inline_text(spark, text, expected):
    assert inline_text(text) == expected
    got = spark.createDataFrame([(text,)], "t string").select(markdown.inline(F.col("t")).alias("m")).first().m
    assert got == expected


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab*_[]`<>#-+1.)\\ é日 \t\n", max_size=120), min_size=1, max_size=30))
def test_native_and_arrow_paths_agree(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", markdown.inline(F.col("t")).alias("m"), markdown.wrapped(F.col("t")).alias("w"), markdown._inline_arrow("t").alias("a")).collect():
        assert r.m == r.a == inline_text(r.t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=100), max_size=40))
def test_wrapped_lines_fit_and_keep_the_text(words):
    text = " ".join(words)
    assert all(len(line) <= 80 for line in wrap_text(text).split("\n"))
    assert "".join(wrap_text(text).split()) == "".join(words)
    assert wrap_item(text, "- ").split() == ["-", *words]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 7), min_size=1, max_size=12), min_size=1, max_size=10))
def test_heading_levels_follow_the_recurrence(spark, docs):
    rows = [(d, i, "heading", lv, f"h{i}") + (None,) * 8 for d, levels in enumerate(docs) for i, lv in enumerate(levels)]
    got = {(r.doc_id, r.pos): r.out_level for r in markdown.headings(spark.createDataFrame(rows, BLOCKS)).collect()}
    for d, levels in enumerate(docs):
        last = 0
        for i, lv in enumerate(levels):
            want = 1 if i == 0 else 2 if lv == 1 else min(max(lv, 1), 6)
            last = min(want, last + 1)
            assert got[d, i] == last


def test_markdown_round_trip(spark):
    text = "# A\n\npara one\nline two\n\n- x\n- y\n\n1. z\n\n| a | b |\n| --- | --- |\n| c | d |\n\n```py\ncode\n```\n\n![alt](<p.png> \"t\")\n\n[^n]: note\n"
    b = blocks_text.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id long, markdown string"))
    assert [r.kind for r in b.orderBy("pos").collect()] == ["heading", "paragraph", "list", "list", "table", "code", "image", "footnote"]
    assert blocks_text.prompt_markdown(b).first().markdown == "# A\n\npara one\nline two\n\n- x\n- y\n\n1. z\n\n| a | b |\n| --- | --- |\n| c | d |\n\n```py\ncode\n```\n\n![alt](p.png \"t\")\n\n[^n]: note"


def test_line_diff(spark):
    r = spark.createDataFrame([("a\nb\nc\n", "a\nx\n")], "a string, b string").select(blocks_text.line_diff(F.col("a"), F.col("b")).alias("d")).first()
    assert r.d == "--- before\n+++ after\n@@\n a\n-b\n+x\n-c\n"


def test_registered_wrapping_keeps_documents_with_long_tokens(spark, tmp_path):
    texts = ["short  words\n" * 20, "before " * 15 + "x" * 200 + " after", "é" * 81, None, "", "y" * 80 + " " + "z" * 80]

    def brute(text):
        lines = [""]
        for t in text.split():
            if len(t) > 80:
                lines += [t[i : i + 80] for i in range(0, len(t), 80)]
            elif not lines[-1] or len(lines[-1]) + 1 + len(t) > 80:
                lines.append(t)
            else:
                lines[-1] += " " + t
        return "\n".join(x for x in lines if x)

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.lines for r in queries.QUERIES["w7_wrapped_text"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute(t) for i, t in enumerate(texts)}

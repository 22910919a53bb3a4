import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom import options
from docloom.integrations import models, ocr, plugins
from docloom.operators import html, office, pdf, report
from docloom.options import Options
from docloom.plans.convert import convert
from docloom.sources import pdf as pdf_source
from docloom.sources.files import files, from_bytes
from docloom.streaming.inventory import convert_stream


def package(**parts):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return f.getvalue()


def converted(spark, name, content, **opts):
    df = spark.createDataFrame([(1, name, len(content), content)], "doc_id long, name string, length long, content binary")
    return convert(df, Options(flavor="gfm", **opts), [name.rpartition(".")[2], "other"])


P = "<w:p>{}<w:r><w:t>{}</w:t></w:r></w:p>"
STYLE = '<w:pPr><w:pStyle w:val="{}"/></w:pPr>'


def test_word(spark):
    body = P.format(STYLE.format("Heading1"), "Doc") + P.format("", "Plain &amp; <w:b/>simple") + P.format('<w:pPr><w:numPr/></w:pPr>', "a") + P.format('<w:pPr><w:numPr/></w:pPr>', "b") + P.format(STYLE.format("Odd"), "Figure 1. A chart")
    body += '<w:p><a:blip r:embed="rId5"/></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:t>Head</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:t>1</w:t></w:tc><w:tc><w:t>2</w:t></w:tc></w:tr></w:tbl>'
    body += '<w:p><w:t>Noted</w:t><w:footnoteReference w:id="2"/><w:hyperlink r:id="rId6"/></w:p><w:p/>'
    rels = '<Relationships><Relationship Id="rId5" Target="media/image1.png"/><Relationship Id="rId6" Target="https://x.y"/></Relationships>'
    c = converted(spark, "a.docx", package(**{"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels, "word/footnotes.xml": '<w:footnote w:id="2"><w:t>the note</w:t></w:footnote>'}))
    assert c.markdown().first().markdown == (
        "# Doc\n\nPlain & simple\n\n- a\n\n- b\n\nFigure 1. A chart\n\n![Figure 1. A chart](media/image1.png \"Figure 1. A chart\")\n\n"
        '<table>\n<tr><td colspan="2">Head</td></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>\n\nNoted <<https://x.y>>\n\n[^2]: the note\n'
    )
    assert [r.warning for r in c.warnings.collect()] == ["unmapped docx paragraph style: Odd"]
    r = c.reports().first()
    assert r.media == ["media/image1.png"] and r.media_candidates[0].confidence == 1.0 and "media:referenced" in r.features
    assert c.report_json().first().json.startswith('{"input_path":"a.docx","input_format":"docx"')


def test_body_blocks_nest_and_close_themselves():
    assert office.body_blocks("<w:body><w:p a='1'>x<w:p>in</w:p>y</w:p><w:p/><w:pPr/><w:tbl><w:p>z</w:p></w:tbl><w:p>open") == [("w:p", "x<w:p>in</w:p>y"), ("w:p", ""), ("w:tbl", "<w:p>z</w:p>")]


def shape(x, y, text, extra=""):
    return f'<p:sp>{extra}<a:off x="{x}" y="{y}"/>' + "".join(f"<a:p>{b}<a:r><a:t>{t}</a:t></a:r></a:p>" for b, t in text) + "</p:sp>"


def test_slides(spark):
    one = "<p:sld>" + shape(0, 500, [("", "Body"), ("<a:buChar/>", "i1"), ("<a:buChar/>", "i2"), ("<a:buAutoNum/>", "n1")]) + shape(0, 0, [("", "The title"), ("", "sub")], '<p:ph type="title"/>') + '<p:pic><a:blip r:embed="r1"/><a:off x="5" y="900"/></p:pic></p:sld>'
    two = "<p:sld><a:p><a:t>Sp</a:t></a:p><a:p><a:t>lit</a:t></a:p></p:sld>"
    c = converted(spark, "a.pptx", package(**{"ppt/slides/slide1.xml": one, "ppt/slides/slide3.xml": two, "ppt/slides/_rels/slide1.xml.rels": '<R Id="r1" Target="../media/i.png"/>'}))
    assert c.markdown().first().markdown == "# The title\n\nsub\n\nBody\n\n- i1\n- i2\n\nn1\n\n![slide image](../media/i.png)\n\n## Sp\n\nlit\n"
    assert "pptx visual order inferred from shape coordinates" in {r.warning for r in c.warnings.collect()}


def test_sheets(spark):
    cells = '<row></row><row><c r="A1"/></c><c r="B1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row><row><c r="A2"><v></v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="C2"><v>7</v></c></row><row><c r="A3"><v> </v></c></row>'
    c = converted(spark, "a.xlsx", package(**{"xl/worksheets/sheet1.xml": f"<worksheet>{cells}</worksheet>", "xl/sharedStrings.xml": "<sst><si><t>shared</t><rPh><t>reading</t></rPh></si></sst>"}))
    assert c.markdown().first().markdown == "| shared | 2 |\n| --- | --- |\n| in | 7 |\n"
    merged = '<worksheet><row><c r="A1" t="inlineStr"><is><t>Head</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>2</v></c></row><mergeCell ref="A1:B1"/></worksheet>'
    c = converted(spark, "b.xlsx", package(**{"xl/worksheets/sheet1.xml": merged, "xl/worksheets/sheet2.xml": merged}))
    out = c.markdown().first().markdown
    assert out.startswith("# Sheet 1\n\n<table>\n<tr><td colspan=\"2\">Head</td></tr>") and "## Sheet 2" in out
    assert sorted(r.warning for r in c.warnings.collect()) == ["xlsx mergeCells expanded 1 merged range(s)"] * 2


def test_opendocument_and_bad_packages(spark):
    x = '<office:text><text:h text:outline-level="9">Head</text:h><text:p> a <text:span>b</text:span> </text:p><text:p/><table:table><table:table-row><table:table-cell><text:p>c</text:p></table:table-cell></table:table-row></table:table></office:text>'
    assert converted(spark, "a.odt", package(**{"content.xml": x})).markdown().first().markdown.startswith("# Head\n\na b\n")
    c = converted(spark, "a.docx", b"not a zip")
    assert c.results().first().markdown == "Unsupported input format: docx\n"


def test_text_like_and_unsupported(spark):
    rows = [(1, "n.md", b" # Hi \n"), (2, "d.csv", b"a,b\n"), (3, "x.zip", b"PK"), (4, "p.png", b"\x89"), (5, "noext", b"<p>x.</p>"), (6, "bad.html", b"\xff<p>y</p>"), (7, "l.gdoc", b"{}")]
    df = spark.createDataFrame([(i, n, len(c), c) for i, n, c in rows], "doc_id long, name string, length long, content binary")
    got = {r.doc_id: r.markdown for r in convert(df, Options(flavor="gfm")).results().collect()}
    assert got == {1: "# Hi\n", 2: "```csv\na,b\n```\n", 3: "Unsupported input format: zip\n", 4: "Unsupported input format: image input\n", 5: "x.\n", 6: "", 7: "```json\n{}\n```\n"}
    strict = {r.doc_id: r.status for r in convert(df, Options(strict=True)).results().collect()}
    assert strict[3] == "error" and strict[1] == "ok"


PDF = b"%PDF-1.4\nBT\n/F1 24 Tf\n72 720 Td\n(Fixture Title) Tj\nET\nBT\n/F1 11 Tf\n(Fixture body \\(text\\).) Tj\nET\n"


def test_pdf_files(spark):
    c = converted(spark, "a.pdf", PDF)
    assert c.markdown().first().markdown == "# Fixture Title\n\nFixture body (text).\n"
    body = zlib.compress(b"BT /F1 12 Tf 10 700 Td [(Packed) -300 (text)] TJ ET")
    packed = b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode /Length 9 >> stream\n" + body + b"\nendstream endobj"
    assert [r[1] for r in pdf_source.raw_content_runs(packed)] == ["Packed text"]
    cmap = b"beginbfchar <01> <0041> endbfchar beginbfrange <02> <03> <0042> endbfrange"
    fonts = b"%PDF\n1 0 obj << /ToUnicode 2 0 R >> endobj\n2 0 obj << >> stream\n" + cmap + b"\nendstream endobj\n3 0 obj << /Font << /F9 1 0 R >> >> endobj\n4 0 obj << >> stream\nBT /F9 9 Tf <010203> Tj ET\nendstream endobj"
    assert [r[1] for r in pdf_source.raw_content_runs(fonts)] == ["ABC"]
    assert pdf_source.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    bad = converted(spark, "b.pdf", b"%PDF nothing")
    assert "produced no text" in bad.warnings.filter("warning LIKE '%produced no text%'").first().warning


def objects(spark, texts, size=11.0):
    return spark.createDataFrame([(1, i, t, size) for i, t in enumerate(texts)], "doc_id long, ord int, text string, font_size double")


def test_pdf_structure(spark):
    kinds = lambda *t: [(r.kind, r.level, r.text, r["items"] and len(r["items"])) for r in pdf.text_blocks(objects(spark, t)).orderBy("pos").collect()]
    assert kinds("Plain title here", "3", "© ACME", "2026/04/03 17:44", "1. Use short cuts") == [("paragraph", None, "Plain title here", None), ("heading", 2, "1. Use short cuts", None)]
    assert kinds("1. a", "text one", "1. b", "text two", "1. c") [0::2] == [("heading", 2, "1. a", None), ("heading", 2, "2. b", None), ("heading", 2, "3. c", None)]
    assert kinds("- a", "• b", "tail") == [("list", None, None, 2), ("paragraph", None, "tail", None)]
    assert kinds("第1章 Start", "1.2 Sub", "2. Stop.") == [("heading", 1, "第1章 Start", None), ("heading", 2, "1.2 Sub", None), ("paragraph", None, "2. Stop.", None)]
    assert kinds("| No | Q |", "| --- | --- |", "| 1 | a |", "| 2 | b |", "after") == [("table", None, None, None), ("paragraph", None, "after", None)]
    assert kinds("This line is long enough to go on and", "ends here.", "Short", "stays") == [("paragraph", None, "This line is long enough to go on and ends here.", None), ("paragraph", None, "Short", None), ("paragraph", None, "stays", None)]
    big = pdf.text_blocks(objects(spark, ["body"]).unionByName(objects(spark, ["Top"], 20.0).withColumn("ord", F.lit(5)))).filter("kind = 'heading'").first()
    assert big.text == "Top" and big.level == 1


def test_pdf_words_scores_and_pages(spark):
    w = spark.createDataFrame([(1, 0, t, float(x0), float(x0 + 8), float(top)) for t, x0, top in [("1", 10, 20), ("alpha", 50, 20), ("beta", 50, 26), ("2", 10, 40), ("gamma", 50, 40)]], "doc_id long, page int, text string, x0 double, x1 double, top double")
    head = spark.createDataFrame([(1, 0, 8.0, 18.0), (1, 0, 48.0, 60.0)], "doc_id long, page int, x0 double, x1 double")
    assert [list(r["cells"]) for r in pdf.table_from_words(w, head).orderBy("anchor").collect()] == [["1", "alpha beta"], ["2", "gamma"]]
    t = spark.createDataFrame([("x" * 120, True), ("α" * 120, False)], "t string, failed boolean")
    assert [r[0] for r in t.select(pdf.result_score(F.col("t"), F.lit(True), F.col("failed"), F.lit(False))).collect()] == [0, 0]
    d = spark.createDataFrame([("/Subtype /Image",), ("/BaseFont",), ("x",)], "x string")
    assert [r[0] for r in d.select(pdf.no_text_diagnosis(F.col("x"))).collect()] == ["image_only", "missing_unicode_maps", "unknown"]
    pages = spark.createDataFrame([(1, 0, []), (1, 1, ["native"])], "doc_id long, page int, lines array<string>")
    read = spark.createDataFrame([(1, 0, "ocr a\nocr b\n")], "doc_id long, page int, text string")
    runs = spark.createDataFrame([(1, 0, 0, "bad", 9.0), (1, 1, 1, "native", 9.0)], "doc_id long, page int, ord int, text string, font_size double")
    assert sorted((r.page, r.ord, r.text) for r in pdf.merge_ocr_pages(runs, read).collect()) == [(0, 0, "ocr a"), (0, 1, "ocr b"), (1, 1, "native")]
    assert ocr.pages_to_read(pages, pages.limit(0).select("doc_id")).count() == 1


def test_model_filters(spark):
    b = html.html_blocks(spark.createDataFrame([(1, "<h1>T</h1><ul><li>a</li></ul><p>text goes here</p>"), (2, "<p>lonely words</p>")], "page_id long, html string"))
    sent = Options(llm="openai", consent_external_send=True)
    good, said, diffs = models.filtered(b, lambda r: r["input"].split("\n\n", 1)[1].replace("text", "better text"), "restructure", sent)
    assert {r.warning for r in said.collect()} == {"LLM restructure response accepted and diff saved."}
    assert good.filter("text = 'better text goes here'").count() == 1
    assert "+better text goes here" in diffs.filter("doc_id = 1").first().diff
    kept, said, _ = models.filtered(b, lambda r: "# T\n\nonly words and some more words", "restructure", sent)
    assert {r.doc_id: r.warning for r in said.collect()}[1] == "LLM restructure response rejected: structured attributes missing from response: list"
    assert kept.filter("doc_id = 1 AND kind = 'list'").count() == 1

    def never(_):
        raise AssertionError("sent without consent")

    same, said, _ = models.filtered(b, never, "translate:de", Options(llm="openai"))
    assert same.count() == b.count() and {r.warning for r in said.collect()} == {"LLM filter skipped because external send consent is not configured."}
    _, said, _ = models.filtered(b, never, "translate:de", sent)
    assert all("failed: sent without consent" in r.warning for r in said.collect())
    assert models.destination(Options(llm="ollama")) is None


def test_ocr_and_plugins(spark):
    images = spark.createDataFrame([(1, 0, b"abc"), (1, 1, b"")], "doc_id long, page int, content binary")
    assert {r.page: (r.text, r.error is None) for r in ocr.recognized(images, lambda c: str(10 // len(c))).collect()} == {0: ("3", True), 1: (None, False)}
    plugins.register(plugins.Manifest("drop-lists", "1"), lambda b: b.filter("kind <> 'list'"))
    b = html.html_blocks(spark.createDataFrame([(1, "<ul><li>a</li></ul><p>b</p>")], "page_id long, html string"))
    assert plugins.apply(b, "drop-lists").count() == 1
    with pytest.raises(ValueError):
        plugins.register(plugins.Manifest("x", "1", abi=9), lambda b: b)


def test_options(tmp_path):
    (tmp_path / "p.txt").write_text("Do it")
    (tmp_path / "c.toml").write_text('# c\nflavor = "gfm"\nformat = "nonsense"\nllm = "ollama:m"\nstrict = true\nllm_prompt_path_vision_describe = "p.txt"\nunknown = 1\n')
    o = options.load_config(str(tmp_path / "c.toml"))
    assert (o.flavor, o.format, o.llm, o.llm_model, o.strict, o.llm_prompts) == ("gfm", "markdown", "ollama", "m", True, {"vision-describe": "Do it"})
    assert options.parse_llm("gpt-x")["llm"] == "openai" and options.parse_llm("openai-compatible:n@http://h")["llm_endpoint"] == "http://h"
    assert options.parse_ocr("off") == "none" and options.parse_ocr("mycmd") == "mycmd"
    with pytest.raises(ValueError):
        Options(extract_media="d", inline_base64_media=True)


def test_media_and_files(spark, tmp_path):
    (tmp_path / "a.html").write_text('<p>x.</p><img src="word/media/i.png" title=" ">')
    f = files(spark, str(tmp_path), "*.html")
    c = convert(f, Options(extract_media="out"))
    m = c.media().first()
    assert (m.path, m.source, m.confidence) == ("out/i.png", "image-reference", 0.0)
    b = html.html_blocks(spark.createDataFrame([(1, '<img src="i.png">')], "page_id long, html string"))
    media = spark.createDataFrame([(1, "i.png", b"\x00\x01")], "doc_id long, path string, content binary")
    assert report.rewrite_media(b, media).first().path == "data:image/png;base64,AAE="


def test_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for i in range(2):
        spark.createDataFrame([(i, "u", f"<h1>Page {i}</h1><p>b.</p>")], "page_id long, url string, html string").write.mode("append").parquet(src)
        convert_stream(spark, src, out, mark).awaitTermination(120)
    assert {r.doc_id: r.markdown for r in spark.read.parquet(f"{out}/markdown").collect()} == {i: f"# Page {i}\n\nb.\n" for i in range(2)}
    assert {r.status for r in spark.read.parquet(f"{out}/inventory").collect()} == {"ok"}


def test_from_bytes_of_any_table(spark):
    df = spark.createDataFrame([(7, "<p>hey.</p>")], "k int, body string")
    assert convert(from_bytes(df, F.lit("a.html"), "body", "k")).results().first().markdown == "hey.\n"


def test_pdf_with_many_streams_and_lines():
    """Images and fonts come first, the map of the last page's font comes last; more lines than 20,000 stay."""
    stream = lambda n, head, body: b"%d 0 obj << %s >> stream\n%s\nendstream endobj\n" % (n, head, body)
    images = b"".join(stream(n, b"/Subtype /Image", b"BT (no) Tj ET") for n in range(1, 91)) + b"".join(stream(n, b"/Length1 9", b"\x00\x01") for n in range(91, 181))
    pages = b"".join(stream(n, b"", b"BT (Page %d) Tj ET" % n) for n in range(200, 260))
    many = stream(300, b"", b"BT " + b"".join(b"0 1 Td (line %d) Tj " % i for i in range(21_000)) + b"ET")
    last = b"301 0 obj << /ToUnicode 303 0 R >> endobj\n" + stream(302, b"/Font << /F9 301 0 R >>", b"BT /F9 9 Tf <010203> Tj ET") + stream(303, b"", b"1 beginbfrange\n<01> <03> <0041>\nendbfrange")
    got = [r[1] for r in pdf_source.raw_content_runs(b"%PDF-1.4\n" + images + pages + many + last)]
    assert got == [f"Page {n}" for n in range(200, 260)] + [f"line {i}" for i in range(21_000)] + ["ABC"]

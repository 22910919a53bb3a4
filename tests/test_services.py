"""Options that act: PDF choice, recognition, models, filters, and media of several documents."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom import __main__ as cli
from docloom.integrations import plugins
from docloom.integrations.services import Services
from docloom.operators import office, report
from docloom.options import Options
from docloom.plans.convert import convert
from docloom.sources import files, packages, sinks
from docloom.sources import pdf as pdf_source


def rows(spark, *named):
    return spark.createDataFrame([(i, n, len(c), c) for i, (n, c) in enumerate(named)], "doc_id long, name string, length long, content binary")


def package(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members.items():
            z.writestr(n, c)
    return out.getvalue()


def pdf_of(text, tail=b""):
    return b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(b"BT /F1 12 Tf 10 700 Td (" + text.encode("latin-1", "replace") + b") Tj ET") + b"\nendstream endobj\n" + tail


WORD = '<w:document><w:body><w:p><w:r><w:t>Body {}</w:t></w:r></w:p><w:p><a:blip r:embed="r1"/></w:p></w:body></w:document>'
RELS = '<R Id="r1" Target="media/image1.png"/>'


def test_two_documents_with_one_picture_name(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    for d in ("a", "b"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "same.docx").write_bytes(package(**{"word/document.xml": WORD.format(d), "word/_rels/document.xml.rels": RELS, "word/media/image1.png": d.encode()}))
    out = tmp_path / "out"
    assert cli.main([str(tmp_path / "in"), "--recursive", "-o", str(out), "--extract-media"]) == 0
    texts = [p.read_text() for p in sorted(out.glob("*.md"))]
    pictures = {p.relative_to(out).as_posix(): p.read_bytes() for p in out.rglob("image1.png")}
    assert len(texts) == 2 and sorted(pictures.values()) == [b"a", b"b"]
    for name, data in pictures.items():
        assert any(f"Body {data.decode()}" in t and f"]({out}/{name})" in t for t in texts)
    twice = spark.createDataFrame([("x", "1"), ("x", "2")], "file string, text string")
    with pytest.raises(ValueError, match="x"):
        sinks.write_files(twice, str(out), "file", "text")


@pytest.mark.parametrize(("name", "part", "xml", "word"), [
    ("a.docx", "word/document.xml", "<w:document><w:body><w:p><w:r><w:t>good{}</w:t></w:r></w:p></w:body></w:document>", "good"),
    ("a.pptx", "ppt/slides/slide1.xml", "<p:sld><a:p><a:t>good{}</a:t></a:p></p:sld>", "good"),
    ("a.xlsx", "xl/worksheets/sheet1.xml", '<worksheet><row><c r="A1" t="inlineStr"><is><t>good{}</t></is></c><c r="B1"><v>1</v></c></row></worksheet>', "good"),
    ("a.odt", "content.xml", "<office:text><text:p>good{}</text:p></office:text>", "good"),
])
def test_bad_bytes_are_a_warning(spark, name, part, xml, word):
    c = convert(rows(spark, (name, package(**{part: xml.replace("{}", "@").encode().replace(b"@", b"\xff")}))), formats=[name[2:]])
    assert word + "\ufffd" in c.results().first().markdown
    assert f"bytes that are no UTF-8 were replaced in {part}" in {r.warning for r in c.warnings.collect()}


def test_bad_bytes_in_side_parts(spark):
    c = convert(rows(spark, ("a.docx", package(**{"word/document.xml": WORD.format("x"), "word/_rels/document.xml.rels": RELS.encode() + b"\xfe", "word/footnotes.xml": b"\xff", "word/comments.xml": b"\xff"}))), formats=["docx"])
    assert "Body x" in c.results().first().markdown and c.warnings.filter("stage = 'package'").count() == 3
    parts = packages.parts(rows(spark, ("a.xlsx", package(**{"xl/sharedStrings.xml": b"\xff<si><t>s</t></si>", "xl/worksheets/sheet1.xml": '<worksheet><row><c r="A1" t="s"><v>0</v></c></row></worksheet>'}))))
    assert office.sheet_blocks(parts).count() == 1


def test_pdf_choice_and_refusal(spark):
    good, odd = pdf_of("A sentence of plain words."), pdf_of("x")
    mojibake = b"%PDF\nBT\n(" + ("α" * 150).encode() + b") Tj\nET\n"
    c = convert(rows(spark, ("good.pdf", good), ("empty.pdf", b"%PDF /Subtype /Image"), ("odd.pdf", odd), ("greek.pdf", mojibake), ("locked.pdf", b"%PDF /Encrypt /Filter/Standard /P -4")), formats=["pdf"])
    got = {r.name: (r.status, r.error) for r in c.results().collect()}
    assert got["good.pdf"] == ("ok", None) and got["odd.pdf"] == ("ok", None)
    assert got["empty.pdf"] == ("error", "ocr_required image_only") and got["greek.pdf"][0] == "error"
    assert got["locked.pdf"][1] == "the PDF has a Standard security handler and may be permission-restricted"


def test_recognized_pages_in_a_conversion(spark):
    recognize = lambda image: image.decode() + "\nread by a machine"
    s = Services(recognize=recognize, rasterize=lambda data: [b"Page one", b"Page two"])
    c = convert(rows(spark, ("scan.pdf", b"%PDF /Subtype /Image"), ("text.pdf", pdf_of("Native text of the first page"))), Options(ocr="mine"), ["pdf"], services=s)
    got = {r.name: (r.status, r.markdown) for r in c.results().collect()}
    assert got["scan.pdf"][0] == "ok" and "Page one" in got["scan.pdf"][1] and "Page two" in got["scan.pdf"][1]
    assert "Native text of the first page" in got["text.pdf"][1] and "Page one" not in got["text.pdf"][1] and "Page two" in got["text.pdf"][1]
    with pytest.raises(ValueError, match="ocr needs"):
        convert(rows(spark, ("a.pdf", b"")), Options(ocr="mine"))


def test_models_in_a_conversion(spark):
    calls = spark.sparkContext.accumulator(0)

    def provider(request):
        calls.add(1)
        if request["images"]:
            return "# A red square"
        return request["input"].split("\n\n", 1)[1].replace("words", "Worte")

    docs = rows(spark, ("a.html", b"<h1>T</h1><p>some words here</p>"), ("b.docx", package(**{"word/document.xml": WORD.format("words")})), ("c.png", b"\x89PNG"))
    c = convert(docs, Options(llm="ollama", translate="de"), ["html", "docx", "png"], services=Services(provider=provider))
    got = {r.name: r.markdown for r in c.results().collect()}
    assert "some Worte here" in got["a.html"] and "Body words" in got["b.docx"] and "A red square" in got["c.png"]
    assert "+some Worte here" in c.diffs.first().diff
    assert calls.value == 2  # the package is never sent, and no call is made twice
    silent = convert(docs, Options(llm="openai", translate="de"), ["html"], services=Services(provider=provider)).results().collect()
    assert calls.value == 2 and any("some words here" in r.markdown for r in silent)
    for o in (Options(llm="ollama"), Options(restructure=True), Options(translate="de")):
        with pytest.raises(ValueError, match="need a provider"):
            convert(docs, o)
    plugins.register(plugins.Manifest("no-headings", "1"), lambda b: b.filter("kind <> 'heading'"))
    assert "# T" not in convert(docs, Options(), ["html"], services=Services(filters=("no-headings",))).results().filter("doc_id = 0").first().markdown


def test_flags_act_or_fail(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("HOME", str(tmp_path))
    (tmp_path / "a.html").write_text("<p>x.</p>")
    assert cli.main([str(tmp_path / "a.html"), "--llm", "ollama:m"]) == 2 and "need a provider" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "a.html"), "--ocr", "on"]) == 2


def test_an_extractor_that_does_not_end(spark):
    import time

    with pytest.raises(TimeoutError):
        pdf_source.limited(lambda data: time.sleep(5), 0.05)(b"")
    fonts = pdf_source.font_map_runs(pdf_of("no map"))
    assert fonts == [] and pdf_source.page_texts(pdf_of("one page")) == ["one page"]


def test_text_helpers_of_sources(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "path string, n int, v string")
    assert {r.path: r.v for r in files.last_by_path(t, "n").collect()} == {"a": "z", "b": "y"}
    assert report.media_file(F.lit(1), F.lit("a/b.png")) is not None

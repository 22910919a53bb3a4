import io
import json
import sys
import tarfile

from docloom.operators import corpus, evaluation
from docloom.sources import inspected

from .test_services import package


def test_golden_report(spark):
    df = spark.createDataFrame([("a", "x\n", "x\n", ""), ("b", "x\n", "y\n", 'd"iff'), ("c", "# h\nz\n", "# h\nz\n", "p")], "fixture string, expected string, actual string, diff_path string")
    text = evaluation.golden_report(df).first().json
    got = json.loads(text)
    assert got["summary"] == {"total_fixtures": 3, "passed": 1, "failed": 2, "lint_total_errors": 1} and text.endswith("}\n")
    assert got["failures"] == [{"fixture": f, "metric": "golden", "score": 0.0, "expected": 1.0, "diff_path": p} for f, p in (("b", 'd"iff'), ("c", "p"))]
    assert json.loads(evaluation.golden_report(df.limit(0)).first().json)["summary"]["total_fixtures"] == 0


def test_tools_with_a_time_limit(spark):
    code = "import sys,time; t=open(sys.argv[1]).read(); time.sleep(9) if t=='slow' else None; sys.exit(3) if t=='bad' else open(sys.argv[2],'w').write('# '+t)"
    files = spark.createDataFrame([("a.txt", b"fine"), ("b.txt", b"slow"), ("c.txt", b"bad")], "path string, content binary")
    runs = evaluation.run_tool(files, "mine", [sys.executable, "-c", code, "{input}", "{output}"], seconds=3).collect()
    got = {r.path: (r.status, r.markdown, r.error) for r in runs}
    assert got == {"a.txt": ("ok", "# fine", None), "b.txt": ("timeout", None, "timeout"), "c.txt": ("error", None, "exit code 3")}
    inventory = corpus.inventory(spark.createDataFrame(runs))
    assert {r.path: r.status for r in inventory.collect()} == {"a.txt": "ok", "b.txt": "timeout", "c.txt": "error"}
    rows = spark.createDataFrame([("error", "Unsupported input format: x"), ("ok", ""), ("error", "other")], "status string, error string")
    assert evaluation.counts_where(rows, unsupported=evaluation.UNSUPPORTED, ok="status = 'ok'").first().asDict() == {"unsupported": 1, "ok": 1}


def test_timing_and_fixture_plan(spark):
    got = json.loads(evaluation.timed(lambda: spark.range(3), "x", 24, 2))
    assert (got["input"], got["iterations"], got["bytes"]) == ("x", 2, 24) and got["elapsed_ms"] >= 0
    plan = evaluation.fixture_plan(spark, {"s1": "ある", "s2": "text"}, ["mincho", "gothic"]).collect()
    assert len(plan) == 8 and {(r.id, r.png) for r in plan} >= {("s1-mincho-v", "s1-mincho-v.png")}


def test_source_texts(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for n, c in (("a.txt", b"in a tar"), ("b.bin", b"\xff")):
            info = tarfile.TarInfo(n)
            info.size = len(c)
            t.addfile(info, io.BytesIO(c))
    rows = [
        ("a.docx", package(**{"word/document.xml": "<d><t>one</t><t>two</t></d>"}), ("package-xml", "one\ntwo", False)),
        ("a.pptx", package(**{f"ppt/slides/slide{i}.xml": f"<s><t>slide {i}</t></s>" for i in (10, 2)}), ("package-xml", "slide 2\nslide 10", False)),
        ("a.xlsx", package(**{"xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><c t="s"><v>0</v></c><c><v>7</v></c></w>'}), ("sheet-cells", "shared\n7", False)),
        ("a.zip", package(**{"x.txt": "plain", "y.xml": "<a>b</a>", "z.png": "no", "long.txt": "l" * 300_000}), ("zip", "x.txt\nplain\ny.xml\nb\nz.png\nlong.txt\n" + "l" * 200_000, True)),
        ("a.tgz", tar.getvalue(), ("tar", "a.txt\nin a tar\nb.bin", False)),
        ("a.md", "tëxt".encode(), ("text", "tëxt", False)), ("a.bin", b"\xff", ("unsupported", "", False)),
    ]
    df = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(rows)] + [(99, "bad.docx", b"no zip")], "doc_id long, name string, content binary")
    got = {r.doc_id: (r.method, r.text, r.cut) for r in inspected.source_texts(df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(rows)} | {99: ("error", "", False)}

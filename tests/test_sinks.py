from pyspark.sql import functions as F

from docloom import __main__ as cli
from docloom.operators import corpus
from docloom.sources import pdf as pdf_source
from docloom.sources import sinks


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>One</h1><p>text.</p>")
    (tmp_path / "in" / "b.md").write_text("two\n")
    assert cli.main([str(tmp_path / "in"), "--flavor", "gfm"]) == 0
    assert capsys.readouterr().out == "# One\n\ntext.\ntwo\n"
    assert cli.main([str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--tables", str(tmp_path / "tables")]) == 0
    assert (tmp_path / "out" / "a.html.md").read_text() == "# One\n\ntext.\n"
    assert spark.read.parquet(str(tmp_path / "tables" / "blocks")).count() == 3
    assert cli.main([str(tmp_path / "in"), "--extract-media"]) == 2
    (tmp_path / "in" / "c.zip").write_text("x")
    assert cli.main([str(tmp_path / "in"), "--strict"]) == 1


def test_reports(spark):
    a = spark.createDataFrame([(f"p{i}", "ok" if i % 3 else "error") for i in range(90)], "path string, status string")
    b = spark.createDataFrame([(f"p{i}", "ok" if i % 2 else "error") for i in range(90)], "path string, status string")
    text = sinks.comparison_report(corpus.paired(a, b), limit=5)
    assert "| both_ok | 30 |" in text and "- 25 more" in text
    src = spark.createDataFrame([("p", "some plain words here " * 30)], "path string, text string")
    i = sinks.inspection(src, src.withColumnRenamed("text", "markdown"))
    r = i.first()
    assert (r.language_status, r.content_status, r.overlap, r.char_ratio) == ("pass", "pass", 1.0, 1.0)
    assert sinks.review_samples(i).count() == 1


def test_probes(spark):
    df = spark.createDataFrame([(1, b"%PDF\nBT\n(hi there) Tj\nET\n"), (2, b"")], "doc_id long, content binary")
    got = {(r.doc_id, r.backend): r.status for r in sinks.probe_results(pdf_source.text_objects(df, all_candidates=True)).collect()}
    assert got[1, "internal-text-objects"] == "ok" and got[2, "raw-content"] == "empty"
    assert df.filter(F.col("doc_id") == 2).count() == 1

"""Evaluation of conversions: the golden report, sums by condition, runs of other tools, timing, and the plan of recognition fixtures."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_string
from .metrics import lint


def golden_report(cases: DataFrame) -> DataFrame:
    """One row (json) over (fixture, expected, actual, diff_path): the summary and every failure, with keys in fixed order.

    A case passes if its texts are equal and its lint is clean. The row holds one entry for each failure.
    """
    met = cases.join(lint(cases.select(F.col("fixture").alias("doc_id"), F.col("actual").alias("markdown"))).withColumnRenamed("doc_id", "fixture"), "fixture")
    bad = ~((F.col("expected") == F.col("actual")) & (F.col("errors") == 0))
    one = F.concat(F.lit('{"fixture":'), json_string(F.col("fixture").cast("string")), F.lit(',"metric":"golden","score":0.0,"expected":1.0,"diff_path":'), json_string(F.col("diff_path")), F.lit("}"))
    g = met.agg(F.count("*").alias("n"), F.count_if(bad).alias("failed"), F.coalesce(F.sum("errors"), F.lit(0)).alias("lint"), F.array_sort(F.collect_list(F.when(bad, F.struct("fixture", one.alias("x"))))).alias("xs"))
    number = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    text = F.concat(
        F.lit('{"summary":{"total_fixtures":'), number("n"), F.lit(',"passed":'), number(F.col("n") - F.col("failed")), F.lit(',"failed":'), number("failed"), F.lit(',"lint_total_errors":'), number("lint"),
        F.lit('},"failures":['), F.array_join(F.transform("xs", lambda x: x["x"]), ","), F.lit("]}\n"),
    )
    return g.select(text.alias("json"))


def counts_where(rows: DataFrame, **conditions: str) -> DataFrame:
    """One row with the number of rows that meet each SQL condition, by name."""
    return rows.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()])


#: A tool that was refused a format, as inventories say it.
UNSUPPORTED = "status = 'error' AND error LIKE 'Unsupported input format:%'"


def run_tool(files: DataFrame, tool: str, command: list[str], seconds: float = 60.0) -> DataFrame:
    """Rows (path, tool, status, bytes, elapsed_ms, markdown, error) of a command run on each file (path, content).

    ``command`` gets ``{input}``, ``{output}`` and ``{report}`` as paths that exist while it runs. What takes longer than ``seconds`` is
    killed and has status and error ``timeout``, so ``corpus.inventory`` takes the rows as they are.
    """

    def one(path: str, content: bytes) -> tuple[str, str | None, int, str | None]:
        began = time.monotonic()
        with tempfile.TemporaryDirectory() as d:  # for this call alone
            names = {"{input}": os.path.join(d, "in-" + os.path.basename(path)), "{output}": os.path.join(d, "out.md"), "{report}": os.path.join(d, "report.json")}
            with open(names["{input}"], "wb") as f:
                f.write(content)
            spent = lambda: int((time.monotonic() - began) * 1000)
            try:
                done = subprocess.run([names.get(w, w) for w in command], capture_output=True, timeout=seconds, check=False)
            except subprocess.TimeoutExpired:
                return "timeout", None, spent(), "timeout"
            except OSError as e:
                return "error", None, spent(), f"{type(e).__name__}: {e}"
            if done.returncode or not os.path.exists(names["{output}"]):
                return "error", None, spent(), done.stderr.decode("utf-8", "replace").strip() or f"exit code {done.returncode}"
            with open(names["{output}"], encoding="utf-8", errors="replace", newline="") as f:
                return "ok", f.read(), spent(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                status, text, ms, error = one(path, content.as_py() or b"")
                row = (path, tool, status, len((text or "").encode()), ms, text, error)
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["path", "tool", "status", "bytes", "elapsed_ms", "markdown", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, tool string, status string, bytes long, elapsed_ms long, markdown string, error string")


def timed(make: Callable[[], DataFrame], name: str, size: int, iterations: int = 10) -> str:
    """A JSON line (input, iterations, elapsed_ms, bytes) about so many runs of what ``make`` plans; results are thrown away."""
    began = time.monotonic()
    for _ in range(max(1, iterations)):
        make().write.format("noop").mode("overwrite").save()
    return json.dumps({"input": name, "iterations": max(1, iterations), "elapsed_ms": int((time.monotonic() - began) * 1000), "bytes": size}, separators=(",", ":"))


def fixture_plan(spark: SparkSession, samples: dict[str, str], fonts: list[str], orientations: tuple[str, ...] = ("horizontal", "vertical"), language: str = "ja") -> DataFrame:
    """The manifest of recognition fixtures: a row for each sample, font and orientation, with its file names and the text to be read."""
    s = spark.createDataFrame(sorted(samples.items()), "sample string, text string")
    f = spark.createDataFrame([(x,) for x in fonts], "font string")
    o = spark.createDataFrame([(x,) for x in orientations], "orientation string")
    plan = s.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(o))  # small literal tables
    name = F.concat_ws("-", "sample", "font", F.substring("orientation", 1, 1))
    return plan.select(name.alias("id"), "sample", "font", "orientation", F.lit(language).alias("language"), *[F.concat(name, F.lit(e)).alias(n) for n, e in (("png", ".png"), ("pdf", ".pdf"), ("gt", ".gt.txt"))], "text")

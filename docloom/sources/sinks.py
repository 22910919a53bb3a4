"""Where results go: tables, a file per document, media files, and short Markdown reports of aggregates."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..operators import corpus


def write_tables(conversion, path: str, mode: str = "overwrite") -> None:
    """A conversion's relations as Parquet below ``path``."""
    for name, df in (("results", conversion.results()), ("blocks", conversion.blocks), ("warnings", conversion.warnings), ("reports", conversion.report_json())):
        df.write.mode(mode).parquet(f"{path}/{name}")


def file_names(df: DataFrame, name: str, doc: str = "doc_id") -> DataFrame:
    """``df`` with ``file``: a safe base name of ``name``; where several documents would have one, each gets its id in front of it."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*\z", 1), r"[^\p{L}\p{N}._-]", "_")
    named = df.withColumn("file", F.when(base.isin("", ".", ".."), "_").otherwise(base))
    return named.withColumn("file", F.when(F.count("*").over(Window.partitionBy("file")) > 1, F.concat(F.col(doc).cast("string"), F.lit("-"), "file")).otherwise(F.col("file")))


def write_files(df: DataFrame, folder: str, path: str, content: str) -> None:
    """A file for each row at ``folder``/``path``, by the executors: a folder that they share, or a URI of a file system that they reach.

    Two rows of one path are an error, found before anything is written.
    """
    twice = df.groupBy(path).agg(F.count("*").alias("n")).filter("n > 1").select(path).limit(3).collect()
    if twice:
        raise ValueError(f"several files would be called {', '.join(r[0] for r in twice)}")

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        for r in rows:
            target = f"{root}/{r[0]}"
            head, _, name = target.rpartition("/")
            system.create_dir(head, recursive=True)
            data = r[1].encode() if isinstance(r[1], str) else bytes(r[1])
            with system.open_output_stream(f"{head}/.{name}.part") as f:
                f.write(data)
            system.move(f"{head}/.{name}.part", target)  # whole or not at all, also when a task is tried again

    df.select(path, content).foreachPartition(write)


def comparison_report(pairs: DataFrame, limit: int = 50) -> str:
    """Markdown of paired inventories: counts by outcome and the first paths that only one tool converted."""
    counts = {r["outcome"]: r["n"] for r in corpus.status_counts(pairs, "outcome").collect()}
    lines = ["# Comparison", "", "| outcome | files |", "| --- | --- |", *[f"| {k} | {counts[k]} |" for k in sorted(counts)], ""]
    for outcome in ("a_only", "b_only"):
        first, more = corpus.first_of(pairs.filter(F.col("outcome") == outcome), limit, "path")
        rows, left = first.collect(), more.first()["remaining"]
        if rows:
            lines += [f"## {outcome}", "", *[f"- {r['path']}" for r in rows], *([f"- {left} more"] if left else []), ""]
    return "\n".join(lines)


def inspection(sources: DataFrame, markdown: DataFrame) -> DataFrame:
    """Rows of an inspection: languages, lengths, overlap and their statuses for (path, text) joined with (path, markdown)."""
    m = sources.select("path", "text").join(markdown.select("path", "markdown"), "path")
    m = m.select("path", corpus.language_of(F.col("text")).alias("source_language"), corpus.language_of(F.col("markdown")).alias("markdown_language"), F.length("text").alias("source_chars"), F.length("markdown").alias("markdown_chars"), corpus.shingle_overlap(F.col("text"), F.col("markdown")).alias("overlap"))
    return m.select(
        "*", F.round(F.col("markdown_chars") / F.greatest("source_chars", F.lit(1)), 4).alias("char_ratio"), corpus.language_status(F.col("source_language"), F.col("markdown_language")).alias("language_status"),
        corpus.content_status(F.col("source_chars"), F.col("markdown_chars"), F.col("overlap")).alias("content_status"),
    )


def review_samples(inspected: DataFrame, per_bucket: int = 10) -> DataFrame:
    """The first rows of each status pair, for people to read."""
    bucket = F.concat_ws("/", "language_status", "content_status")
    return corpus.first_per_bucket(inspected.withColumn("bucket", bucket), "bucket", per_bucket, "path")


def probe_results(runs: DataFrame) -> DataFrame:
    """Rows (doc_id, backend, status, chars, pages) of PDF extractors over (doc_id, backend, failed, page, text)."""
    g = runs.groupBy("doc_id", "backend").agg(F.bool_or("failed").alias("failed"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_distinct("page").alias("pages"))
    return g.select("doc_id", "backend", F.when(F.col("failed"), "error").when(F.col("chars") == 0, "empty").otherwise("ok").alias("status"), "chars", "pages")

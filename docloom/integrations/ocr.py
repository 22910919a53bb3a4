"""Text recognition as a pluggable step: any function of image bytes, or a command. Nothing runs unless it is asked for."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Recognizer = Callable[[bytes], str]
# Arguments of known commands; {} is the image's path.
COMMANDS = {"tesseract": ["tesseract", "{}", "stdout"], "ndlocr-lite": ["ndlocr-lite", "{}"], "ndl-koten": ["ndl-koten-ocr", "{}"], "surya": ["surya_ocr", "{}"]}


def command_recognizer(engine: str, timeout: float = 60.0) -> Recognizer:
    """A recognizer that runs an engine's command on a temporary file; its exit code does not matter, its output does."""
    words = COMMANDS.get(engine, [engine, "{}"])

    def recognize(image: bytes) -> str:
        with tempfile.NamedTemporaryFile(suffix=".png", delete=False) as f:
            f.write(image)
        try:
            return subprocess.run([w.replace("{}", f.name) for w in words], capture_output=True, timeout=timeout, check=False).stdout.decode("utf-8", "replace")
        finally:
            os.unlink(f.name)

    return recognize


def recognized(images: DataFrame, recognize: Recognizer) -> DataFrame:
    """Rows (doc_id, page, text, error) for images (doc_id, page, content); a failure is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple[str | None, str | None]] = []
            for content in b.column(2).to_pylist():
                try:
                    got.append((recognize(content), None))
                except Exception as e:  # noqa: BLE001
                    got.append((None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["doc_id", "page", "text", "error"])

    return images.select("doc_id", "page", "content").mapInArrow(run, "doc_id long, page int, text string, error string")


def rasterized(files: DataFrame, rasterize: Callable[[bytes], list[bytes]]) -> DataFrame:
    """Rows (doc_id, page, content) of page images of files (doc_id, content); a file that cannot be drawn has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    pages = rasterize(content.as_py() or b"")
                except Exception:  # noqa: BLE001  the file stays without recognized pages and says so in its status
                    pages = []
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(pages), pa.int64()), pa.array(range(len(pages)), pa.int32()), pa.array(pages, pa.binary())], names=["doc_id", "page", "content"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, page int, content binary")


def pages_to_read(pages: DataFrame, whole_documents: DataFrame) -> DataFrame:
    """Pages (doc_id, page, lines) without text, and all pages of documents (doc_id) that need recognition."""
    blank = pages.filter("size(lines) = 0")
    return blank.unionByName(pages.join(whole_documents, "doc_id", "left_semi")).select("doc_id", "page").distinct()

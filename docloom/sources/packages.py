"""Zip packages as relations: a row per part. Only wanted members are read, each package once."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PARTS = "doc_id long, part string, content binary, error string"
WANTED = r"word/(document|footnotes|comments)\.xml|word/_rels/document\.xml\.rels|ppt/slides/(_rels/)?slide([1-9]|[1-9][0-9]|1[0-9][0-9]|200)\.xml(\.rels)?|xl/(sharedStrings|worksheets/sheet([1-9]|[1-9][0-9]|1[0-9][0-9]|200))\.xml|content\.xml"
MEDIA = r"(word|ppt|xl)/media/.*"


def parts(files: DataFrame, wanted: str = WANTED, id_col: str = "doc_id", content_col: str = "content", most_bytes: int | None = None) -> DataFrame:
    """Rows (doc_id, part, content, error) of the members of each package whose names match; a bad package is a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = re.compile(wanted)
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, data = [], content.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        names = [n for n in z.namelist() if match.fullmatch(n)]
                        rows = [(doc, n, z.open(n).read(most_bytes if most_bytes else -1), None) for n in names]
                except (zipfile.BadZipFile, KeyError, OSError, RuntimeError) as e:
                    rows = [(doc, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.binary(), pa.string())], names=["doc_id", "part", "content", "error"])

    return files.select(id_col, content_col).mapInArrow(run, PARTS)

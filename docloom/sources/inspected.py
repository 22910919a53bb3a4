"""Texts of sources by other means than the conversion, to compare conversions with: package parts, spreadsheet cells, archive listings."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

#: Members of an archive that are listed, and bytes of a member that are read; ``cut`` says where more were left out.
MOST_MEMBERS, MOST_BYTES = 500, 200_000
# Extensions of members that are texts.
TEXT_MEMBERS = (".md", ".txt", ".csv", ".json", ".html", ".htm", ".yaml", ".yml", ".toml", ".ini", ".py", ".rs", ".js", ".ts")


def xml_text(data: bytes) -> str:
    """The texts of an XML document, a line each; what is no XML stays as it is."""
    try:
        return "\n".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())
    except ElementTree.ParseError:
        return data.decode("utf-8", "replace")


def _number(name: str) -> int:
    found = re.search(r"(\d+)\.xml$", name)
    return int(found[1]) if found else 0


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=_number)


def _sheets(z: zipfile.ZipFile) -> str:
    local = lambda e: e.tag.rpartition("}")[2]
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"]
    out = []
    for n in _parts(z, r"xl/worksheets/sheet\d+\.xml"):
        for c in ElementTree.fromstring(z.read(n)).iter():
            if local(c) == "c":
                v = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                out.append(strings[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(strings) else v)
    return "\n".join(x for x in out if x)


def _members(names: list, read) -> tuple[str, bool]:
    out, cut = [], len(names) > MOST_MEMBERS
    for n in names[:MOST_MEMBERS]:
        out.append(n)
        if n.lower().endswith((*TEXT_MEMBERS, ".xml")):
            data = read(n)
            cut |= len(data) > MOST_BYTES
            data = data[:MOST_BYTES]
            out.append(xml_text(data) if n.lower().endswith(".xml") else data.decode("utf-8", "replace"))
    return "\n".join(out), cut


def text_of(name: str, data: bytes) -> tuple[str, str, bool]:
    """(method, text, cut) of a file."""
    low = name.lower()
    if low.endswith((".docx", ".pptx", ".potx", ".xlsx", ".xlsm", ".odt", ".ods", ".odp")):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if low.endswith((".xlsx", ".xlsm")):
                return "sheet-cells", _sheets(z), False
            pattern = r"word/document\.xml" if low.endswith(".docx") else r"content\.xml" if low.endswith((".odt", ".ods", ".odp")) else r"ppt/slides/slide\d+\.xml"
            return "package-xml", "\n".join(xml_text(z.read(n)) for n in _parts(z, pattern)), False
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return "zip", *_members(z.namelist(), lambda n: z.open(n).read(MOST_BYTES + 1))
    if low.endswith((".tar", ".tar.gz", ".tgz", ".gz")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return "tar", *_members([m.name for m in t.getmembers()], lambda n: f.read(MOST_BYTES + 1) if (f := t.extractfile(n)) else b"")
    try:
        return "text", data.decode("utf-8"), False
    except UnicodeDecodeError:
        return "unsupported", "", False


def source_texts(files: DataFrame) -> DataFrame:
    """Rows (doc_id, method, text, cut, error) of files (doc_id, name, content); a broken file is a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                try:
                    method, text, cut, error = *text_of(name, content.as_py() or b""), None
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    method, text, cut, error = "error", "", False, f"{type(e).__name__}: {e}"
                row = (doc, method, text, cut, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["doc_id", "method", "text", "cut", "error"])

    return files.select("doc_id", "name", "content").mapInArrow(run, "doc_id long, method string, text string, cut boolean, error string")

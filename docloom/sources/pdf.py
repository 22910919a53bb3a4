"""Text runs of PDF files, a row each. Byte-level parsing is Python over Arrow batches; structure is ``operators.pdf``."""

from __future__ import annotations

import hashlib
import re
import signal
import threading
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Run = tuple[int, str, float | None, float | None, float | None]  # page, text, font size, x, y
MOST_BYTES, SMALL = 16 << 20, 2 << 20

_STRING = re.compile(r"\((?:[^()\\]|\\.)*\)?|<(?!<)[^>]*>?", re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _literal(s: str) -> str:
    body = s[1:-1] if s.endswith(")") and not s.endswith("\\)") else s[1:]
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def _hex_bytes(s: str) -> bytes:
    digits = re.sub(r"[^0-9a-fA-F]", "", s)
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


def _plain_decode(b: bytes) -> str:
    if b[:2] == b"\xfe\xff":
        return b[2:].decode("utf-16-be", "replace")
    if len(b) >= 2 and not any(b[::2]):
        return b.decode("utf-16-be", "replace")
    return b.decode("utf-8", "replace")


def internal_runs(data: bytes) -> list[Run]:
    """Runs of uncompressed text blocks, line by line: the last font size, the last offsets as written."""
    out: list[Run] = []
    for m in re.finditer(r"BT(.*?)ET", data.decode("utf-8", "replace"), re.S):
        block = m[1]
        n, bad = max(len(block), 1), block.count("�")
        controls = sum(1 for c in block if (ord(c) < 32 or 127 <= ord(c) < 160) and c not in "\n\r\t")
        if (bad > 20 and bad * 20 > n) or controls * 10 > n:
            continue
        size = x = y = None
        for line in block.split("\n"):
            t = line.split()
            if (i := t.index("Tf") if "Tf" in t else 0) > 0:
                size = _number(t[i - 1], size)
            i = next((i for i, w in enumerate(t) if w in ("Td", "TD")), 0)
            if i >= 2 and _number(t[i - 2]) is not None and _number(t[i - 1]) is not None:
                x, y = _number(t[i - 2]), _number(t[i - 1])
            text = "".join(_literal(s) if s[0] == "(" else _plain_decode(_hex_bytes(s)) for s in _STRING.findall(line)).strip()
            if text:
                out.append((0, text, size, x, y))
    return out


def _number(s: str, default: float | None = None) -> float | None:
    try:
        return float(s)
    except ValueError:
        return default


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


# Fixed value: the padding of the standard security handler.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def file_key(data: bytes) -> bytes | None:
    """The 40-bit key of the standard handler, revision 2, with an empty password; None if the file is not so encrypted."""
    if b"/Encrypt" not in data or not re.search(rb"/R\s+2\b", data) or not re.search(rb"/V\s+1\b", data):
        return None
    owner, rights = re.search(rb"/O\s*(\((?:[^()\\]|\\.)*\)|<[0-9a-fA-F\s]*>)", data, re.S), re.search(rb"/P\s+(-?\d+)", data)
    first = re.search(rb"/ID\s*\[\s*(\((?:[^()\\]|\\.)*\)|<[0-9a-fA-F\s]*>)", data, re.S)
    if not (owner and rights):
        return None
    raw = lambda m: b"" if not m else _hex_bytes(m[1].decode()) if m[1][:1] == b"<" else _literal(m[1].decode("latin-1")).encode("latin-1")
    return hashlib.md5(PAD + raw(owner)[:32] + (int(rights[1]) & 0xFFFFFFFF).to_bytes(4, "little") + raw(first)).digest()[:5]


def streams(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(object number, dictionary, decoded bytes) of each stream in order, images apart; one is decoded at a time."""
    key = file_key(data)
    for m in re.finditer(rb"(\d+)\s+(\d+)\s+obj\b((?:(?!endobj).){0,2000}?)stream\r?\n", data, re.S):
        if b"/Subtype/Image" in m[3].replace(b" ", b""):
            continue
        end = data.find(b"endstream", m.end())
        body = data[m.end() : end if end >= 0 else len(data)]
        if key:
            number, generation = int(m[1]), int(m[2])
            body = rc4(hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little")).digest()[:10], body.rstrip(b"\r\n"))
        if b"FlateDecode" in m[3]:
            try:
                body = zlib.decompressobj().decompress(body, MOST_BYTES)
            except zlib.error:
                continue
        yield int(m[1]), m[3], body[:MOST_BYTES]


def unicode_maps(all_streams: Iterable[tuple[int, bytes, bytes]]) -> dict[int, dict[int, str]]:
    """Code to text of each ToUnicode stream, by object number."""
    out = {}
    for number, _, body in all_streams:
        if b"beginbf" not in body:
            continue
        text, table = body.decode("latin-1"), {}
        to = lambda h: _hex_bytes(h).decode("utf-16-be", "replace")
        for part in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
            table |= {int(a, 16): to(b) for a, b in re.findall(r"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F\s]*)>", part)}
        for part in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
            for a, b, c in re.findall(r"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>", part):
                base = to(c)
                table |= {int(a, 16) + i: base[:-1] + chr(ord(base[-1]) + i) for i in range(min(int(b, 16) - int(a, 16) + 1, 65_536)) if base}
        out[number] = table
    return out


def _font_tables(data: bytes, maps: dict[int, dict[int, str]]) -> dict[str, dict[int, str]]:
    """Tables by the names that pages give to fonts."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.{0,4000}?)(?:endobj|stream)", data, re.S)}
    to = {n: int(m[1]) for n, body in objects.items() if (m := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body))}
    names = {}
    for m in re.finditer(rb"/([A-Za-z0-9_.+-]+)\s+(\d+)\s+\d+\s+R", data):
        if int(m[2]) in to and to[int(m[2])] in maps:
            names[m[1].decode("latin-1")] = maps[to[int(m[2])]]
    return names


def decoded(b: bytes, table: dict[int, str] | None, encoding: str | None = None) -> str:
    """A shown string: by its font's map, as UTF-16 or Shift-JIS, or as text."""
    if table:
        wide = max(table) > 255
        codes = [int.from_bytes(b[i : i + 2], "big") for i in range(0, len(b) - 1, 2)] if wide else list(b)
        return "".join(table.get(c, "�") for c in codes)
    if encoding:
        return b.decode(encoding, "replace")
    if b[:2] == b"\xfe\xff" or len(b) >= 2 and not any(b[::2]):
        return _plain_decode(b)
    for codec in ("utf-8", "shift_jis", "latin-1"):
        try:
            return b.decode(codec)
        except UnicodeDecodeError:
            pass
    return ""


_OPERATOR = re.compile(rb"\((?:[^()\\]|\\.)*\)|<(?!<)[0-9a-fA-F\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)


def raw_content_runs(data: bytes, mapped_only: bool = False) -> list[Run]:
    """Runs of decompressed content streams, a line each; with ``mapped_only`` only strings in fonts with a Unicode map."""
    fonts, out, page = _font_tables(data, unicode_maps(streams(data))), [], -1
    for _, _, body in streams(data):  # read again, so that no more than one is held
        if not re.search(rb"\bBT\b", body):
            continue
        page += 1
        stack: list[bytes] = []
        table = size = x = y = encoding = None
        line: list[str] = []

        def flush() -> None:
            text = "".join(line).strip()
            if text:
                out.append((page, text, size, x, y))
            line.clear()

        def show(t: bytes) -> None:
            if mapped_only and table is None:
                return
            raw = _hex_bytes(t.decode("latin-1")) if t[:1] == b"<" else _literal(t.decode("latin-1")).encode("latin-1", "replace")
            line.append(decoded(raw, table, encoding))

        for m in _OPERATOR.finditer(body):
            t = m[0]
            if not (t[:1].isalpha() or t in (b"'", b'"', b"T*")):
                stack.append(t)
                continue
            if t == b"Tf" and len(stack) >= 2:
                name = stack[-2].lstrip(b"/").decode("latin-1")
                table, size = fonts.get(name), _number(stack[-1].decode("latin-1"), size)
            elif t in (b"Td", b"TD") and len(stack) >= 2:
                flush()
                x, y = _number(stack[-2].decode("latin-1")), _number(stack[-1].decode("latin-1"))
            elif t in (b"T*", b"ET", b"'", b'"'):
                flush()
                if t in (b"'", b'"') and stack:
                    show(stack[-1])
            elif t == b"Tm" and len(stack) >= 6:
                flush()
                x, y = _number(stack[-2].decode("latin-1")), _number(stack[-1].decode("latin-1"))
            elif t == b"Tj" and stack:
                show(stack[-1])
            elif t == b"TJ":
                for s in stack:
                    if s[:1] in (b"(", b"<"):
                        show(s)
                    elif (n := _number(s.decode("latin-1"))) is not None and n < -200:
                        line.append(" ")
            stack.clear()
        flush()
    return out


def font_map_runs(data: bytes) -> list[Run]:
    """Runs of fonts with Unicode maps alone; none unless their text is long and plain enough to be trusted."""
    runs = raw_content_runs(data, True)
    text = "".join(t for _, t, _, _, _ in runs)
    ink = [c for c in text if not c.isspace()]
    controls = sum(1 for c in text if (ord(c) < 32 or 127 <= ord(c) < 160) and c not in "\n\r\t")
    letters = sum(1 for c in ink if c.isalpha())
    return runs if len(ink) >= 100 and controls * 20 < len(text) and letters * 3 > len(ink) else []


def page_texts(data: bytes) -> list[str]:
    """The text of each page that shows any, a line a run."""
    pages: dict[int, list[str]] = {}
    for page, text, _, _, _ in raw_content_runs(data):
        pages.setdefault(page, []).append(text)
    return ["\n".join(pages[p]) for p in sorted(pages)]


#: Extractors by name, in the order in which they are tried; in files above ``SMALL`` bytes the second comes first. Both are read
#: when a plan is made.
BACKENDS: dict[str, Callable[[bytes], list[Run]]] = {"raw-content": raw_content_runs, "font-maps": font_map_runs, "internal-text-objects": internal_runs}
ORDER = ["raw-content", "font-maps", "internal-text-objects"]


def register_backend(name: str, extract: Callable[[bytes], list[Run]], first: bool = False) -> None:
    """Add an extractor; it is tried before the others if ``first``."""
    BACKENDS[name] = extract
    ORDER.remove(name) if name in ORDER else None
    ORDER.insert(0 if first else len(ORDER), name)


def limited(extract: Callable[[bytes], list[Run]], seconds: float) -> Callable[[bytes], list[Run]]:
    """An extractor that raises ``TimeoutError`` after so many seconds; it must run in a process's main thread, as Spark's workers do."""

    def stop(*_) -> None:
        raise TimeoutError(f"stopped after {seconds} s")

    def run(data: bytes) -> list[Run]:
        if threading.current_thread() is not threading.main_thread():
            return extract(data)
        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return extract(data)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    return run


RUNS = "doc_id long, rank int, backend string, failed boolean, page int, ord int, text string, font_size double, x double, y double"


def text_objects(files: DataFrame, order: list[str] | None = None, all_candidates: bool = False, seconds: float = 120.0) -> DataFrame:
    """Rows of runs of each file (doc_id, content): those of the first extractor that finds any, or of all.

    A file without runs has one row with a null text; an extractor that raises or takes longer than ``seconds`` is marked failed.
    """
    names_in_order = list(order or ORDER)
    chosen = {n: limited(BACKENDS[n], seconds) for n in names_in_order}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "rank", "backend", "failed", "page", "ord", "text", "font_size", "x", "y"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, rows = content.as_py() or b"", []
                now = [*names_in_order[1::-1], *names_in_order[2:]] if len(data) > SMALL else names_in_order
                for rank, name in enumerate(now):
                    try:
                        runs, failed = chosen[name](data), False
                    except Exception:  # noqa: BLE001  a broken file is a row, not a failed job
                        runs, failed = [], True
                    rows += [(doc, rank, name, failed, p, i, t, s, x, y) for i, (p, t, s, x, y) in enumerate(runs)] or [(doc, rank, name, failed, None, None, None, None, None, None)]
                    if runs and not all_candidates:
                        rows = [r for r in rows if r[1] == rank]
                        break
                else:
                    rows = rows if all_candidates else rows[-1:]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("doc_id", "content").mapInArrow(run, RUNS)

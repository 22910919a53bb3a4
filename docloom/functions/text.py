"""String functions as columns. All run inside the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space, for a Java character class.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"

# Media types by file extension.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/emf", "wmf": "image/wmf",
}


def strip_tags(s: Column) -> Column:
    """Text outside ``<...>``; an unclosed ``<`` drops the rest, a stray ``>`` goes."""
    return F.regexp_replace(s, r"<[^>]*(?:>|\z)|>", "")


def decode_entities(s: Column) -> Column:
    """The five basic entities, ``&amp;`` first, so ``&amp;lt;`` becomes ``<``."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def escape_html(s: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def escape_json(s: Column) -> Column:
    """Backslash, quote, newline, return and tab only; other control characters stay as they are."""
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(char), F.lit(escape))
    return s


def json_string(s: Column) -> Column:
    return F.concat(F.lit('"'), escape_json(s), F.lit('"'))


def json_option(s: Column) -> Column:
    return F.coalesce(json_string(s), F.lit("null"))


def json_array(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, json_string), ","), F.lit("]"))


def plain(s: Column) -> Column:
    """Text of a markup fragment."""
    return decode_entities(strip_tags(s))


def lossy_text(content: Column) -> Column:
    """Bytes as UTF-8; what is invalid is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, rf"[{SPACE}]+\z", "")


def collapse(s: Column) -> Column:
    """Words of ``s`` with one space between them."""
    return trim(F.regexp_replace(s, rf"[{SPACE}]+", " "))


def base64(b: Column) -> Column:
    return F.regexp_replace(F.base64(b), "[\r\n]", "")


def extension(name: Column) -> Column:
    """Lower-case extension of a path's last part, or an empty string; a leading dot starts no extension."""
    last = F.regexp_extract(name, r"([^/]*)/*\z", 1)
    return F.translate(F.regexp_extract(last, r"\A.+\.([^.]*)\z", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*MIME.items())])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("image/png"))


def data_uri(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), base64(content))


def is_vector_image(path: Column) -> Column:
    return extension(path).isin("wmf", "emf")


def attribute(tag: Column, name: str) -> Column:
    """The first ``name="..."`` in ``tag``, or null."""
    return F.when(tag.rlike(f'{name}="[^"]*"'), F.regexp_extract(tag, f'{name}="([^"]*)"', 1))


def bodies(s: Column, tag: str) -> Column:
    """Bodies of all ``<tag ...>...</tag>``; names match by prefix, as do the markup scanners here."""
    return F.regexp_extract_all(s, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))


def lines(s: Column) -> Column:
    """Lines without their ends; a final line end starts no line."""
    each = F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    n = F.size(each)
    return F.when(F.element_at(F.split(s, "\n"), -1) == "", F.slice(each, 1, n - 1)).otherwise(each)

"""Markdown back to blocks, and blocks as the unwrapped Markdown that language models are sent."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, lines
from ..schema import BLOCK, exploded

_BLOCK_TYPE = T.ArrayType(
    T.StructType().add("kind", "string").add("level", "integer").add("text", "string").add("ordered", "boolean")
    .add("items", T.ArrayType(T.StructType().add("kind", "string").add("text", "string")))
    .add("rows", T.ArrayType(T.StructType().add("cells", T.ArrayType(T.StructType().add("text", "string").add("rowspan", "integer").add("colspan", "integer").add("image", "string")))))
    .add("alt", "string").add("path", "string").add("title", "string").add("language", "string").add("label", "string")
)
_HEADING = re.compile(r"(#{1,6}) (.*)")
_IMAGE = re.compile(r"!\[(.*?)\]\((.*)\)")
_FOOTNOTE = re.compile(r"\[\^(.*?)\]:(.*)")
_LIST = re.compile(r"(?:- |([0-9]*)\. )(.*)")


def _make(kind: str, **fields) -> dict:
    return {k: fields.get(k) for k in BLOCK} | {"kind": kind}


def parse_markdown(text: str) -> list[dict]:
    """Blocks of a Markdown text, line by line."""
    out: list[dict] = []
    open_lines: list[str] = []
    fence: str | None = None

    def close(kind: str, **more) -> None:
        if open_lines or kind == "code":
            out.append(_make(kind, text="\n".join(open_lines), **more))
        open_lines.clear()

    rows = text.split("\n")
    for raw in rows[:-1] if rows[-1] == "" else rows:
        line = raw.rstrip()
        if fence is not None:
            if line == "```":
                close("code", language=fence or None)
                fence = None
            else:
                open_lines.append(line)
        elif line.startswith("```"):
            close("paragraph")
            fence = line[3:].strip()
        elif not line:
            close("paragraph")
        elif found := _one_line(line, out[-1] if out and not open_lines else None):
            close("paragraph")
            if found is not _NOTHING:
                out.append(found)
        else:
            open_lines.append(line)
    close("paragraph") if fence is None else close("code", language=fence or None)
    return out


#: A line that was added to the last block, or that shows nothing.
_NOTHING: dict = {"kind": None}


def _one_line(line: str, last: dict | None) -> dict | None:
    """The block of one line, ``_NOTHING``, or None for a line of a paragraph."""
    if m := _HEADING.fullmatch(line):
        return _make("heading", level=len(m[1]), text=m[2].strip())
    if m := _IMAGE.fullmatch(line):
        path, quote, title = m[2].strip().partition(' "')
        return _make("image", alt=m[1], path=path.strip().strip("<>"), title=title[:-1] if quote and title.endswith('"') else None)
    if m := _FOOTNOTE.fullmatch(line):
        return _make("footnote", label=m[1], text=m[2].strip())
    if m := _LIST.fullmatch(line):
        item, ordered = {"kind": "text", "text": m[2].strip()}, m[1] is not None
        if last and last["kind"] == "list" and last["ordered"] == ordered:
            last["items"].append(item)
            return _NOTHING
        return _make("list", ordered=ordered, items=[item])
    if line.startswith("|") and line.endswith("|") and len(line) > 1:
        cells = [c.strip() for c in line.strip("|").split("|")]
        if all(set(c) <= set("-:") for c in cells):
            return _NOTHING
        row = {"cells": [{"text": c, "rowspan": 1, "colspan": 1, "image": None} for c in cells]}
        if last and last["kind"] == "table":
            last["rows"].append(row)
            return _NOTHING
        return _make("table", rows=[row])
    return None


@F.pandas_udf(_BLOCK_TYPE)
def _parse(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: parse_markdown(t or ""))


def markdown_blocks(docs: DataFrame, text_col: str = "markdown") -> DataFrame:
    """Rows (doc_id, pos, block columns) of Markdown texts."""
    return exploded(docs.select("doc_id", _parse(text_col).alias("blocks")), "blocks", "doc_id")


def block_markdown() -> Column:
    """A block, by its columns, as unwrapped Markdown."""
    k = F.col("kind")
    items = F.array_join(F.transform("items", lambda x, i: F.concat(F.when(F.col("ordered"), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x["text"])), "\n")
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r["cells"], lambda c: F.replace(c["text"], F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get("rows", F.lit(0))["cells"], lambda c: F.lit("---")), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.transform(F.slice("rows", 1, 1), row), F.array(rule), F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), row)), "\n")
    image = F.concat(F.lit("!["), F.coalesce("alt", F.lit("")), F.lit("]("), F.col("path"), F.coalesce(F.concat(F.lit(' "'), F.col("title"), F.lit('"')), F.lit("")), F.lit(")"))
    return (
        F.when(k == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
        .when(k == "list", items).when(k == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```")))
        .when(k == "table", F.when(F.size("rows") > 0, table).otherwise("")).when(k == "image", image)
        .when(k == "footnote", F.concat(F.lit("[^"), F.col("label"), F.lit("]: "), F.col("text"))).otherwise(F.coalesce("text", F.lit("")))
    )


def prompt_markdown(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, markdown): blocks with empty lines between."""
    each = blocks.select("doc_id", "pos", block_markdown().alias("md"))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"))


def line_diff(before: Column, after: Column) -> Column:
    """Lines compared place by place."""
    a, b = lines(before), lines(after)
    pad = lambda x, y: F.concat(x, F.array_repeat(F.lit(None).cast("string"), F.greatest(F.size(y) - F.size(x), F.lit(0))))
    one = lambda x, y: F.when(x == y, F.concat(F.lit(" "), x, F.lit("\n"))).otherwise(F.concat(F.coalesce(F.concat(F.lit("-"), x, F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("+"), y, F.lit("\n")), F.lit(""))))
    return F.concat(F.lit("--- before\n+++ after\n@@\n"), F.array_join(F.zip_with(pad(a, b), pad(b, a), one), ""))


def text_length(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, n): characters of the unwrapped Markdown that are no whitespace."""
    return prompt_markdown(blocks).select("doc_id", F.length(F.regexp_replace("markdown", rf"[{SPACE}]+", "")).alias("n"))

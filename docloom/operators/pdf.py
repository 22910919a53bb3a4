"""Structure of PDF text: positioned text runs (doc_id, ord, text, font_size) to blocks, by windows over each document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, lines, trim
from ..schema import BLOCK, block
from .markdown import merged_paragraphs

NOISE = "PDF parser skipped {} binary-like text fragment(s)."


def is_human_text(t: Column) -> Column:
    n = F.length(t)
    controls = F.length(t) - F.length(F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))
    return (F.regexp_count(t, F.lit("�")) < 2) & (n > 0) & (controls * 4 <= n) & ~((n > 4000) & ~t.rlike(rf"[{SPACE}]"))


def is_page_noise(t: Column) -> Column:
    """Blank text, page numbers, copyright lines and date footers."""
    return trim(t).rlike(rf"(?i)\A(?:|[0-9]{{1,4}}|(?s:.*(?:©|copyright).*)|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}[{SPACE}]+[0-9]{{2}}:[0-9]{{2}})\z")


def section_level(text: Column) -> Column:
    """Heading level by section number: chapter marks are 1, ``1.2 Title`` is its dots plus one; null if it is no heading."""
    t = trim(text)
    first = F.regexp_extract(t, rf"\A([0-9.]+)[{SPACE}]+[^{SPACE}]", 1)
    dots = F.regexp_count(first, F.lit(r"\."))
    barred = (F.length(t) > 80) | t.rlike(r"[。.]\z")
    chapter = t.rlike(rf"\A第[^章]+章[{SPACE}]*[^{SPACE}]")
    broken = t.rlike(r"\A第[^章]*\z")
    return F.when(barred | broken, None).when(chapter, 1).when(first.rlike("[0-9]") & (dots <= 5), F.least(dots + 1, F.lit(6))).cast("int")


def _list_item(t: Column) -> tuple[Column, Column, Column]:
    """(ordered, marker, item) of a list line, all null for others."""
    s = trim(t)
    bullet, number = s.rlike(r"\A[-•・] "), F.regexp_extract(s, r"(?s)\A([0-9]+)\. ", 1)
    ordered = F.when(bullet, False).when(number != "", True)
    item = F.when(bullet, trim(F.substring(s, F.lit(3), F.length(s)))).when(number != "", trim(F.regexp_replace(s, r"\A[0-9]+\. ", "")))
    return ordered, F.when(ordered, number), item


def text_blocks(objects: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, block columns)."""
    doc = Window.partitionBy("doc_id")
    o = objects.filter(is_human_text(F.col("text")) & ~is_page_noise(F.col("text")))
    top, low = F.max(F.greatest("font_size", F.lit(0.0))).over(doc), F.min(F.when(F.col("font_size") > 0, F.col("font_size"))).over(doc)
    o = o.select("doc_id", "ord", "text", F.coalesce((top >= low + 4.0) & (F.col("font_size") == top), F.lit(False)).alias("big"))
    ordered, marker, item = _list_item(F.col("text"))
    o = o.select("*", F.when(~F.col("big"), ordered).alias("ordered"), marker.alias("marker"), item.alias("item"))
    by = doc.orderBy("ord")
    same = F.col("ordered").isNotNull() & (F.col("ordered") == F.lag("ordered").over(by))
    o = o.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(by))
    line = F.when(F.col("ordered"), F.concat("marker", F.lit(". "), "item")).when(~F.col("ordered"), F.concat(F.lit("- "), F.col("item"))).otherwise(F.col("text"))
    o = o.withColumn("line", line)
    o = o.withColumn("section", F.when(~F.col("big") & F.coalesce("ordered", F.lit(True)), section_level(F.col("line"))))
    run = Window.partitionBy("doc_id", "run")
    heads = F.min((F.col("ordered") & (F.col("marker") == "1") & F.col("section").isNotNull()).cast("int")).over(run) == 1
    o = o.withColumn("n", F.count("*").over(run)).withColumn("heads", F.coalesce(heads, F.lit(False)))
    as_list = F.col("ordered").isNotNull() & (F.col("n") >= 2) & ~F.col("heads")
    level = F.when(F.col("big"), 1).when(~as_list, F.col("section"))
    o = o.withColumn("list", as_list).withColumn("level", level)
    # Lists become one row; other rows stay.
    g = o.groupBy("doc_id", F.col("run"), F.when(F.col("list"), F.lit(-1)).otherwise(F.col("ord")).alias("key")).agg(
        F.min("ord").alias("pos"), F.first("list").alias("list"), F.first("ordered").alias("ordered"), F.first("level").alias("level"), F.first("line").alias("line"),
        F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("items"),
    )
    kind = F.when(F.col("list"), "list").when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    g = g.withColumn("kind", kind).withColumn("one", (F.col("kind") == "heading") & F.col("line").startswith("1. "))
    ones, nth = F.count_if("one").over(doc), F.count_if("one").over(doc.orderBy("pos"))
    renumbered = F.when(F.col("one") & (F.col("ones") >= 3), F.concat(F.col("nth").cast("string"), F.lit(". "), trim(F.regexp_replace("line", r"\A(?:1\. )+", "")))).otherwise(F.col("line"))
    g = g.withColumn("ones", ones).withColumn("nth", nth).withColumn("line", renumbered)
    texts = F.transform("items", lambda x: F.struct(F.lit("text").alias("kind"), x["item"].alias("text")))
    b = block(F.col("kind"), text=F.when(~F.col("list"), F.col("line")), level=F.when(F.col("kind") == "heading", F.col("level")), ordered=F.when(F.col("list"), F.col("ordered")), items=F.when(F.col("list"), texts))
    found = g.select("doc_id", F.col("pos").cast("int").alias("pos"), *[b.getField(f).alias(f) for f in BLOCK])
    return merged_paragraphs(pipe_tables(found), r"(?:#|\||[-*+] |```|[0-9]+[.)])", lambda text, first: F.length(F.regexp_replace(text, rf"[{SPACE}]+\z", "")) < 24)


# --- pipe tables ----------------------------------------------------------------------------------------------------


def _row(text: str) -> list[str] | None:
    t = text.strip()
    cells = [c.strip() for c in t.strip("|").split("|")]
    return cells if t.startswith("|") and t.endswith("|") and len(cells) >= 2 else None


def _is_rule(cells: list[str] | None) -> bool:
    return cells is not None and all(len(c) >= 3 and set(c) <= set("-: ") and "-" in c for c in cells)


def tables_of(texts: list[str]) -> list[tuple[int, list[list[str]] | None]]:
    """Consecutive pipe lines as (index of the first line, rows or None for a line of its own)."""
    rows, out, i = [_row(t) for t in texts], [], 0
    rule_after = lambda j: j + 1 < len(rows) and rows[j] and _is_rule(rows[j + 1]) and len(rows[j]) == len(rows[j + 1])
    while i < len(rows):
        if rule_after(i):
            e = i + 2
            while e < len(rows) and rows[e] and len(rows[e]) == len(rows[i]) and not _is_rule(rows[e]) and not (rows[e] == rows[i] and rule_after(e)):
                e += 1
            if e > i + 2:
                out.append((i, [rows[i], *rows[i + 2 : e]]))
                i = e
                continue
        out.append((i, None))
        i += 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("at", "integer").add("rows", T.ArrayType(T.ArrayType(T.StringType())))))
def _tables(runs: pd.Series) -> pd.Series:
    return runs.map(lambda r: [{"at": i, "rows": t} for i, t in tables_of(list(r))])


def pipe_tables(blocks: DataFrame) -> DataFrame:
    """``blocks`` with runs of pipe-line paragraphs turned into tables; only such runs leave the native path."""
    doc = Window.partitionBy("doc_id").orderBy("pos")
    pipe = (F.col("kind") == "paragraph") & trim(F.col("text")).rlike(r"(?s)\A\|.*\|\z")
    b = blocks.withColumn("pipe", F.coalesce(pipe, F.lit(False)))
    b = b.withColumn("run", F.sum(F.when(F.col("pipe") & F.coalesce(F.lag("pipe").over(doc), F.lit(False)), 0).otherwise(1)).over(doc))
    runs = b.filter("pipe").groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("xs"))
    found = runs.select("doc_id", "xs", F.explode(_tables(F.transform("xs", lambda x: x["text"]))).alias("t"))
    rows = F.transform("t.rows", lambda r: F.struct(F.transform(r, lambda c: F.struct(c.alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(None).cast("string").alias("image"))).alias("cells")))
    made = F.col("t.rows").isNotNull()
    nb = block(F.when(made, "table").otherwise("paragraph"), text=F.when(~made, F.get("xs", F.col("t.at"))["text"]), rows=F.when(made, rows))
    found = found.select("doc_id", F.get("xs", F.col("t.at"))["pos"].alias("pos"), *[nb.getField(f).alias(f) for f in BLOCK])
    return b.filter("NOT pipe").select("doc_id", "pos", *BLOCK).unionByName(found)


# --- scores and diagnosis -------------------------------------------------------------------------------------------

_CJK = "\\u3040-\\u30ff\\u3400-\\u9fff\\uf900-\\ufaff"


def flat_text(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, text): the texts of all blocks, a line each."""
    items = F.array_join(F.transform("items", lambda i: F.concat(i["text"], F.lit(" "))), "")
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r["cells"], lambda c: F.concat(c["text"], F.lit(" "))), "")), "")
    k = F.col("kind")
    one = F.when(k == "list", items).when(k == "table", cells).when(k == "image", F.concat_ws(" ", F.coalesce("alt", F.lit("")), "title")).when(k == "footnote", F.concat_ws(" ", "label", "text")).otherwise(F.col("text"))
    each = blocks.select("doc_id", "pos", F.concat(F.coalesce(one, F.lit("")), F.lit("\n")).alias("x"))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]), "").alias("text"))


def looks_mojibake(text: Column) -> Column:
    ink = F.length(F.regexp_replace(text, rf"[{SPACE}]", ""))
    odd = F.regexp_count(text, F.lit("[\\u0370-\\u03ff\\u0b80-\\u0bff\\u0d80-\\u0dff]"))
    return (ink >= 100) & (odd > 30) & (odd > F.regexp_count(text, F.lit(f"[{_CJK}]")) * 2)


def looks_incomplete(latin1: Column, text: Column) -> Column:
    """CID fonts without Unicode maps and little text; ``latin1`` is the file, a byte a character."""
    return has_unmapped_cid_fonts(latin1) & (F.length(F.regexp_replace(text, rf"[{SPACE}]", "")) < 2000) & (F.regexp_count(text, F.lit(f"[{_CJK}]")) < 20)


def result_score(text: Column, has_text: Column, failed: Column, ocr_required: Column) -> Column:
    s = F.length(F.regexp_replace(text, rf"[{SPACE}]", ""))
    for cost, when in ((1000, failed), (500, ocr_required), (10_000, looks_mojibake(text))):
        s = F.greatest(s - F.when(when, cost).otherwise(0), F.lit(0))
    return F.when(has_text, s).otherwise(0)


def best_result(candidates: DataFrame) -> DataFrame:
    """Of each document's candidates (doc_id, rank, usable, ocr_required, score): the first that is usable without OCR, else the best."""
    good = F.col("usable") & ~F.col("ocr_required")
    order = [F.when(good, F.col("rank")).asc_nulls_last(), F.col("score").desc(), F.col("rank")]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter("place = 1").drop("place")


def has_unmapped_cid_fonts(latin1: Column) -> Column:
    type0, maps = F.regexp_count(latin1, F.lit("/Subtype ?/Type0")), F.regexp_count(latin1, F.lit("/ToUnicode"))
    return (type0 > 0) & (type0 > maps) & latin1.rlike("Hira|Heisei|YuGothic|YuMincho|KozMin|Gothic|Mincho")


def no_text_diagnosis(latin1: Column) -> Column:
    image = latin1.rlike(r"/Subtype\s*/*Image|/Image[BCI]")
    font = latin1.rlike(r"/Type\s*/*Font|/BaseFont|/FontDescriptor|/Subtype ?/Type0")
    return F.when(image & ~font, "image_only").when(font & (~latin1.contains("/ToUnicode") | has_unmapped_cid_fonts(latin1)), "missing_unicode_maps").otherwise("unknown")


def security_description(latin1: Column) -> Column:
    standard = latin1.contains("/Filter/Standard") & latin1.contains("/P ")
    return F.when(standard, "the PDF has a Standard security handler and may be permission-restricted").otherwise("the PDF is encrypted")


def status_of(ocr_required: Column, latin1: Column) -> Column:
    """``ok`` or an error with its reason; a bad document is a row, never a failed job."""
    return F.when(~ocr_required, "ok").when(latin1.contains("/Encrypt"), F.concat(F.lit("error: "), security_description(latin1))).otherwise(F.concat(F.lit("error: ocr_required "), no_text_diagnosis(latin1)))


def merge_ocr_pages(runs: DataFrame, ocr: DataFrame) -> DataFrame:
    """Runs (doc_id, page, ord, text, font_size) with the lines of recognized pages (doc_id, page, text) instead where there are some."""
    read = ocr.filter(trim(F.col("text")) != "").select("doc_id", "page", F.posexplode(lines(F.col("text"))).alias("ord", "text"), F.lit(None).cast("double").alias("font_size"))
    native = runs.select("doc_id", "page", "ord", "text", "font_size").join(read.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return native.unionByName(read)


def judged(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """The best candidate of each file (doc_id, content): rows (doc_id, backend, ocr_required, status, runs) over all extractors' runs."""
    run = F.struct("page", "ord", "text", "font_size", "x", "y")
    g = candidates.groupBy("doc_id", "rank", "backend").agg(F.bool_or("failed").alias("failed"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), run))).alias("runs"))
    g = g.join(files.select("doc_id", F.decode("content", "ISO-8859-1").alias("latin1")), "doc_id")
    g = g.withColumn("text", F.array_join(F.transform("runs", lambda r: r["text"]), "\n"))
    has, text, latin1 = F.size("runs") > 0, F.col("text"), F.col("latin1")
    g = g.withColumn("ocr_required", ~has | looks_mojibake(text) | looks_incomplete(latin1, text))
    need = F.col("ocr_required")
    g = g.select("doc_id", "rank", "backend", "runs", "ocr_required", (has & ~F.col("failed")).alias("usable"), result_score(text, has, F.col("failed"), need).alias("score"), status_of(need, latin1).alias("status"))
    return best_result(g)


def plain_headings(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines as blocks: short lines (by bytes) with an upper-case letter and no final stop are headings of level 2."""
    line = documents.select("doc_id", F.posexplode(lines(F.col(text_col))).alias("pos", "raw")).select("doc_id", "pos", trim(F.col("raw")).alias("t")).filter("t <> ''")
    head = (F.octet_length("t") < 80) & F.col("t").rlike(r"\p{Lu}") & ~F.col("t").endswith(".")
    b = block(F.when(head, "heading").otherwise("paragraph"), level=F.when(head, 2), text=F.col("t"))
    return line.select("doc_id", "pos", *[b.getField(f).alias(f) for f in BLOCK])


# --- words to tables ------------------------------------------------------------------------------------------------


def word_rows(words: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Words (doc_id, page, text, x0, x1, top) with the row they stand in: tops rounded to the tolerance."""
    return words.withColumn("row", F.round(F.col("top") / tolerance) * tolerance)


def words_in_columns(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Words with the column (doc_id, page, col, lo, hi) whose range holds x0: an equi-join by page with a range condition."""
    c = columns.withColumnsRenamed({"doc_id": "c_doc", "page": "c_page"})
    met = words.join(c, (words["doc_id"] == c["c_doc"]) & (words["page"] == c["c_page"]) & (words["x0"] >= c["lo"]) & (words["x0"] < c["hi"]))
    return met.drop("c_doc", "c_page", "lo", "hi")


def columns_from_header(header: DataFrame) -> DataFrame:
    """Columns from header words (doc_id, page, x0, x1): bounds halfway between neighbours."""
    w = Window.partitionBy("doc_id", "page").orderBy("x0")
    mid = lambda a, b: (a + b) / 2
    return header.select(
        "doc_id", "page", (F.row_number().over(w) - 1).alias("col"),
        F.coalesce(mid(F.lag("x1").over(w), F.col("x0")), F.lit(float("-inf"))).alias("lo"), F.coalesce(mid(F.col("x1"), F.lead("x0").over(w)), F.lit(float("inf"))).alias("hi"),
    )


def nearest_anchor(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row) with the nearest anchor (doc_id, page, anchor); the boundary is halfway, ties go down."""
    w = Window.partitionBy("doc_id", "page").orderBy("anchor")
    a = anchors.select("doc_id", "page", "anchor", F.coalesce((F.lag("anchor").over(w) + F.col("anchor")) / 2, F.lit(float("-inf"))).alias("lo"), F.coalesce((F.col("anchor") + F.lead("anchor").over(w)) / 2, F.lit(float("inf"))).alias("hi"))
    a = a.withColumnsRenamed({"doc_id": "a_doc", "page": "a_page"})
    return rows.join(a, (rows["doc_id"] == a["a_doc"]) & (rows["page"] == a["a_page"]) & (rows["row"] >= a["lo"]) & (rows["row"] < a["hi"])).drop("a_doc", "a_page", "lo", "hi")


def table_from_words(words: DataFrame, header: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Rows (doc_id, page, anchor, cells): words under a header; lines without a first cell belong to the nearest line with one."""
    cols = columns_from_header(header)
    body = words_in_columns(word_rows(words, tolerance), cols)
    anchors = body.filter("col = 0").select("doc_id", "page", F.col("row").alias("anchor")).distinct()
    met = nearest_anchor(body, anchors)
    cell = met.groupBy("doc_id", "page", "anchor", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "x0", "text"))), lambda x: x["text"]), " ").alias("text"))
    n = cols.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    got = cell.groupBy("doc_id", "page", "anchor").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m")).join(n, ["doc_id", "page"])
    return got.select("doc_id", "page", "anchor", F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("cells"))


def carried_schema(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page, columns) with the last known columns on pages that have none."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("columns", F.last("columns", ignorenulls=True).over(w))

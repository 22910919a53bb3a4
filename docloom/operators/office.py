"""Word, PowerPoint, Excel and OpenDocument parts to blocks.

Packages are unzipped by ``sources.packages``; everything after is columns, windows and joins over parts. Only the balanced
scan of a Word body, which no regular expression can do, is Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import attribute, collapse, lossy_text, plain, trim
from ..schema import BLOCK, block


def xml_bodies(x: Column, name: str) -> Column:
    """Bodies of elements whose names start with ``name``."""
    return F.regexp_extract_all(x, F.lit(rf"(?s)<{name}[^>]*>(.*?)</{name}>"), F.lit(1))


def xml_elements(x: Column, name: str) -> Column:
    """Such elements whole."""
    return F.regexp_extract_all(x, F.lit(rf"(?s)<{name}[^>]*>.*?</{name}>"), F.lit(0))


def attribute_in(x: Column, tag: str, name: str) -> Column:
    """An attribute inside the first ``<tag``."""
    return attribute(F.regexp_extract(x, rf"<{tag}[^>]*>?", 0), name)


def relationships(x: Column) -> Column:
    """Array of (id, target) of a relationships part."""
    ids = lambda g: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r'(?s)\bId="([^"]*)".*?\bTarget="([^"]*)"'), F.lit(g))
    return F.arrays_zip(ids(1).alias("id"), ids(2).alias("target"))


def target_of(rels: Column, i: Column) -> Column:
    return F.get(F.filter(rels, lambda r: r["id"] == i), F.lit(0))["target"]


def _texts(x: Column, name: str) -> Column:
    return F.array_join(F.transform(xml_bodies(x, name), plain), "")


def _part(parts: DataFrame, name: str, alias: str) -> DataFrame:
    return parts.filter(F.col("part") == name).select(F.col("doc_id").alias(f"{alias}_doc"), lossy_text(F.col("content")).alias(alias))


def _with(df: DataFrame, parts: DataFrame, name: str, alias: str) -> DataFrame:
    p = _part(parts, name, alias)
    return df.join(p, df["doc_id"] == p[f"{alias}_doc"], "left").drop(f"{alias}_doc")


def byte_warnings(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, stage, warning) for XML parts with bytes that are no UTF-8: these were replaced."""
    bad = parts.filter("part IS NOT NULL").filter(F.try_validate_utf8(F.col("content").cast("string")).isNull() & F.col("content").isNotNull())
    return bad.select("doc_id", F.lit(0).alias("seq"), F.lit("package").alias("stage"), F.concat(F.lit("bytes that are no UTF-8 were replaced in "), "part").alias("warning"))


# --- Word -----------------------------------------------------------------------------------------------------------

_BLOCK_TAG = re.compile(r"<(w:p|w:tbl)(?=[\s>/])[^>]*>")


def body_blocks(xml: str) -> list[tuple[str, str]]:
    """The top-level paragraphs and tables of a document in order, as (tag, body); nested ones of the same tag are counted."""
    if m := re.search(r"<w:body(?=[\s>/])[^>]*>", xml):
        end = xml.find("</w:body>", m.end())
        xml = xml[m.end() : end if end >= 0 else len(xml)]
    out, at = [], 0
    while m := _BLOCK_TAG.search(xml, at):
        tag, at = m[1], m.end()
        if m[0].endswith("/>"):
            out.append((tag, ""))
            continue
        depth, ends = 1, re.compile(rf"<{tag}(?=[\s>/])[^>]*>|</{tag}>")
        for e in ends.finditer(xml, at):
            depth += -1 if e[0].startswith("</") else 0 if e[0].endswith("/>") else 1
            if not depth:
                out.append((tag, xml[at : e.start()]))
                at = e.end()
                break
        else:
            break
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("tag", "string").add("xml", "string")))
def _body(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: [{"tag": t, "xml": b} for t, b in body_blocks(x or "")])


def heading_style(style: Column) -> Column:
    """The smallest n of ``heading{n}`` in a style's name, in English or Japanese."""
    found = F.regexp_extract_all(F.lower(style), F.lit("(?:heading|見出し)([1-6])"), F.lit(1))
    return F.array_min(F.transform(found, lambda x: x.cast("int")))


def _picture(x: Column, rels: Column) -> Column:
    ref = F.coalesce(attribute_in(x, "a:blip", "r:embed"), attribute_in(x, "a:blip", "r:link"), attribute_in(x, "v:imagedata", "r:id"))
    return F.when(ref.isNotNull(), F.coalesce(target_of(rels, ref), F.concat(F.lit("media/"), ref, F.lit(".png"))))


def word_paragraphs(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, at, tag, xml, rels, style, text, image) of each document's body."""
    d = _part(parts, "word/document.xml", "x").select(F.col("x_doc").alias("doc_id"), F.posexplode(_body("x")).alias("at", "b"))
    d = _with(d.select("doc_id", "at", "b.tag", "b.xml"), parts, "word/_rels/document.xml.rels", "r").withColumn("rels", relationships(F.col("r"))).drop("r")
    x = F.col("xml")
    d = d.withColumn("style", F.when(x.rlike(r'(?s)w:pStyle.*?w:val="[^"]*"'), F.regexp_extract(x, r'(?s)w:pStyle.*?w:val="([^"]*)"', 1)))
    links = F.concat(F.regexp_extract_all(x, F.lit(r'<w:hyperlink [^>]*\bw:id="([^"]*)"'), F.lit(1)), F.regexp_extract_all(x, F.lit(r'<w:hyperlink[^>]*\br:id="([^"]*)"'), F.lit(1)))
    grow = lambda acc, t: F.when(t.isNull() | acc.contains(t), acc).otherwise(F.concat(acc, F.when(acc != "", " ").otherwise(""), F.lit("<"), t, F.lit(">")))
    d = d.withColumn("plain", trim(_texts(x, "w:t"))).withColumn("links", F.transform(links, lambda i: target_of(F.col("rels"), i)))
    return d.withColumn("text", F.aggregate("links", F.col("plain"), grow)).withColumn("image", F.when(F.col("tag") == "w:p", _picture(x, F.col("rels")))).drop("plain", "links")


def word_notes(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, tag, id, note): the first note of each id; blank ones are none."""
    out = None
    for part, tag in (("word/footnotes.xml", "w:footnote"), ("word/comments.xml", "w:comment")):
        n = _part(parts, part, "x").select(F.col("x_doc").alias("doc_id"), F.lit(tag).alias("tag"), F.posexplode(F.regexp_extract_all("x", F.lit(rf"(?s)<{tag} [^>]*>.*?</{tag}>"), F.lit(0))).alias("at", "m"))
        n = n.select("doc_id", "tag", attribute_in(F.col("m"), tag, "w:id").alias("id"), "at", trim(_texts(F.col("m"), "w:t")).alias("note"))
        out = n if out is None else out.unionByName(n)
    first = out.groupBy("doc_id", "tag", "id").agg(F.min_by("note", "at").alias("note"))
    return first.filter("note <> ''")


def word_blocks(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, block columns)."""
    p = word_paragraphs(parts)
    x, k = F.col("xml"), F.col("kind")
    kind = F.when(F.col("tag") == "w:tbl", "table").when(F.col("image").isNotNull(), "image").when(F.col("text") == "", None).when(heading_style(F.col("style")).isNotNull(), "heading").when(x.contains("<w:numPr"), "list").otherwise("paragraph")
    p = p.withColumn("kind", kind).filter("kind IS NOT NULL")
    caption = (k == "paragraph") & trim(F.col("text")).rlike(r"(?i)\A(?:figure |fig\. |図 |図表)")
    doc = Window.partitionBy("doc_id").orderBy("at")
    # A caption waits for the next image: it is the last caption since the image before.
    p = p.withColumn("images", F.coalesce(F.count_if(k == "image").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("cap", F.when(caption, F.col("text")))
    waits = F.last("cap", ignorenulls=True).over(Window.partitionBy("doc_id", "images").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("title", F.when(k == "image", waits))
    cell = lambda c: F.struct(trim(_texts(c, "w:t")).alias("text"), F.when(c.contains("<w:vMerge"), 2).otherwise(1).alias("rowspan"), F.coalesce(F.regexp_extract(c, r'(?s)w:gridSpan.*?w:val="([0-9]+)"', 1).try_cast("int"), F.lit(1)).alias("colspan"), _picture(c, F.col("rels")).alias("image"))
    rows = F.transform(xml_bodies(x, "w:tr"), lambda r: F.struct(F.transform(xml_bodies(r, "w:tc"), cell).alias("cells")))
    b = block(
        k, text=F.when(k.isin("heading", "paragraph"), F.col("text")), level=F.when(k == "heading", heading_style(F.col("style"))), ordered=F.when(k == "list", False),
        items=F.when(k == "list", F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text")))), rows=F.when(k == "table", rows),
        alt=F.when(k == "image", F.coalesce("title", F.lit("image"))), path=F.when(k == "image", F.col("image")), title=F.col("title"),
    )
    made = p.select("doc_id", "at", F.lit(0).alias("sub"), b.alias("b"))
    refs = None
    for i, (tag, label) in enumerate((("w:footnote", ""), ("w:comment", "comment:"))):
        ids = F.regexp_extract_all(x, F.lit(rf'<{tag}Reference [^>]*\bw:id="([^"]*)"'), F.lit(1))
        r = p.filter(k.isin("heading", "list", "paragraph")).select("doc_id", "at", F.posexplode(ids).alias("n", "id")).select("doc_id", "at", (F.col("n") + 1 + i * 1_000_000).alias("sub"), F.lit(tag).alias("tag"), "id", F.concat(F.lit(label), "id").alias("label"))
        refs = r if refs is None else refs.unionByName(r)
    notes = refs.join(word_notes(parts), ["doc_id", "tag", "id"]).select("doc_id", "at", "sub", block("footnote", label=F.col("label"), text=F.col("note")).alias("b"))
    return _numbered(made.unionByName(notes), "at", "sub")


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return df.select("doc_id", pos.cast("int").alias("pos"), "b.*")


def word_warnings(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, stage, warning): paragraph styles that map to nothing, and bodies without blocks."""
    p = word_paragraphs(parts)
    odd = (F.col("tag") == "w:p") & F.col("image").isNull() & (F.col("text") != "") & F.col("style").isNotNull() & heading_style(F.col("style")).isNull() & ~F.col("xml").contains("<w:numPr") & (F.lower("style") != "caption")
    styles = p.filter(odd).select("doc_id", F.col("at").alias("seq"), F.lit("docx").alias("stage"), F.concat(F.lit("unmapped docx paragraph style: "), F.col("style")).alias("warning"))
    docs = parts.filter("part = 'word/document.xml'").select("doc_id").distinct()
    bare = docs.join(word_blocks(parts).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("seq"), F.lit("docx").alias("stage"), F.lit("DOCX document.xml contained no supported paragraphs.").alias("warning"))
    return styles.unionByName(bare)


# --- PowerPoint -----------------------------------------------------------------------------------------------------


def slides(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, slide, xml, rels): slides by rank; relationships are paired by rank too, as they were numbered."""
    def ranked(pattern: str, alias: str) -> DataFrame:
        n = F.regexp_extract("part", pattern, 1)
        p = parts.filter(F.col("part").rlike(rf"\A{pattern}\z")).select("doc_id", n.try_cast("int").alias("no"), lossy_text(F.col("content")).alias(alias))
        p = p.filter(trim(F.col(alias)) != "")
        return p.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("no")).alias("slide"), alias)

    s, r = ranked(r"ppt/slides/slide([0-9]+)\.xml", "xml"), ranked(r"ppt/slides/_rels/slide([0-9]+)\.xml\.rels", "r")
    return s.join(r, ["doc_id", "slide"], "left").select("doc_id", "slide", "xml", relationships(F.col("r")).alias("rels"))


def shapes(slides: DataFrame) -> DataFrame:
    """Rows (doc_id, slide, ord, part, source, x, y, kind, text, list_kind, rows, path): what shapes and pictures show, in XML order."""
    number = lambda m, n: F.coalesce(attribute_in(m, "a:off", n).try_cast("long"), F.lit(0))
    s = slides.select("doc_id", "slide", F.posexplode(xml_elements(F.col("xml"), "p:sp")).alias("ord", "m"))
    s = s.select("doc_id", "slide", "ord", F.regexp_extract("m", r"(?s)\A<[^>]*>(.*)</p:sp>\z", 1).alias("m")).withColumns({"x": number(F.col("m"), "x"), "y": number(F.col("m"), "y")})
    m = F.col("m")
    cells = lambda r: F.transform(xml_bodies(r, "a:tc"), lambda c: F.struct(_texts(c, "a:t").alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(None).cast("string").alias("image")))
    table = F.get(xml_bodies(m, "a:tbl"), F.lit(0))
    rows = F.transform(xml_bodies(table, "a:tr"), lambda r: F.struct(cells(r).alias("cells")))
    s = s.withColumn("rows", F.when(table.isNotNull(), rows)).withColumn("title", F.coalesce(attribute_in(m, "p:ph", "type").isin("title", "ctrTitle"), F.lit(False)))
    paragraphs = xml_bodies(m, "a:p")
    mark = lambda p: F.when(p.contains("<a:buAutoNum"), "ordered").when(p.contains("<a:buChar") | p.contains("<a:buBlip"), "unordered")
    each = F.when(F.size(paragraphs) > 0, F.transform(paragraphs, lambda p: F.struct(trim(_texts(p, "a:t")).alias("text"), mark(p).alias("list_kind")))).otherwise(F.transform(xml_bodies(m, "a:t"), lambda t: F.struct(trim(plain(t)).alias("text"), F.lit(None).cast("string").alias("list_kind"))))
    texts = s.filter("rows IS NULL").select("doc_id", "slide", "ord", "x", "y", "title", F.posexplode(F.filter(each, lambda p: p["text"] != "")).alias("at", "p")).select("doc_id", "slide", "ord", "x", "y", "title", "at", "p.text", F.when(~F.col("title"), F.col("p.list_kind")).alias("list_kind"))
    # Neighbouring items of one kind are a list; one alone is a paragraph.
    by = Window.partitionBy("doc_id", "slide", "ord").orderBy("at")
    same = F.col("list_kind").isNotNull() & (F.col("list_kind") == F.lag("list_kind").over(by))
    texts = texts.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(by))
    g = texts.groupBy("doc_id", "slide", "ord", "x", "y", "run").agg(F.min("at").alias("at"), F.first("list_kind").alias("list_kind"), F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("ts"))
    kind = F.when(F.size("ts") > 1, "list").when(F.col("title") & (F.col("at") == 0), "heading").otherwise("paragraph")
    shown = g.select("doc_id", "slide", F.lit(0).alias("part"), "ord", "at", F.lit("shape").alias("source"), "x", "y", kind.alias("kind"), F.get("ts", F.lit(0))["text"].alias("text"), "list_kind", F.transform("ts", lambda t: F.struct(F.lit("text").alias("kind"), t["text"].alias("text"))).alias("items"), F.lit(None).cast(BLOCK["rows"]).alias("rows"), F.lit(None).cast("string").alias("path"))
    nothing = lambda: [F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("list_kind"), F.lit(None).cast(BLOCK["items"]).alias("items")]
    tables = s.filter("rows IS NOT NULL").select("doc_id", "slide", F.lit(0).alias("part"), "ord", F.lit(0).alias("at"), F.lit("table").alias("source"), "x", "y", F.lit("table").alias("kind"), *nothing(), F.col("rows").cast(BLOCK["rows"]).alias("rows"), F.lit(None).cast("string").alias("path"))
    pics = slides.select("doc_id", "slide", "rels", F.posexplode(xml_elements(F.col("xml"), "p:pic")).alias("ord", "m"))
    ref = attribute_in(m, "a:blip", "r:embed")
    path = F.when(ref.isNull(), F.lit("media/unknown-image.png")).otherwise(F.coalesce(target_of(F.col("rels"), ref), F.concat(F.lit("media/"), ref, F.lit(".png"))))
    pics = pics.select("doc_id", "slide", F.lit(1).alias("part"), "ord", F.lit(0).alias("at"), F.lit("picture").alias("source"), number(m, "x").alias("x"), number(m, "y").alias("y"), F.lit("image").alias("kind"), *nothing(), F.lit(None).cast(BLOCK["rows"]).alias("rows"), path.alias("path"))
    return shown.unionByName(tables).unionByName(pics)


def _arranged(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, slide, xml, legacy, xs): each slide with what it shows, gathered once; ``legacy`` slides are taken in XML order, as they
    have neither positions nor placeholders, or nothing else."""
    s = slides(parts)
    shown = shapes(s)
    each = F.struct("y", "x", "part", "ord", "at", "source", "kind", "text", "list_kind", "items", "rows", "path")
    g = shown.groupBy("doc_id", "slide").agg(F.collect_list(each).alias("xs"), F.bool_and((F.col("x") == 0) & (F.col("y") == 0) & (F.col("source") == "shape")).alias("flat"))
    met = s.select("doc_id", "slide", "xml").join(g, ["doc_id", "slide"], "left")
    return met.select("doc_id", "slide", "xml", (F.col("flat").isNull() | (F.col("flat") & ~F.col("xml").contains("<p:ph"))).alias("legacy"), "xs")


def slide_blocks(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, block columns): slides in order, and on each what is further up, then further left."""
    def shown(x: Column) -> Column:
        k = x["kind"]
        b = block(k, text=F.when(k.isin("heading", "paragraph"), x["text"]), level=F.when(k == "heading", 1), ordered=F.when(k == "list", x["list_kind"] == "ordered"), items=F.when(k == "list", x["items"]), rows=x["rows"], alt=F.when(k == "image", F.lit("slide image")), path=x["path"])
        return F.struct(x["y"].alias("y"), x["x"].alias("x"), x["part"].alias("part"), x["ord"].alias("ord"), x["at"].alias("at"), b.alias("b"))

    def plain_text(t: Column, i: Column) -> Column:
        b = block(F.when(i == 0, "heading").otherwise("paragraph"), text=t, level=F.when(i == 0, 1))
        zero = F.lit(0)
        return F.struct(zero.cast("long").alias("y"), zero.cast("long").alias("x"), zero.alias("part"), zero.alias("ord"), i.alias("at"), b.alias("b"))

    texts = F.filter(F.transform(xml_bodies(F.col("xml"), "a:t"), lambda v: trim(plain(v))), lambda v: v != "")
    rows = F.when(F.col("legacy"), F.transform(texts, plain_text)).otherwise(F.transform("xs", shown))
    each = _arranged(parts).select("doc_id", "slide", F.explode(rows).alias("r")).select("doc_id", "slide", "r.*")
    return _numbered(each, "slide", "y", "x", "part", "ord", "at")


def slide_warnings(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, stage, warning): inferred order, and grids of text that look like tables."""
    shown = _arranged(parts).filter("NOT legacy").select("doc_id", "slide", F.explode("xs").alias("r")).select("doc_id", "slide", "r.*")
    text = (F.col("source") == "shape") & (F.col("kind") == "paragraph")
    g = shown.groupBy("doc_id", "slide").agg(F.bool_or((F.col("x") != 0) | (F.col("y") != 0)).alias("moved"), F.count_if(text).alias("n"), F.count_distinct(F.when(text, F.col("x"))).alias("xs"), F.count_distinct(F.when(text, F.col("y"))).alias("ys"), F.count_if(F.col("kind") == "list").alias("lists"))
    w = F.array_compact(F.array(
        F.when(F.col("lists") > 0, "pptx list structure restored from paragraph properties"), F.when(F.col("moved"), "pptx visual order inferred from shape coordinates"),
        F.when((F.col("n") >= 4) & (F.col("xs") >= 2) & (F.col("ys") >= 2), "pptx shape grid looks like a pseudo table; kept as ordered text"),
    ))
    return g.select("doc_id", F.col("slide").alias("seq"), F.lit("pptx").alias("stage"), F.explode(w).alias("warning"))


# --- Excel ----------------------------------------------------------------------------------------------------------


def column_number(letters: Column) -> Column:
    """A column's number from its letters, base 26 from 1."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))


def shared_strings(x: Column) -> Column:
    return F.transform(xml_bodies(F.coalesce(x, F.lit("")), "si"), lambda s: trim(plain(F.regexp_replace(s, r"(?s)<rPh.*?(?:</rPh>|\z)", ""))))


def merges(x: Column) -> Column:
    """Array of (start, rowspan, colspan) of merged ranges."""
    ref = r'<mergeCell\b[^>]*\bref="([A-Za-z]*[0-9]+):([A-Za-z]*[0-9]+)"'
    pairs = F.arrays_zip(F.regexp_extract_all(x, F.lit(ref), F.lit(1)).alias("s"), F.regexp_extract_all(x, F.lit(ref), F.lit(2)).alias("e"))
    row, col = lambda r: F.regexp_extract(r, "([0-9]+)", 1).cast("int"), lambda r: column_number(F.regexp_extract(r, r"\A([A-Za-z]*)", 1))
    return F.transform(pairs, lambda p: F.struct(p["s"].alias("start"), (F.greatest(row(p["e"]) - row(p["s"]), F.lit(0)) + 1).alias("rowspan"), (F.greatest(col(p["e"]) - col(p["s"]), F.lit(0)) + 1).alias("colspan")))


def sheets(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, sheet, n_sheets, xml, strings, merges)."""
    n = F.regexp_extract("part", r"sheet([0-9]+)\.xml", 1).try_cast("int")
    s = parts.filter(F.col("part").startswith("xl/worksheets/")).select("doc_id", n.alias("no"), lossy_text(F.col("content")).alias("xml")).filter(trim(F.col("xml")) != "")
    doc = Window.partitionBy("doc_id")
    s = s.select("doc_id", F.row_number().over(doc.orderBy("no")).alias("sheet"), F.count("*").over(doc).alias("n_sheets"), "xml")
    return _with(s, parts, "xl/sharedStrings.xml", "ss").select("doc_id", "sheet", "n_sheets", "xml", shared_strings(F.col("ss")).alias("strings"), merges(F.col("xml")).alias("merges"))


def sheet_cells(sheets: DataFrame) -> DataFrame:
    """Rows (doc_id, sheet, r, c, ref, text, rowspan, colspan, formula): cells in XML order; gaps are not filled."""
    e = sheets.select("doc_id", "sheet", "strings", "merges", F.posexplode(xml_bodies(F.col("xml"), "row")).alias("r", "row"))
    e = e.select("doc_id", "sheet", "strings", "merges", "r", F.posexplode(xml_elements(F.col("row"), "c")).alias("c", "m"))
    m = F.col("m")
    head = F.regexp_extract(m, r"\A<[^>]*>", 0)
    body = F.regexp_extract(m, r"(?s)\A<[^>]*>(.*)</c>\z", 1)
    value = F.coalesce(trim(plain(F.get(xml_bodies(body, "v"), F.lit(0)))), F.lit(""))
    index = F.when(value.rlike(r"\A\+?[0-9]+\z"), value.try_cast("int"))
    text = F.when(head.contains('t="s"'), F.coalesce(F.get("strings", index), value)).when(head.contains('t="inlineStr"'), F.coalesce(trim(plain(F.get(xml_bodies(body, "t"), F.lit(0)))), value)).otherwise(value)
    e = e.withColumn("ref", attribute(head, "r"))
    span = F.get(F.filter("merges", lambda x: x["start"] == F.col("ref")), F.lit(0))
    return e.select("doc_id", "sheet", "r", "c", "ref", text.alias("text"), F.coalesce(span["rowspan"], F.lit(1)).alias("rowspan"), F.coalesce(span["colspan"], F.lit(1)).alias("colspan"), body.contains("<f").alias("formula"))


def sheet_tables(sheets: DataFrame) -> DataFrame:
    """Rows (doc_id, sheet, rows): each sheet's table without its blank edges."""
    c = sheet_cells(sheets)
    full = trim(F.col("text")) != ""
    w = Window.partitionBy("doc_id", "sheet")
    edge = lambda f, x: f(F.when(full, F.col(x))).over(w)
    c = c.withColumns({"r0": edge(F.min, "r"), "r1": edge(F.max, "r"), "c0": edge(F.min, "c"), "c1": edge(F.max, "c")})
    # Rows without cells inside the table stay, so rows come from the sheet, cells from the window.
    inside = c.filter(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    cell = F.struct("c", F.struct("text", "rowspan", "colspan", F.lit(None).cast("string").alias("image")).alias("cell"))
    row = inside.groupBy("doc_id", "sheet", "r", "r0", "r1").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["cell"]).alias("cells"))
    per = row.groupBy("doc_id", "sheet", "r0", "r1").agg(F.map_from_entries(F.collect_list(F.struct("r", "cells"))).alias("m"))
    none = F.array().cast("array<struct<text:string,rowspan:int,colspan:int,image:string>>")
    per = per.select("doc_id", "sheet", F.transform(F.sequence("r0", "r1"), lambda i: F.struct(F.coalesce(F.try_element_at("m", i), none).alias("cells"))).alias("rows"))
    return sheets.select("doc_id", "sheet", "n_sheets").join(per, ["doc_id", "sheet"], "left").withColumn("rows", F.coalesce("rows", F.array().cast(BLOCK["rows"])))


def sheet_blocks(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, block columns): a table a sheet, under headings where there are several."""
    t = sheet_tables(sheets(parts))
    table = t.select("doc_id", "sheet", F.lit(1).alias("sub"), block("table", rows=F.col("rows")).alias("b"))
    head = t.filter("n_sheets > 1").select("doc_id", "sheet", F.lit(0).alias("sub"), block("heading", level=F.lit(1), text=F.concat(F.lit("Sheet "), F.col("sheet").cast("string"))).alias("b"))
    return _numbered(table.unionByName(head), "sheet", "sub")


def sheet_warnings(parts: DataFrame) -> DataFrame:
    s = sheets(parts)
    f = sheet_cells(s).filter("formula").select("doc_id", (F.col("sheet") * 10_000_000 + F.col("r") * 1000 + F.col("c")).cast("long").alias("seq"), F.lit("xlsx").alias("stage"), F.concat(F.lit("xlsx formula cell "), F.coalesce("ref", F.lit("?")), F.lit(" emitted cached display value")).alias("warning"))
    m = s.filter(F.size("merges") > 0).select("doc_id", ((F.col("sheet") + 1) * 10_000_000 - 1).cast("long").alias("seq"), F.lit("xlsx").alias("stage"), F.concat(F.lit("xlsx mergeCells expanded "), F.size("merges").cast("string"), F.lit(" merged range(s)")).alias("warning"))
    return f.unionByName(m)


# --- OpenDocument ---------------------------------------------------------------------------------------------------


def opendocument_blocks(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, block columns) of content.xml: headings, paragraphs and tables; blank ones are dropped."""
    pattern = r"(?s)<text:h[^>]*>.*?</text:h>|<text:p[^>]*>.*?</text:p>|<table:table[^>]*>.*?</table:table>"
    p = _part(parts, "content.xml", "x").select(F.col("x_doc").alias("doc_id"), F.posexplode(F.regexp_extract_all("x", F.lit(pattern), F.lit(0))).alias("at", "m"))
    m = F.col("m")
    body = F.regexp_extract(m, r"(?s)\A<[^>]*>(.*)</[^>]*>\z", 1)
    text = collapse(plain(body))
    cells = lambda r: F.transform(xml_bodies(r, "table:table-cell"), lambda c: F.struct(collapse(plain(c)).alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(None).cast("string").alias("image")))
    rows = F.filter(F.transform(xml_bodies(body, "table:table-row"), lambda r: F.struct(cells(r).alias("cells"))), lambda r: F.exists(r["cells"], lambda c: c["text"] != ""))
    kind = F.when(m.startswith("<table:table"), "table").when(m.startswith("<text:h"), "heading").otherwise("paragraph")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(attribute_in(m, "text:h", "text:outline-level").try_cast("int"), F.lit(1))))
    p = p.select("doc_id", "at", kind.alias("kind"), text.alias("text"), level.alias("level"), rows.alias("rows"))
    k = F.col("kind")
    p = p.filter(F.when(k == "table", F.size("rows") > 0).otherwise(F.col("text") != ""))
    b = block(k, text=F.when(k != "table", F.col("text")), level=F.when(k == "heading", F.col("level")), rows=F.when(k == "table", F.col("rows")))
    return _numbered(p.select("doc_id", "at", b.alias("b")), "at")


def opendocument_warnings(parts: DataFrame) -> DataFrame:
    b = opendocument_blocks(parts)
    tables = b.filter("kind = 'table'").select("doc_id", F.col("pos").alias("seq"), F.lit("odf").alias("stage"), F.lit("OpenDocument table structure restored from content.xml").alias("warning"))
    bare = parts.filter("part = 'content.xml'").select("doc_id").join(b.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("seq"), F.lit("odf").alias("stage"), F.lit("OpenDocument content.xml contained no supported structural nodes").alias("warning"))
    return tables.unionByName(bare)

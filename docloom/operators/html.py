"""HTML to blocks.

A page is cut into its elements by one regular expression, exploded, and the rest is columns over short strings, so the
optimizer shares common parts and a page is scanned twice in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import attribute, bodies, plain, trim
from ..schema import BLOCK, block

_OPEN = r"(?=[> \n\t/])"
#: A closed element, an image, or an element that never closes, which takes all that follows.
ELEMENT = rf"(?is)<(h[1-6]|p|ul|ol|pre|table){_OPEN}[^>]*>.*?</\1>|<img{_OPEN}[^>]*>|<(?:h[1-6]|p|ul|ol|pre|table|img){_OPEN}.*\z"
#: Those that give a block: closed ones, lists with an item, images with a source.
GIVES_BLOCK = rf"""(?is)\A(?:<(h[1-6]|p|pre|table){_OPEN}[^>]*>.*</\1>|<(ul|ol){_OPEN}[^>]*>.*<li[^>]*>.*</li>.*</\2>|<img{_OPEN}[^>]*>)\z"""
NO_STRUCTURE = "HTML parser found no structural nodes; emitted plain paragraph."


def sanitized(html: Column) -> Column:
    """Without scripts and styles; an unterminated one takes all that follows."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}.*?(?:</{tag}>|\z)", "")
    return html


def table_rows(body: Column) -> Column:
    """Rows of cells; header cells come first in each row, and spans and images are looked for in a cell's body."""
    def cell(c: Column) -> Column:
        number = lambda name: F.coalesce(F.regexp_extract(c, rf'{name}="\+?([0-9]+)"', 1).try_cast("int"), F.lit(1))
        return F.struct(plain(c).alias("text"), number("rowspan").alias("rowspan"), number("colspan").alias("colspan"), attribute(c, "src").alias("image"))

    return F.transform(bodies(body, "tr"), lambda r: F.struct(F.transform(F.concat(bodies(r, "th"), bodies(r, "td")), cell).alias("cells")))


def _elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Rows (doc_id, clean, pos, m): a page's elements that give blocks, or one row with a null m."""
    found = pages.select(F.col(id_col).alias("doc_id"), sanitized(F.coalesce(F.col(html_col), F.lit(""))).alias("clean"))
    gives = lambda m: m.rlike(GIVES_BLOCK) & ((F.lower(F.substring(m, 1, 4)) != "<img") | m.contains('src="'))
    found = found.withColumn("ms", F.filter(F.regexp_extract_all("clean", F.lit(ELEMENT), F.lit(0)), gives))
    return found.select("doc_id", F.when(F.size("ms") == 0, F.col("clean")).alias("clean"), F.posexplode_outer("ms").alias("pos", "m"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (doc_id, pos, block columns) of all pages; null pages have none."""
    e = _elements(pages, id_col, html_col)
    tag = F.lower(F.regexp_extract("m", r"(?i)\A<(h[1-6]|p|ul|ol|pre|table|img)" + _OPEN, 1))
    e = e.select("doc_id", "clean", F.coalesce("pos", F.lit(0)).alias("pos"), "m", tag.alias("tag"), F.regexp_extract("m", r"(?s)\A<[^>]*>(.*)</[^>]*>\z", 1).alias("body"))
    t, m, body = F.col("tag"), F.col("m"), F.col("body")
    kind = F.when(m.isNull() | (t == "p"), "paragraph").when(t.startswith("h"), "heading").when(t.isin("ul", "ol"), "list").when(t == "pre", "code").when(t == "table", "table").otherwise("image")
    e = e.withColumn("kind", kind).withColumn("text", F.when(m.isNull(), plain(F.col("clean"))).when(F.col("kind").isin("heading", "paragraph", "code"), plain(body)))
    e = e.filter(m.isNotNull() | (trim(F.col("text")) != ""))
    is_ = lambda k: F.col("kind") == k
    items = F.transform(bodies(body, "li"), lambda i: F.struct(F.lit("text").alias("kind"), plain(i).alias("text")))
    b = block(
        F.col("kind"), text=F.col("text"), level=F.when(is_("heading"), F.substring(t, 2, 1).try_cast("int")), ordered=F.when(is_("list"), t == "ol"), items=F.when(is_("list"), items),
        rows=F.when(is_("table"), table_rows(body)), alt=F.when(is_("image"), F.coalesce(attribute(m, "alt"), F.lit(""))), path=F.when(is_("image"), attribute(m, "src")),
        title=F.when(is_("image"), attribute(m, "title")), language=F.when(is_("code"), F.lit("text")),
    )
    return e.select("doc_id", F.col("pos").cast("int").alias("pos"), *[b.getField(f).alias(f) for f in BLOCK])


def html_warnings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (doc_id, seq, stage, warning): images without titles, and pages without structure."""
    e = _elements(pages, id_col, html_col)
    untitled = (F.lower(F.substring("m", 1, 4)) == "<img") & attribute(F.col("m"), "title").isNull()
    text = F.when(F.col("m").isNull(), F.lit(NO_STRUCTURE)).when(untitled, F.concat(F.lit("image caption inference failed: "), attribute(F.col("m"), "src")))
    return e.select("doc_id", F.coalesce("pos", F.lit(0)).alias("seq"), F.lit("html").alias("stage"), text.alias("warning")).filter("warning IS NOT NULL")

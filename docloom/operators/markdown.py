"""Blocks to Markdown.

Almost every text takes a native path: whitespace is collapsed, characters are escaped, lines are wrapped by one
regular expression. Texts with addresses or overlong tokens, which need a look at neighbouring tokens, go through one
Arrow function, which gets empty strings for all others. Windows share one partitioning by document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, collapse, escape_html, trim, trim_end

FLAVORS = ("commonmark", "gfm", "markdownlint", "hedgedoc")
WIDTH = 80
_WS = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_WS_EDGE = "\t\n\x0b\x0c\r \x85\xa0                　"
_URL = re.compile(r"https?://|www\.")
_EMAIL = re.compile(r"[^@]+@(?=[^@]*\.)[A-Za-z0-9.-]+")
_JOINABLE = re.compile(r"[A-Za-z0-9/._~?#&=%:-]*>?")
_EMBEDDED_MAIL = re.compile(r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*")
_URL_RUN = re.compile(r"(?:https?://|www\.)[^\s<>\"'“”‘’)）\x80-\U0010ffff]*")


# --- inline text: the Arrow path ---------------------------------------------------------------------------------


def _escape_token(t: str) -> str:
    return re.sub(r"([\\*_\[\]`])", r"\\\1", t.replace("<", "&lt;").replace(">", "&gt;"))


def is_email(t: str) -> bool:
    return _EMAIL.fullmatch(t) is not None


def is_autolink(t: str) -> bool:
    inner = t[1:-1] if len(t) >= 2 and t[0] == "<" and t[-1] == ">" else None
    return inner is not None and (_URL.match(inner) is not None or is_email(inner))


def _mark_token(t: str) -> str:
    """A token with a bare address put in angle brackets, or escaped."""
    a = next((i for i, c in enumerate(t) if c.isalnum()), 0)
    e = next((i + 1 for i in range(len(t) - 1, -1, -1) if t[i].isalnum() or t[i] in "/-"), len(t))
    a, e = (a, e) if a < e else (0, len(t))
    core = t[a:e]
    if is_autolink(core):
        return t
    if _URL.match(core) or is_email(core):
        return f"{t[:a]}<{core}>{t[e:]}"
    if _URL.search(t):
        return t.replace("<", "&lt;").replace(">", "&gt;")
    at = t.find("@")
    if at >= 0:
        m = next(m for m in _EMBEDDED_MAIL.finditer(t) if m.start() <= at < m.end())
        if is_email(m[0]):
            return f"{_escape_token(t[: m.start()])}<{m[0]}>{_escape_token(t[m.end() :])}"
    return _escape_token(t)


def _bracket_urls(text: str) -> str:
    """Angle brackets around each URL that has none; one that follows ``<`` is left as it is."""
    out, at = [], 0
    while m := _URL.search(text, at):
        out.append(text[at : m.start()])
        if text[: m.start()].endswith("<"):
            out.append(m[0])
            at = m.end()
        else:
            run = _URL_RUN.match(text, m.start())
            out.append(f"<{run[0]}>")
            at = run.end()
    return "".join([*out, text[at:]])


def _escape_line(text: str) -> str:
    """One backslash where a line would start another kind of block."""
    text = text.replace(")[", ")\\[")
    if m := re.match(r"[0-9]+(?=[.)](?: |\Z))", text):
        return f"{m[0]}\\{text[m.end() :]}"
    marker = next((c for c in text if c in "-_*"), None)
    rule = marker is not None and text.count(marker) >= 3 and all(c == marker or c in _WS_EDGE for c in text)
    if text.startswith(("#", "- ", "* ", "+ ")) or re.match(r"\[[^\n]*?\]:", text) and text.find("]:") > 1 or rule:
        return "\\" + text
    return text


def inline_text(text: str) -> str:
    """A block's text as inline Markdown."""
    tokens: list[str] = []
    for t in _WS.split(text.strip(_WS_EDGE)) if text.strip(_WS_EDGE) else []:
        last = tokens[-1] if tokens else ""
        if _URL.search(last) and _JOINABLE.fullmatch(t) and last.endswith(("/", ".h", "-")):
            tokens[-1] = last + t
        else:
            tokens.append(t)
    return _escape_line(_bracket_urls(" ".join(map(_mark_token, tokens))))


def wrap_text(text: str, width: int = WIDTH) -> str:
    """Lines of at most ``width`` characters; longer tokens are cut, addresses are not."""
    lines, line = [], ""
    for t in text.split(" ") if text else []:
        if line and len(line) + 1 + len(t) <= width:
            line += " " + t
            continue
        if line:
            lines.append(line)
        line = t
        if not (len(t) <= width or is_autolink(t) or _URL.search(t)):
            while len(line) > width:
                lines.append(line[:width])
                line = line[width:]
    return "\n".join([*lines, line]) if line else "\n".join(lines)


def wrap_item(text: str, prefix: str, width: int = WIDTH) -> str:
    """A list item after ``prefix``, continued under it; no token is cut, addresses stay on their line."""
    lines, line, indent = [], prefix, " " * len(prefix)
    for t in text.split(" ") if text else []:
        if line in (prefix, indent):
            line += t
        elif len(line) + 1 + len(t) <= width or is_autolink(t) or _URL.search(t):
            line += " " + t
        else:
            lines.append(line.rstrip(_WS_EDGE))
            line = indent + t
    return "\n".join([*lines, line.rstrip(_WS_EDGE)])


@F.pandas_udf(T.StringType())
def _inline_arrow(s: pd.Series) -> pd.Series:
    return s.map(inline_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _wrap_arrow(s: pd.Series) -> pd.Series:
    return s.map(wrap_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _inline_items_arrow(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else [inline_text(x) for x in a])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _wrap_items_arrow(s: pd.Series, prefixes: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else [wrap_item(t, q) for t, q in zip(a, p, strict=True)] for a, p in zip(s, prefixes, strict=True)])


# --- inline text: the native path ---------------------------------------------------------------------------------


def _linkless(c: Column) -> Column:
    return ~c.rlike(r"https?://|www\.|@")


def _inline_native(c: Column) -> Column:
    c = F.regexp_replace(collapse(c), r"([\\*_\[\]`])", r"\\$1")
    c = F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    c = F.replace(c, F.lit(")["), F.lit(")\\["))
    c = F.regexp_replace(c, r"\A([0-9]+)([.)])(?= |\z)", r"$1\\$2")
    return F.regexp_replace(c, r"\A(?=#|[-+] |-[- ]*-[- ]*-[- ]*\z)", r"\\")


def _plain_wrap(c: Column, width: int | Column = WIDTH) -> Column:
    pattern = F.lit(rf"(.{{1,{width}}})(?: |\z)") if isinstance(width, int) else F.concat(F.lit("(.{1,"), width.cast("string"), F.lit(r"})(?: |\z)"))
    return F.regexp_replace(F.regexp_replace(c, pattern, F.lit("$1\n")), r"\n+\z", "")


def _short_tokens(c: Column, width: int) -> Column:
    return ~c.rlike(rf"[^ ]{{{width + 1},}}")


def inline(c: Column) -> Column:
    """Inline Markdown of a text column."""
    easy = _linkless(c)
    return F.when(easy, _inline_native(c)).otherwise(_inline_arrow(F.when(easy, F.lit("")).otherwise(c)))


def wrapped(c: Column) -> Column:
    """Wrapped lines of a column of inline Markdown."""
    easy = _short_tokens(c, WIDTH)
    return F.when(easy, _plain_wrap(c)).otherwise(_wrap_arrow(F.when(easy, F.lit("")).otherwise(c)))


# --- headings -------------------------------------------------------------------------------------------------------


def promotes(text: Column) -> Column:
    """Whether a first paragraph becomes the title."""
    t = trim(text)
    return (t != "") & (F.length(t) <= WIDTH) & ~t.startswith("Unsupported input format:") & ~t.rlike(r"[。.,、]\z")


def heading_text(c: Column) -> Column:
    return F.regexp_replace(c, r"[.,;:!?。、；：！？]+\z", "")


def headings(blocks: DataFrame) -> DataFrame:
    """``blocks`` with promoted (boolean), out_level, heading (unique, cut) and overflow for headings.

    Levels rise by one at most: with t the wanted level of the i-th heading, out = i + min(t - i) over the headings so far.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    b = blocks.withColumn("promoted", (F.col("kind") == "paragraph") & (F.row_number().over(doc) == 1) & promotes(F.col("text")))
    b = b.withColumn("is_h", F.col("promoted") | (F.col("kind") == "heading"))
    b = b.withColumn("h_text", F.when(F.col("is_h"), heading_text(inline(F.col("text")))))
    i = F.sum(F.col("is_h").cast("int")).over(doc)
    b = b.withColumn("i", F.when(F.col("is_h"), i))
    want = F.when(F.col("i") == 1, 1).when(F.col("level") == 1, 2).otherwise(F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))))
    b = b.withColumn("out_level", F.when(F.col("is_h"), F.col("i") + F.min(F.when(F.col("is_h"), want - F.col("i"))).over(doc)).cast("int"))
    again = F.row_number().over(Window.partitionBy("doc_id", "is_h", "h_text").orderBy("pos"))
    b = b.withColumn("again", again)
    text = F.when(F.col("again") == 1, F.col("h_text")).otherwise(F.concat("h_text", F.lit(" ("), F.col("again").cast("string"), F.lit(")")))
    b = b.withColumn("full", F.when(F.col("is_h"), text))
    room = F.lit(WIDTH - 1) - F.col("out_level")
    spaces = r"\\x09-\\x0D\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
    # The longest part that fits and that whitespace follows.
    cut = F.expr(rf"regexp_extract(full, concat('(?s)\\A(.{{0,', cast({WIDTH - 2} - out_level as string), '}})[{spaces}].*'), 1)")
    long = ~F.col("promoted") & (F.length("full") > room)
    spaced = F.col("full").rlike(r"[\x09-\x0D\x20]") & (cut != "")
    b = b.withColumn("heading", F.when(~long, F.col("full")).when(spaced, trim_end(cut)).otherwise(F.substring(F.col("full"), F.lit(1), room)))
    return b.withColumn("overflow", F.when(long & spaced, trim(F.substring(F.col("full"), F.length(cut) + 1, F.length("full"))))).drop("is_h", "h_text", "i", "again", "full")


# --- blocks ---------------------------------------------------------------------------------------------------------


def link_destination(path: Column) -> Column:
    odd = path.rlike(rf"[{SPACE}()<>]")
    return F.when(odd, F.concat(F.lit("<"), F.replace(F.replace(path, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E")), F.lit(">"))).otherwise(path)


def table_markdown(rows: Column, flavor: str) -> Column:
    """A pipe table where the flavor has them and no cell needs more; else an HTML table."""
    def html_cell(c: Column) -> Column:
        span = lambda n: F.when(c[n] > 1, F.concat(F.lit(f' {n}="'), c[n].cast("string"), F.lit('"'))).otherwise("")
        inner = F.when(c["image"].isNotNull(), F.concat(F.lit('<img src="'), escape_html(c["image"]), F.lit('" alt="'), escape_html(c["text"]), F.lit('">'))).otherwise(escape_html(c["text"]))
        return F.concat(F.lit("<td"), span("rowspan"), span("colspan"), F.lit(">"), inner, F.lit("</td>"))

    html = F.concat(F.lit("<table>\n"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r["cells"], html_cell), ""), F.lit("</tr>\n"))), ""), F.lit("</table>\n\n"))
    if flavor in ("commonmark", "hedgedoc"):
        return html
    needs = F.exists(rows, lambda r: F.exists(r["cells"], lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1) | c["image"].isNotNull() | c["text"].contains("\n")))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r["cells"], lambda c: F.concat(F.lit(" "), c["text"], F.lit(" |"))), ""), F.lit("\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(rows[0]["cells"], lambda c: F.lit(" --- |")), ""), F.lit("\n"))
    pipe = F.concat(line(rows[0]), rule, F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line), ""), F.lit("\n"))
    return F.when(needs, html).when(F.size(rows) == 0, F.lit("")).otherwise(pipe)


def rendered_blocks(blocks: DataFrame, flavor: str = "commonmark") -> DataFrame:
    """Rows (doc_id, pos, md): the Markdown of each block."""
    if flavor not in FLAVORS:
        raise ValueError(f"flavor must be one of {FLAVORS}")
    b = headings(merged_paragraphs(blocks) if flavor == "markdownlint" else blocks)
    k = F.col("kind")
    texts = F.transform("items", lambda x: x["text"])
    marker = lambda i: F.when(F.col("ordered"), F.lit("1. ") if flavor == "markdownlint" else F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- ")
    b = b.withColumn("it", F.when(k == "list", texts)).withColumn("it_easy", ~F.exists("it", lambda x: ~_linkless(x)))
    b = b.withColumn("it", F.when(F.col("it_easy"), F.transform("it", _inline_native)).otherwise(_inline_items_arrow(F.when(F.col("it_easy"), F.lit(None)).otherwise(F.col("it")))))
    b = b.withColumn("pre", F.transform("it", lambda x, i: marker(i)))
    b = b.withColumn("it_easy", F.col("it_easy") & ~F.exists("it", lambda x: ~_short_tokens(x, WIDTH - 12)))
    native = F.zip_with("it", "pre", lambda t, p: trim_end(F.concat(p, F.replace(_plain_wrap(t, F.lit(WIDTH) - F.length(p)), F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(p)))))))
    slow = _wrap_items_arrow(F.when(F.col("it_easy"), F.lit(None)).otherwise(F.col("it")), F.when(F.col("it_easy"), F.lit(None)).otherwise(F.col("pre")))
    b = b.withColumn("list_md", F.concat(F.array_join(F.transform(F.when(F.col("it_easy"), native).otherwise(slow), lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("\n")))
    b = b.withColumn("flat", F.when(k.isin("paragraph", "text", "footnote"), inline(F.coalesce("text", F.lit("")))).when(k == "heading", F.col("overflow")))
    b = b.withColumn("lines", wrapped(F.coalesce("flat", F.lit(""))))
    head = F.concat(F.repeat(F.lit("#"), F.col("out_level")), F.lit(" "), F.col("heading"), F.lit("\n\n"))
    image = F.concat(F.lit("!["), F.coalesce("alt", F.lit("")), F.lit("]("), link_destination(F.col("path")), F.coalesce(F.concat(F.lit(' "'), F.col("title"), F.lit('"')), F.lit("")), F.lit(")\n\n"))
    md = (
        F.when(F.col("promoted"), head)
        .when(k == "heading", F.concat(head, F.when(F.col("overflow").isNotNull() & (F.col("overflow") != ""), F.concat("lines", F.lit("\n\n"))).otherwise("")))
        .when(k == "paragraph", F.concat("lines", F.lit("\n\n")))
        .when(k == "text", F.col("flat"))
        .when(k == "list", F.col("list_md"))
        .when(k == "table", table_markdown(F.col("rows"), flavor))
        .when(k == "image", image)
        .when(k == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), trim_end(F.coalesce("text", F.lit(""))), F.lit("\n```\n\n")))
        .when(k == "footnote", F.concat(F.lit("[^"), F.col("label"), F.lit("]: "), F.col("lines"), F.lit("\n\n")))
        .when(k == "raw", F.concat(trim(F.col("text")), F.lit("\n")))
    )
    return b.select("doc_id", "pos", md.alias("md"))


def html_output(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, markdown) of the HTML format: headings, paragraphs and text as HTML, other blocks as GFM Markdown each by itself."""
    k = F.col("kind")
    alone = F.struct("doc_id", "pos")
    other = rendered_blocks(blocks.filter(~k.isin("heading", "paragraph", "text")).withColumn("key", alone).withColumn("doc_id", F.col("key")), "gfm").select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.pos").alias("pos"), F.regexp_replace("md", r"\n{2,}\z", "\n").alias("md"))
    own = F.when(k == "text", escape_html(F.col("text"))).when(k == "paragraph", F.concat(F.lit("<p>"), escape_html(F.col("text")), F.lit("</p>\n"))).otherwise(F.concat(F.lit("<h"), F.col("level").cast("string"), F.lit(">"), escape_html(F.col("text")), F.lit("</h"), F.col("level").cast("string"), F.lit(">\n")))
    return joined(blocks.filter(k.isin("heading", "paragraph", "text")).select("doc_id", "pos", own.alias("md")).unionByName(other), False)


def joined(rendered: DataFrame, trim_tail: bool = True) -> DataFrame:
    """Rows (doc_id, markdown): a document's blocks in order."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]), "")
    return rendered.groupBy("doc_id").agg((F.regexp_replace(whole, r"\n{2,}\z", "\n") if trim_tail else whole).alias("markdown"))


def markdown(blocks: DataFrame, flavor: str = "commonmark", output: str = "markdown") -> DataFrame:
    """Rows (doc_id, markdown); ``output`` is markdown, mdx (the same) or html."""
    return html_output(blocks) if output == "html" else joined(rendered_blocks(blocks, flavor))


# --- interrupted paragraphs -----------------------------------------------------------------------------------------


def _joined(a: Column, b: Column) -> Column:
    """Two parts of a paragraph, with a space where two words meet."""
    left, right = F.regexp_extract(a, r"(.)\z", 1), F.substring(b, 1, 1)
    word = r"\A[A-Za-z0-9]\z"
    meet = (
        (left.rlike(word) & right.rlike(word)) | (left.rlike(r"\A[^\x00-\x7F]\z") & right.rlike(word)) | (left.rlike(word) & right.rlike(r"\A[^\x00-\x7F]\z"))
        | (left.rlike(r"\A[A-Za-z]\z") & (right == "&")) | ((left == "&") & right.rlike(r"\A[A-Za-z]\z"))
    )
    return F.concat(a, F.when(meet, F.lit(" ")).otherwise(""), b)


STARTS_BLOCK = r"(?:#|[-*+] |```|[0-9]+[.)](?: |\z))"
ENDS_SENTENCE = r"[.。!！?？:：;；)）\]】\"”]"


def merged_paragraphs(blocks: DataFrame, starts_block: str = STARTS_BLOCK, stays=None) -> DataFrame:
    """``blocks`` with paragraphs that break off mid-sentence joined to the next; ``pos`` stays that of the first part.

    Whether two neighbours may join is seen from the two alone, so runs are islands of a window. ``stays(text, first)`` says what
    more may keep a part from growing; it sees the part as joined so far, so islands are folded part by part. By
    default a document's first part stays if it is a title.
    """
    stays = stays or (lambda text, first: first & promotes(text))
    doc = Window.partitionBy("doc_id").orderBy("pos")
    b = blocks.withColumn("t", F.when(F.col("kind") == "paragraph", F.col("text")))
    last = F.lag("t").over(doc)
    starts, ends = F.col("t").rlike(rf"\A[{SPACE}]*{starts_block}"), last.rlike(rf"{ENDS_SENTENCE}[{SPACE}]*\z")
    joins = F.col("t").isNotNull() & last.isNotNull() & (trim(last) != "") & (trim(F.col("t")) != "") & ~starts & ~ends
    b = b.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(doc))
    parts = b.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("ts"))
    part = lambda x, t: F.array(F.struct(x["pos"].alias("pos"), t.alias("t")))

    def grow(acc: Column, x: Column) -> Column:
        end = F.element_at(acc, -1)
        first = (F.col("island") == 1) & (F.size(acc) == 1)
        longer = _joined(trim_end(end["t"]), F.regexp_replace(x["t"], rf"\A[{SPACE}]+", ""))
        return F.when(stays(end["t"], first), F.concat(acc, part(x, x["t"]))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), part(end, longer)))

    head = F.col("ts")[0]
    folded = parts.filter(F.size("ts") > 1).select("doc_id", F.explode(F.aggregate(F.slice("ts", 2, F.size("ts")), part(head, head["t"]), grow)).alias("m"))
    folded = folded.select(F.col("doc_id").alias("m_doc"), F.col("m.pos").alias("m_pos"), F.col("m.t").alias("m_t"))
    b = b.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "island")))
    met = b.join(folded, b["doc_id"].eqNullSafe(folded["m_doc"]) & (b["pos"] == folded["m_pos"]), "left").filter((F.col("n") == 1) | F.col("m_pos").isNotNull())
    return met.select(*[F.when(F.col("m_pos").isNotNull(), F.col("m_t")).otherwise(F.col("text")).alias("text") if c == "text" else b[c].alias(c) for c in blocks.columns])

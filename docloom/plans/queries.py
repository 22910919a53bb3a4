"""Registered queries over whole tables, one or more for each operator, with equivalent SQL where SQL has the means.

Inventories, text runs and tables that no driver table holds are derived from driver tables by the same expressions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..integrations import models
from ..operators import blocks_text, corpus, html, markdown, metrics, office, pdf, report
from ..options import Options
from ..schema import BLOCK, block
from ..sources import files as src
from .convert import convert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """Documents over all cores: a small file is one task, and whole texts are compared in quadratic time."""
    return _t(spark, d, "documents").repartition(4 * spark.sparkContext.defaultParallelism)


def _f(template: str, x: str) -> str:
    return template.replace("{}", x)


# Pieces of SQL that several oracles share.
SAN = r"regexp_replace(regexp_replace(html, '(?is)<script.*?(?:</script>|\z)', '', 'g'), '(?is)<style.*?(?:</style>|\z)', '', 'g')"
STRIP = r"regexp_replace({}, '<[^>]*(?:>|\z)|>', '', 'g')"
DECODE = "replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
PLAIN = _f(DECODE, STRIP)
WS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
COLLAPSE = rf"regexp_replace(regexp_replace({{}}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _bodies(tag: str) -> str:
    return rf"regexp_extract_all({SAN}, '(?is)<{tag}(?:>|[ \n\t/][^>]*>)(.*?)</{tag}>', 1)"


# --- HTML -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT page_id AS doc_id, kind, n FROM (
  SELECT page_id, 'heading' AS kind, len({_bodies('h1')}) AS n FROM pages UNION ALL
  SELECT page_id, 'paragraph', len({_bodies('p')}) FROM pages UNION ALL
  SELECT page_id, 'list', len({_bodies('ul')}) FROM pages) WHERE n > 0""")
def h1_html_blocks(spark, d):
    return html.html_blocks(_t(spark, d, "pages")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {SAN} AS clean FROM pages")
def h2_remove_blocks(spark, d):
    return _t(spark, d, "pages").select("page_id", html.sanitized(F.col("html")).alias("clean"))


@query(f"""SELECT doc_id, n, {_f(PLAIN, 'body')} AS text FROM (SELECT page_id AS doc_id, unnest(b) AS body, unnest(range(1, len(b) + 1)) AS n FROM (SELECT page_id, {_bodies('p')} AS b FROM pages))""")
def h5_paragraph_texts(spark, d):
    from pyspark.sql import Window

    p = html.html_blocks(_t(spark, d, "pages")).filter("kind = 'paragraph'")
    return p.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long").alias("n"), "text")


@query(rf"""SELECT page_id AS doc_id, len(items) AS n_items, {_f(PLAIN, "array_to_string(items, '|')")} AS items FROM (
  SELECT page_id, regexp_extract_all({_bodies('ul')}[1], '(?is)<li[^>]*>(.*?)</li>', 1) AS items FROM pages) WHERE len(items) > 0""")
def h6_lists(spark, d):
    b = html.html_blocks(_t(spark, d, "pages")).filter("kind = 'list'")
    return b.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i["text"]), "|").alias("items"))


_NATION_HTML = "'<table><tr><th>name</th><th>key</th></tr>' || string_agg('<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>', '' ORDER BY n_nationkey) || '</table><img src=\"' || n_regionkey || '.png\" alt=\"a\">'"


def _nation_pages(spark, d) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    g = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    page = F.concat(F.lit("<table><tr><th>name</th><th>key</th></tr>"), "rows", F.lit('</table><img src="'), F.col("n_regionkey").cast("string"), F.lit('.png" alt="a">'))
    return g.select(F.col("n_regionkey").cast("long").alias("page_id"), page.alias("html"))


@query("""SELECT n_regionkey::BIGINT AS doc_id, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |' || chr(10), '' ORDER BY n_nationkey) || chr(10) AS md FROM nation GROUP BY 1""")
def w12_pipe_tables(spark, d):
    b = html.html_blocks(_nation_pages(spark, d)).filter("kind = 'table'")
    return b.select("doc_id", markdown.table_markdown(F.col("rows"), "gfm").alias("md"))


@query("""SELECT n_regionkey::BIGINT AS doc_id, '<table>' || chr(10) || '<tr><td>name</td><td>key</td></tr>' || chr(10) || string_agg('<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>' || chr(10), '' ORDER BY n_nationkey) || '</table>' || chr(10) || chr(10) AS md FROM nation GROUP BY 1""")
def h7_html_tables(spark, d):
    b = html.html_blocks(_nation_pages(spark, d)).filter("kind = 'table'")
    return b.select("doc_id", markdown.table_markdown(F.col("rows"), "commonmark").alias("md"))


@query("SELECT DISTINCT n_regionkey::BIGINT AS doc_id, 'image caption inference failed: ' || n_regionkey || '.png' AS warning FROM nation")
def h9_image_warnings(spark, d):
    return html.html_warnings(_nation_pages(spark, d)).select("doc_id", "warning")


@query("SELECT DISTINCT n_regionkey::BIGINT AS doc_id, n_regionkey || '.png' AS path, 'image-reference' AS source, 0.0::DOUBLE AS confidence FROM nation")
def m3_media_candidates(spark, d):
    return report.media_candidates(html.html_blocks(_nation_pages(spark, d))).select("doc_id", "path", "source", "confidence")


@query("SELECT n_regionkey::BIGINT AS doc_id, 'out/' || n_regionkey || '/' || n_regionkey || '.png' AS path FROM nation GROUP BY 1, 2")
def m5_rewrite_media(spark, d):
    return report.rewrite_media(html.html_blocks(_nation_pages(spark, d)), None, "out").filter("kind = 'image'").select("doc_id", "path")


@query(f"SELECT doc_id, {_f(PLAIN, 'text')} AS text FROM documents WHERE {_f(COLLAPSE, _f(PLAIN, 'text'))} <> ''")
def h10_fallback(spark, d):
    docs = _t(spark, d, "documents")
    return html.html_blocks(docs, "doc_id", "text").select("doc_id", "text")


# --- text functions -------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {_f(STRIP, 'html')} AS text FROM pages")
def f1_strip_tags(spark, d):
    return _t(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_f(DECODE, 'html')} AS text FROM pages")
def f2_decode_entities(spark, d):
    return _t(spark, d, "pages").select("page_id", T.decode_entities(F.col("html")).alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM pages")
def f3_escape_html(spark, d):
    return _t(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("text"))


@query(r"SELECT page_id, '\"' || replace(replace(replace(html, '\', '\\'), '\"', '\\\"'), chr(10), '\n') || '\"' AS text FROM pages".replace('\\"', '"').replace("'\\\\\"'", "'\\\"'"))
def f4_escape_json(spark, d):
    return _t(spark, d, "pages").select("page_id", T.json_string(F.col("html")).alias("text"))


@query("SELECT page_id, base64(encode(html)) AS text FROM pages")
def f5_base64(spark, d):
    return _t(spark, d, "pages").select("page_id", T.base64(F.col("html").cast("binary")).alias("text"))


@query("SELECT page_id, 'data:image/png;base64,' || base64(encode(url)) AS uri FROM pages")
def k4_data_uris(spark, d):
    return _t(spark, d, "pages").select("page_id", T.data_uri(F.lit("x/y.PNG"), F.col("url").cast("binary")).alias("uri"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'html' WHEN page_id % 3 = 1 THEN 'md' ELSE 'html' END AS fmt FROM pages")
def s4_detect_format(spark, d):
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.col("page_id").cast("string"), F.lit(".HTM"))).when(F.col("page_id") % 3 == 1, "a/b.md").otherwise("noext")
    return _t(spark, d, "pages").select("page_id", src.detected_format(name, F.col("html").cast("binary")).alias("fmt"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'code' END AS kind, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text, CASE WHEN doc_id % 2 = 1 THEN 'csv' END AS language FROM documents")
def s6_text_sources(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("csv").alias("fmt"), F.col("text").cast("binary").alias("content"))
    return src.text_blocks(docs).select("doc_id", "kind", "text", "language")


# --- Markdown -------------------------------------------------------------------------------------------------------


def _order_headings(spark, d) -> DataFrame:
    o = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    b = block("heading", level=(F.col("q").cast("int") % 8), text=F.concat(F.lit("Part "), (F.col("q").cast("int") % 5).cast("string")))
    return o.select(F.col("l_orderkey").cast("long").alias("doc_id"), F.col("l_linenumber").cast("int").alias("pos"), *[b.getField(f).alias(f) for f in BLOCK])


_HEADINGS = """WITH o AS (SELECT l_orderkey::BIGINT AS doc_id, l_linenumber::INT AS pos, max(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM o),
t AS (SELECT *, CASE WHEN i = 1 THEN 1 WHEN q % 8 = 1 THEN 2 ELSE least(greatest(q % 8, 1), 6) END AS t FROM h)"""


@query(f"""{_HEADINGS} SELECT doc_id, pos, (i + min(t - i) OVER (PARTITION BY doc_id ORDER BY i))::INT AS level FROM t""")
def w4_heading_levels(spark, d):
    return markdown.headings(_order_headings(spark, d)).select("doc_id", "pos", F.col("out_level").alias("level"))


@query(f"""{_HEADINGS}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, q % 5 ORDER BY pos) AS again FROM t)
SELECT doc_id, pos, 'Part ' || (q % 5) || CASE WHEN again > 1 THEN ' (' || again || ')' ELSE '' END AS heading FROM u""")
def w5_unique_headings(spark, d):
    return markdown.headings(_order_headings(spark, d)).select("doc_id", "pos", "heading")


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_f(COLLAPSE, 'text')}, '(.{{1,80}})(?: |$)', '\\1' || chr(10), 'g'), '\\n+$', '') AS lines FROM documents WHERE NOT regexp_matches(text, '[^\\s\\x{{A0}}]{{81,}}')")
def w7_wrapped_text(spark, d):
    t = T.collapse(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", markdown.wrapped(t).alias("lines"))


@query()
def w2_markdown(spark, d):
    return markdown.markdown(html.html_blocks(_t(spark, d, "pages")), "gfm")


@query()
def w9_inline_links(spark, d):
    return _t(spark, d, "pages").select("page_id", markdown.inline(F.concat(F.lit("see "), F.col("url"), F.lit(" or mail a_b@c.org, *now*"))).alias("md"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '[\\s()<>]') THEN '<' || replace(replace(url, '<', '%3C'), '>', '%3E') || '>' ELSE url END AS dest FROM pages""")
def w13_link_destinations(spark, d):
    return _t(spark, d, "pages").select("page_id", markdown.link_destination(F.col("url")).alias("dest"))


@query()
def w14_merged_paragraphs(spark, d):
    b = block("paragraph", text=F.col("t"))
    p = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).select("doc_id", "pos", *[b.getField(f).alias(f) for f in BLOCK])
    return markdown.merged_paragraphs(p).select("doc_id", "pos", "text")


@query()
def w1_html_output(spark, d):
    return markdown.markdown(html.html_blocks(_t(spark, d, "pages")), output="html")


@query()
def u10_markdown_blocks(spark, d):
    return blocks_text.markdown_blocks(_t(spark, d, "documents"), "text").select("doc_id", "pos", "kind", "level", "text")


@query()
def u11_prompt_markdown(spark, d):
    return blocks_text.prompt_markdown(html.html_blocks(_t(spark, d, "pages")))


@query()
def u9_rejections(spark, d):
    b = html.html_blocks(_t(spark, d, "pages"))
    return models.rejections("restructure", b, b.filter("kind <> 'list' OR doc_id % 2 = 0"))


@query("SELECT page_id, 'external send consent is required for OpenAI; ' || strlen(html) || ' byte(s) would be sent' AS message FROM pages")
def u7_send_confirmation(spark, d):
    return _t(spark, d, "pages").select("page_id", models.send_confirmation(Options(llm="openai"), F.col("html")).alias("message"))


@query("""SELECT doc_id, '--- before' || chr(10) || '+++ after' || chr(10) || '@@' || chr(10) || ' same' || chr(10) || '-' || lang || chr(10) || '+' || source || chr(10) || '-tail' || chr(10) AS diff FROM documents""")
def k7_line_diff(spark, d):
    before, after = F.concat(F.lit("same\n"), "lang", F.lit("\ntail\n")), F.concat(F.lit("same\n"), "source")
    return _t(spark, d, "documents").select("doc_id", blocks_text.line_diff(before, after).alias("diff"))


# --- conversions ----------------------------------------------------------------------------------------------------


def _converted(spark, d, **options):
    pages = _t(spark, d, "pages")
    docs = src.from_bytes(pages, F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.col("html"), "page_id")
    return convert(docs, Options(**options), ["html"])


@query()
def s2_convert_pages(spark, d):
    return _converted(spark, d, flavor="gfm").results().select("doc_id", "name", "fmt", "status", "markdown")


@query()
def k2_report_json(spark, d):
    return _converted(spark, d).report_json()


@query("SELECT page_id AS doc_id, key, value FROM (SELECT page_id, 'bytes' AS key, strlen(html)::VARCHAR AS value FROM pages)")
def m8_metadata(spark, d):
    return _converted(spark, d).metadata.filter("key = 'bytes'").select("doc_id", "key", "value")


@query("SELECT page_id AS doc_id, 'format:markdown,flavor:gfm,ocr:auto' || CASE WHEN html LIKE '%<ul%' THEN ',media:referenced' ELSE '' END AS tags FROM pages")
def m4_features(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.array_join(report.features(Options(flavor="gfm", ocr="auto"), F.col("html").contains("<ul")), ",").alias("tags"))


@query("SELECT page_id AS doc_id, 'Unsupported input format: x' || (strlen(html) % 9) AS text FROM pages")
def s15_unsupported(spark, d):
    docs = src.from_bytes(_t(spark, d, "pages"), F.concat(F.lit("a.b/file.X"), (F.octet_length("html") % 9).cast("string")), F.col("html"), "page_id")
    return convert(docs, Options(), ["other"]).blocks.select("doc_id", "text")


# --- metrics --------------------------------------------------------------------------------------------------------

# RE2 has no lookahead: the letters are captured and put back.
_MARKED = r"regexp_replace(regexp_replace(replace(text, '.', chr(10)), '\n (Th|D)', chr(10) || '# \1', 'g'), '\n (E|O)', chr(10) || '| \1', 'g')"
_LINES = "SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END AS l FROM documents)"


@query(rf"""WITH documents AS (SELECT doc_id, {_MARKED} AS text FROM main.documents), l AS ({_LINES}), m AS (SELECT doc_id, n, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS t, line FROM l),
e AS (SELECT doc_id, n, t, line, lag(t) OVER w AS p, lead(t) OVER w AS f FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
c AS (SELECT doc_id, sum(CASE WHEN t LIKE '#%' THEN (coalesce(p, '') <> '')::INT + (coalesce(f, '') <> '')::INT ELSE 0 END
  + CASE WHEN t LIKE '- %' THEN (coalesce(p, '') <> '')::INT + (coalesce(f, '') <> '')::INT ELSE 0 END
  + CASE WHEN t LIKE '|%' THEN (coalesce(p, '') <> '' AND p NOT LIKE '|%')::INT + (coalesce(f, '') <> '' AND f NOT LIKE '|%')::INT ELSE 0 END) AS k,
  max((line LIKE '% ')::INT) AS s FROM e GROUP BY doc_id)
SELECT doc_id, (k + s + (text NOT LIKE '%' || chr(10))::INT)::BIGINT AS errors FROM c JOIN documents USING (doc_id)""")
def q4_lint(spark, d):
    md = F.translate(F.col("text"), ".", "\n")
    md = F.regexp_replace(F.regexp_replace(md, r"\n (?=Th|D)", "\n# "), r"\n (?=E|O)", "\n| ")
    return metrics.lint(_t(spark, d, "documents").select("doc_id", md.alias("markdown"))).select("doc_id", "errors")


@query()
def q3_table_integrity(spark, d):
    return metrics.table_integrity(_t(spark, d, "documents").select("doc_id", F.col("text").alias("markdown")))


@query(rf"""WITH e AS (SELECT page_id AS doc_id, {_f(PLAIN, _bodies('h1') + '[1]')} AS h FROM pages)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND t <> '' AND t NOT LIKE '%#' AND t NOT LIKE '%' || chr(10) || '%' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM (SELECT doc_id, regexp_replace(h, '^{WS}+|{WS}+$', '', 'g') AS t FROM e WHERE h IS NOT NULL)""")
def q2_heading_recall(spark, d):
    b = html.html_blocks(_t(spark, d, "pages")).filter("kind = 'heading'")
    md = b.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), "text", F.lit("\n"))).otherwise(F.lit("text\n")).alias("markdown"))
    return metrics.heading_recall(b, md).select("doc_id", "score")


_SEGMENTS = "SELECT c_custkey AS k, c_name AS a, c_mktsegment AS b, c_nationkey AS n FROM customer"


@query(f"SELECT k, levenshtein(a, b)::BIGINT AS errors, round(1 - least(levenshtein(a, b) / greatest(length(a), 1), 1.0), 9)::DOUBLE AS score FROM ({_SEGMENTS})")
def q5_character_errors(spark, d):
    c = metrics.character_errors(_t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("expected"), F.col("c_mktsegment").alias("actual")), "k")
    return c.select("k", "errors", F.round("score", 9).alias("score"))


@query("""WITH g AS (SELECT n_regionkey AS r, n_nationkey % 2 AS o, string_agg(n_name, '' ORDER BY n_nationkey) AS a, string_agg(r_name, '' ORDER BY n_nationkey) AS b FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT 'ocr_cer:' || r || ':' || o AS name, levenshtein(a, b)::BIGINT AS errors FROM g""")
def q6_errors_by_group(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = n.select(F.col("n_nationkey").alias("ord"), F.col("n_regionkey").cast("string").alias("language"), (F.col("n_nationkey") % 2).cast("string").alias("orientation"), F.col("n_name").alias("expected"), F.col("r_name").alias("actual"))
    return metrics.character_errors_by_group(c).select("name", "errors")


@query()
def q5_whole_texts(spark, d):
    c = metrics.character_errors(_spread(spark, d).select("doc_id", F.col("text").alias("expected"), F.reverse("text").alias("actual")), "doc_id")
    return c.select("doc_id", "errors", F.round("score", 9).alias("score"))


@query()
def q6_whole_texts(spark, d):
    c = _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("language"), (F.col("doc_id") % 2).cast("string").alias("orientation"), F.col("text").alias("expected"), F.col("source").alias("actual"))
    return metrics.character_errors_by_group(c).select("name", "errors")


@query()
def q7_structure_preserved(spark, d):
    p = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("# a\n- b\n"), "text").alias("before"), F.concat(F.lit("# a\n| b\n"), "text").alias("after"))
    return metrics.structure_preserved(p)


@query()
def q1_structure_fidelity(spark, d):
    b = html.html_blocks(_t(spark, d, "pages"))
    return metrics.structure_fidelity(b, b.filter("kind <> 'list' OR doc_id % 2 = 0"))


@query("SELECT count(*) AS total, count(*) FILTER (source = source || CASE WHEN n_chars % 3 = 0 THEN lang ELSE '' END) AS passed, count(*) FILTER (n_chars % 3 = 0) AS failed, 0::BIGINT AS lint_errors FROM documents")
def q9_golden(spark, d):
    c = _t(spark, d, "documents").select("doc_id", F.concat("source", F.lit("\n")).alias("expected"), F.concat("source", F.when(F.col("n_chars") % 3 == 0, F.col("lang")).otherwise(""), F.lit("\n")).alias("actual"))
    return metrics.golden(c)


# --- corpus ---------------------------------------------------------------------------------------------------------

_PATH = "'d' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.exe' ELSE '.html' END"
_STATUS = "CASE WHEN n_chars % 7 = 0 THEN 'error' WHEN n_chars % 11 = 0 THEN 'timeout' ELSE 'ok' END"
_A = f"SELECT {_PATH} AS path, {_STATUS} AS status, n_chars AS elapsed_ms FROM documents"
_B = f"SELECT {_PATH} AS path, CASE WHEN quality = 1 THEN 'ok' ELSE 'error' END AS status, doc_id * 13 % 3000 AS elapsed_ms FROM labels"


def _path():
    return F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".exe").otherwise(".html"))


def _a(spark, d):
    n = F.col("n_chars")
    return _t(spark, d, "documents").select(_path().alias("path"), F.when(n % 7 == 0, "error").when(n % 11 == 0, "timeout").otherwise("ok").alias("status"), n.alias("elapsed_ms"))


def _b(spark, d):
    return _t(spark, d, "labels").select(_path().alias("path"), F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"), (F.col("doc_id") * 13 % 3000).alias("elapsed_ms"))


@query(f"SELECT path FROM ({_A}) WHERE path LIKE '%.html'")
def r1_supported(spark, d):
    return corpus.supported(_a(spark, d)).select("path")


@query(f"SELECT path FROM ({_A}) WHERE path NOT IN (SELECT path FROM ({_B}) WHERE status <> 'error')")
def r2_remaining(spark, d):
    return corpus.remaining(_a(spark, d).select("path"), _b(spark, d), ["error"])


@query("""SELECT doc_id, s AS status, CASE WHEN s IN ('ok', 'empty') THEN length(text) ELSE 0 END AS chars, CASE WHEN s IN ('ok', 'empty') THEN sha256(text) ELSE '' END AS sha256 FROM (
  SELECT doc_id, text, CASE WHEN n_chars % 11 = 0 THEN 'timeout' WHEN n_chars % 13 = 0 THEN 'error' WHEN trim(text, chr(10) || chr(9) || ' ') = '' THEN 'empty' ELSE 'ok' END AS s FROM documents)""")
def r3_inventory(spark, d):
    r = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("markdown"), F.when(F.col("n_chars") % 11 == 0, "timeout").when(F.col("n_chars") % 13 == 0, "broken").alias("error"), F.lit(0).alias("elapsed_ms"))
    return corpus.inventory(r).select(F.col("path").alias("doc_id"), "status", "chars", "sha256")


@query(f"""SELECT coalesce(a.path, b.path) AS path, coalesce(a.status, 'missing') AS a_status, coalesce(b.status, 'missing') AS b_status,
CASE WHEN a.status = 'ok' AND b.status = 'ok' THEN 'both_ok' WHEN a.status = 'ok' THEN 'a_only' WHEN b.status = 'ok' THEN 'b_only' ELSE 'neither' END AS outcome FROM ({_A}) a FULL JOIN ({_B}) b ON a.path = b.path""")
def r5_full_outer_pairing(spark, d):
    return corpus.paired(_a(spark, d), _b(spark, d))


@query(f"SELECT status, count(*) AS n FROM ({_A}) GROUP BY 1")
def r6_status_counts(spark, d):
    return corpus.status_counts(_a(spark, d), "status")


@query(f"SELECT path, status FROM ({_A}) ORDER BY path LIMIT 50")
def r8_first_fifty(spark, d):
    return corpus.first_of(_a(spark, d), 50, "path")[0].select("path", "status")


@query(f"SELECT greatest(count(*) - 50, 0) AS remaining FROM ({_A})")
def r8_remaining_count(spark, d):
    return corpus.first_of(_a(spark, d), 50, "path")[1]


@query(f"SELECT status, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path)::INT AS rank FROM ({_A})) WHERE rank <= 10")
def r9_first_per_bucket(spark, d):
    return corpus.first_per_bucket(_a(spark, d), "status", 10, "path").select("status", "path", "rank")


@query("SELECT source AS directory_id, count(*) AS file_count FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id < 5) GROUP BY 1")
def r11_targets(spark, d):
    docs = _t(spark, d, "documents")
    dirs = docs.groupBy(F.col("source").alias("directory_id")).agg(F.count("*").alias("file_count")).withColumn("directory_name", F.col("directory_id"))
    return corpus.targets(dirs, docs.filter("doc_id < 5").select(F.col("source").alias("directory_id")).distinct()).select("directory_id", "file_count")


@query(f"SELECT a.path, b.elapsed_ms FROM ({_A}) a JOIN ({_B}) b ON a.path = b.path WHERE a.status = 'timeout' AND b.status = 'ok'")
def r13_timeouts_elsewhere_ok(spark, d):
    return corpus.timeouts_elsewhere_ok(_a(spark, d), _b(spark, d))


@query(f"SELECT path, n_name AS candidate FROM ({_A}), nation")
def r14_probe_plan(spark, d):
    return corpus.probe_plan(_a(spark, d).select("path"), _t(spark, d, "nation").select(F.col("n_name").alias("candidate")))


_LANG = "CASE WHEN length(regexp_replace(left(text, 200000), '^\\s+|\\s+$', '', 'g')) < 80 OR j + l < 40 THEN 'unknown' WHEN j / (j + l) >= 0.25 AND l / (j + l) >= 0.25 THEN 'mixed-ja-latin' WHEN j / (j + l) >= 0.25 THEN 'ja' WHEN l / (j + l) >= 0.70 THEN 'latin' ELSE 'other' END"


@query(f"SELECT doc_id, {_LANG} AS language FROM (SELECT doc_id, text, len(regexp_extract_all(left(text, 200000), '[A-Za-z]')) AS l, len(regexp_extract_all(left(text, 200000), '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]')) AS j FROM documents)")
def r15_language(spark, d):
    return _t(spark, d, "documents").select("doc_id", corpus.language_of(F.col("text")).alias("language"))


@query("SELECT doc_id, CASE WHEN lang = 'en' OR source = 'src0' THEN 'unknown' WHEN lang = source THEN 'pass' ELSE 'warn' END AS status FROM documents")
def r16_language_status(spark, d):
    m = lambda c, v: F.when(F.col(c) == v, "unknown").otherwise(F.col(c))
    return _t(spark, d, "documents").select("doc_id", corpus.language_status(m("lang", "en"), m("source", "src0")).alias("status"))


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'unknown' WHEN n_chars * (doc_id % 3 + 1) // 3 < 200 OR (n_chars * (doc_id % 3 + 1) // 3) / n_chars < 0.45 OR (n_chars % 100) / 100.0 < 0.35 THEN 'warn' ELSE 'pass' END AS status FROM documents")
def r17_content_status(spark, d):
    return _t(spark, d, "documents").select("doc_id", corpus.content_status(F.col("n_chars"), F.floor(F.col("n_chars") * (F.col("doc_id") % 3 + 1) / 3), F.col("n_chars") % 100 / 100).alias("status"))


@query()
def r18_shingle_overlap(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.col("html"), T.plain(html.sanitized(F.col("html"))).alias("text"))
    return p.select("page_id", F.round(corpus.shingle_overlap(F.col("text"), F.col("html")), 6).alias("overlap"))


@query()
def r19_engine_scores(spark, d):
    t = F.col("text")
    r = _spread(spark, d).select(F.col("lang").alias("engine"), F.when(F.col("doc_id") % 2 == 0, "horizontal").otherwise("vertical").alias("orientation"), F.col("source").alias("font"), t.alias("expected"), F.reverse(t).alias("actual"))
    e = corpus.engine_scores(r)
    return e.select("engine", "key", F.round("strip", 6).alias("strip"), F.round("nfkc", 6).alias("nfkc"), "n")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def r20_argmax(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", corpus.argmax(F.col("embedding")).alias("best"))


@query()
def r20_ctc_greedy(spark, d):
    path = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.floor(x * 20)).cast("int"))
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    return _t(spark, d, "embeddings").select("vec_id", corpus.ctc_greedy(path, letters).alias("text"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (x < y) AS wins, count(*) FILTER (x = y) AS ties, count(*) FILTER (x > y) AS losses, sum(x)::BIGINT AS a_total, avg(x) AS a_mean, median(x) AS a_median, quantile_cont(x, 0.95) AS a_p95,
sum(y)::BIGINT AS b_total, avg(y) AS b_mean, median(y) AS b_median, quantile_cont(y, 0.95) AS b_p95 FROM (SELECT a.elapsed_ms AS x, b.elapsed_ms AS y FROM ({_A}) a JOIN ({_B}) b ON a.path = b.path WHERE a.status = 'ok' AND b.status = 'ok')""")
def r21_speed_comparison(spark, d):
    return corpus.speed_comparison(_a(spark, d), _b(spark, d))


# --- PDF and Office structure ---------------------------------------------------------------------------------------


def _objects(spark, d) -> DataFrame:
    t = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return t.withColumn("font_size", F.when(F.col("ord") % 9 == 4, 18.0).otherwise(11.0))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE t <> '' AND NOT regexp_matches({_f(COLLAPSE, 't')}, '(?is)^(?:|[0-9]{{1,4}}|.*(?:©|copyright).*|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}})$') GROUP BY 1")
def pd17_text_filter(spark, d):
    o = _objects(spark, d)
    return o.filter(pdf.is_human_text(F.col("text")) & ~pdf.is_page_noise(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def pd18_text_blocks(spark, d):
    return pdf.text_blocks(_objects(spark, d)).select("doc_id", "pos", "kind", "level", "text", F.size("items").alias("n_items"))


@query("SELECT l_orderkey::BIGINT AS k, l_linenumber::BIGINT AS n, CASE WHEN l_linenumber > 6 THEN NULL ELSE least(l_linenumber, 6) END::INT AS level FROM lineitem")
def pd20_section_levels(spark, d):
    text = F.concat(F.array_join(F.array_repeat(F.lit("1"), F.col("l_linenumber").cast("int")), "."), F.lit(" Title"))
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("long").alias("n"), pdf.section_level(text).alias("level"))


@query(rf"""SELECT doc_id, n::INT AS pos, CASE WHEN strlen(t) < 80 AND regexp_matches(t, '\p{{Lu}}') AND t NOT LIKE '%.' THEN 'heading' ELSE 'paragraph' END AS kind, t AS text FROM (SELECT doc_id, n - 1 AS n, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS t FROM ({_LINES})) WHERE t <> ''""")
def pd24_plain_headings(spark, d):
    return pdf.plain_headings(_t(spark, d, "documents")).select("doc_id", "pos", "kind", "text")


@query("""SELECT doc_id, rank FROM (SELECT l_orderkey::BIGINT AS doc_id, l_linenumber::INT AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 25 THEN l_linenumber END NULLS LAST, l_extendedprice DESC, l_linenumber) AS p FROM lineitem) WHERE p = 1""")
def pd1_best_result(spark, d):
    c = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("doc_id"), F.col("l_linenumber").cast("int").alias("rank"), (F.col("l_quantity") > 25).alias("usable"), F.lit(False).alias("ocr_required"), F.col("l_extendedprice").alias("score"))
    return pdf.best_result(c).select("doc_id", "rank")


@query("""WITH w AS (SELECT l_orderkey::BIGINT AS doc_id, l_linenumber::INT AS n, l_extendedprice AS x0, l_extendedprice + l_quantity AS x1 FROM lineitem), c AS (SELECT doc_id, row_number() OVER v - 1 AS col, coalesce((lag(x1) OVER v + x0) / 2, '-inf'::DOUBLE) AS lo, coalesce((x1 + lead(x0) OVER v) / 2, 'inf'::DOUBLE) AS hi FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY x0))
SELECT w.doc_id, w.n, c.col::INT AS col FROM w JOIN c ON w.doc_id = c.doc_id AND w.x0 >= c.lo AND w.x0 < c.hi""")
def pd14_words_in_columns(spark, d):
    w = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("doc_id"), F.lit(0).alias("page"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("x1"))
    return pdf.words_in_columns(w, pdf.columns_from_header(w)).select("doc_id", "n", "col")


@query("SELECT l_orderkey::BIGINT AS k, l_linenumber::BIGINT AS n, (l_linenumber * 26 + l_linenumber)::INT AS col FROM lineitem")
def e4_column_numbers(spark, d):
    letter = F.substring(F.lit("ABCDEFGHIJ"), F.col("l_linenumber").cast("int"), F.lit(1))
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("long").alias("n"), office.column_number(F.concat(letter, letter)).alias("col"))


def _sheet_parts(spark, d) -> DataFrame:
    cell = lambda c, v: F.concat(F.lit(f'<c r="{c}'), F.col("s_suppkey").cast("string"), F.lit('"><v>'), v, F.lit("</v></c>"))
    row = F.concat(F.lit("<row>"), cell("A", F.lit("")), cell("B", T.escape_html(F.col("s_name"))), cell("C", F.col("s_suppkey").cast("string")), F.lit("</row>"))
    g = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    xml = F.concat(F.lit("<worksheet><sheetData>"), "rows", F.lit("</sheetData></worksheet>"))
    return g.select(F.col("s_nationkey").cast("long").alias("doc_id"), F.lit("xl/worksheets/sheet1.xml").alias("part"), xml.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))


@query("SELECT s_nationkey::BIGINT AS doc_id, count(*) AS n_rows, string_agg(s_name || ':' || s_suppkey, ',' ORDER BY s_suppkey) AS cells FROM supplier GROUP BY 1")
def e5_sheet_tables(spark, d):
    t = office.sheet_blocks(_sheet_parts(spark, d))
    return t.select("doc_id", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r["cells"], lambda c: c["text"]), ":")), ",").alias("cells"))


def _word_parts(spark, d) -> DataFrame:
    # Line 1 is a caption, every third line a picture, others paragraphs.
    n = F.col("l_linenumber").cast("int")
    p = F.when(n % 3 == 0, F.concat(F.lit('<w:p><a:blip r:embed="r'), n.cast("string"), F.lit('"/></w:p>'))).otherwise(F.concat(F.lit("<w:p><w:r><w:t>"), F.when(n % 3 == 1, "Figure ").otherwise("Body "), n.cast("string"), F.lit("</w:t></w:r></w:p>")))
    g = _t(spark, d, "lineitem").select("l_orderkey", n.alias("n"), p.alias("p")).distinct().groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]), "").alias("body"))
    xml = F.concat(F.lit("<w:document><w:body>"), "body", F.lit("</w:body></w:document>"))
    return g.select(F.col("l_orderkey").cast("long").alias("doc_id"), F.lit("word/document.xml").alias("part"), xml.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey::BIGINT AS doc_id, l_linenumber::INT AS n FROM lineitem), g AS (SELECT *, coalesce(sum((n % 3 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, CASE WHEN n % 3 = 1 THEN 'Figure ' || n END AS cap FROM l),
w AS (SELECT *, last_value(cap IGNORE NULLS) OVER (PARTITION BY doc_id, g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title FROM g)
SELECT doc_id, 'media/r' || n || '.png' AS path, coalesce(title, 'image') AS alt FROM w WHERE n % 3 = 0""")
def d7_caption_carry(spark, d):
    return office.word_blocks(_word_parts(spark, d)).filter("kind = 'image'").select("doc_id", "path", "alt")


def _slide_parts(spark, d) -> DataFrame:
    n = F.col("l_linenumber").cast("int")
    s = F.concat(F.lit('<p:sp><a:off x="'), (n * 10).cast("string"), F.lit('" y="'), (F.lit(1000) - n * 100).cast("string"), F.lit('"/><a:p><a:t>t'), n.cast("string"), F.lit("</a:t></a:p></p:sp>"))
    g = _t(spark, d, "lineitem").select("l_orderkey", n.alias("n"), s.alias("s")).distinct().groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "").alias("body"))
    return g.select(F.col("l_orderkey").cast("long").alias("doc_id"), F.lit("ppt/slides/slide1.xml").alias("part"), F.concat(F.lit("<p:sld>"), "body", F.lit("</p:sld>")).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) - 1)::INT AS pos, 't' || n AS text FROM (SELECT DISTINCT l_orderkey::BIGINT AS doc_id, l_linenumber::INT AS n FROM lineitem)")
def p1_slide_order(spark, d):
    return office.slide_blocks(_slide_parts(spark, d)).select("doc_id", "pos", "text")


@query("SELECT doc_id, 'pptx shape grid looks like a pseudo table; kept as ordered text' AS warning FROM (SELECT l_orderkey::BIGINT AS doc_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) WHERE n >= 4")
def p8_pseudo_tables(spark, d):
    return office.slide_warnings(_slide_parts(spark, d)).filter(F.col("warning").contains("pseudo")).select("doc_id", "warning")


@query()
def o1_opendocument(spark, d):
    x = F.concat(F.lit('<office:text><text:h text:outline-level="2">'), T.escape_html(F.col("source")), F.lit("</text:h><text:p>"), T.escape_html(F.col("text")), F.lit("</text:p></office:text>"))
    p = _t(spark, d, "documents").select("doc_id", F.lit("content.xml").alias("part"), x.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    return office.opendocument_blocks(p).select("doc_id", "pos", "kind", "level", "text")

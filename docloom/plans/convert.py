"""Conversion of a corpus: files or bytes to blocks, Markdown, reports, media and warnings.

Formats are routed as filtered branches of one table, so each parser sees only its documents and contents that no
branch needs are not read. A document that fails is a row with a status.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base64, is_vector_image, mime_type
from ..integrations import models, ocr, plugins
from ..integrations.services import Services, once
from ..operators import blocks_text, html, markdown, office, pdf, report
from ..options import Options
from ..schema import BLOCK
from ..sources import files as src
from ..sources import packages
from ..sources import pdf as pdf_source

_COLUMNS = ["doc_id", "pos", *BLOCK]


@dataclass(frozen=True)
class Conversion:
    """Tables of one conversion, all keyed by ``doc_id``."""

    documents: DataFrame  # name, fmt, parse_fmt, length
    blocks: DataFrame
    warnings: DataFrame  # seq, stage, warning
    metadata: DataFrame  # seq, key, value
    options: Options
    errors: DataFrame | None = None  # doc_id, error: documents that failed as a whole
    diffs: DataFrame | None = None  # task, diff: what a model changed

    def markdown(self) -> DataFrame:
        """Rows (doc_id, markdown); a document without blocks has an empty text."""
        md = markdown.markdown(self.blocks, self.options.flavor, self.options.format)
        return self.documents.select("doc_id").join(md, "doc_id", "left").na.fill("", ["markdown"])

    def media(self) -> DataFrame:
        return report.media_candidates(self.blocks)

    def reports(self) -> DataFrame:
        """A row per document with the columns of a report."""
        w = self.warnings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stage", "seq", "warning"))), lambda x: x["warning"]).alias("warnings"))
        m = self.metadata.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "key", "value"))), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("metadata"))
        p = report.media_paths(self.blocks)
        c = self.media().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "media_id", "path", "caption", "source", "confidence"))).alias("media_candidates"))
        r = self.documents.join(w, "doc_id", "left").join(m, "doc_id", "left").join(p, "doc_id", "left").join(c, "doc_id", "left")
        o, none = self.options, F.array().cast("array<string>")
        media = F.coalesce("media", none)
        by_path = F.col("fmt").isin(*src.PACKAGES)
        ocr, llm = o.ocr != "none", o.llm != "none"
        return r.select(
            "doc_id", F.col("name").alias("input_path"), F.col("fmt").alias("input_format"), F.lit(o.format).alias("output_format"), F.lit(o.flavor).alias("flavor"), F.coalesce("warnings", none).alias("warnings"),
            F.coalesce("metadata", F.array().cast("array<struct<key:string,value:string>>")).alias("metadata"), F.lit(0).cast("long").alias("elapsed_ms"),
            (F.lit(ocr) & ~by_path).alias("used_ocr"), F.when(F.lit(ocr) & ~by_path, F.lit(o.ocr)).alias("ocr_engine"), (F.lit(llm) & ~by_path).alias("used_llm"), F.when(~by_path, F.lit(o.llm_destination)).alias("llm_destination"),
            media.alias("media"), F.coalesce("media_candidates", F.array().cast("array<struct<pos:int,sub:int,media_id:string,path:string,caption:string,source:string,confidence:double>>")).alias("media_candidates"),
            report.features(o, F.size(media) > 0).alias("features"),
        )

    def report_json(self) -> DataFrame:
        return report.report_json(self.reports())

    def results(self) -> DataFrame:
        """Rows (doc_id, name, fmt, status, n_warnings, error, markdown): ``error`` for failed documents and, if strict, for warned ones, else ok or empty."""
        r = self.documents.join(self.markdown(), "doc_id")
        bad = self.warnings.groupBy("doc_id").agg(F.count("*").alias("n_warnings"))
        r = r.join(bad, "doc_id", "left").na.fill(0, ["n_warnings"])
        r = r.join(self.errors, "doc_id", "left") if self.errors is not None else r.withColumn("error", F.lit(None).cast("string"))
        status = F.when(F.col("error").isNotNull() | (F.lit(self.options.strict) & (F.col("n_warnings") > 0)), "error").when(F.trim("markdown") == "", "empty").otherwise("ok")
        return r.select("doc_id", "name", "fmt", status.alias("status"), "n_warnings", "error", "markdown")


def _warned(df: DataFrame, stage: str, text: Column | str) -> DataFrame:
    t = F.lit(text) if isinstance(text, str) else text
    return df.select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit(stage).alias("stage"), t.alias("warning"))


def _pdf(files: DataFrame, options: Options, services: Services) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, warnings, errors) of PDF files: the best extractor's runs, recognized pages where text is missing; what still needs recognition fails."""
    best = pdf.judged(pdf_source.text_objects(files, all_candidates=True), files)
    runs = best.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.page", "r.ord", "r.text", "r.font_size")
    bad = best.filter("ocr_required")
    if options.ocr != "none":
        images = ocr.rasterized(files, services.rasterize)
        pages = images.select("doc_id", "page").join(runs.groupBy("doc_id", "page").agg(F.collect_list("text").alias("lines")), ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
        asked = images.join(ocr.pages_to_read(pages, bad.select("doc_id")), ["doc_id", "page"], "left_semi")
        read = once(ocr.recognized(asked, services.recognize))
        runs = pdf.merge_ocr_pages(runs, read)
        bad = bad.join(read.filter(F.trim("text") != "").select("doc_id"), "doc_id", "left_anti")
    runs = runs.join(bad.select("doc_id"), "doc_id", "left_anti")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")) - 1
    made = pdf.text_blocks(runs.select("doc_id", order.alias("ord"), "text", "font_size"))
    message = F.concat(F.lit("PDF text extraction produced no text with backend "), "backend", F.lit(". A full PDF backend or OCR may be required."))
    said = _warned(best.filter("NOT usable"), "pdf", message).unionByName(_warned(files, "pdf", "PDF parser extracts text objects; coordinates and layout inference are limited."))
    return made, said, bad.select("doc_id", F.regexp_replace("status", r"\Aerror: ", "").alias("error"))


def convert(inputs: DataFrame, options: Options = Options(), formats: list[str] | None = None, as_files: bool = True, services: Services = Services()) -> Conversion:
    """Convert rows (doc_id, name, length, content). With ``formats`` only branches of those formats are planned.

    Options that need a model, a recognizer or a rasterizer use those of ``services`` and fail without them.
    ``as_files`` unzips packages; bytes alone (``as_files=False``) are never unzipped, as in-memory XML parts may be given instead.
    """
    docs = inputs.withColumn("fmt", src.detected_format(F.col("name"), F.col("content")))
    docs = docs.withColumn("parse_fmt", src.parse_format(F.col("fmt"), F.col("content")))
    f = F.col("parse_fmt")
    wanted = lambda *names: not formats or bool(set(names) & set(formats))
    services.check(options)
    blocks: list[DataFrame] = []
    errors: list[DataFrame] = []
    warnings: list[DataFrame] = []
    metadata: list[DataFrame] = [docs.select("doc_id", F.lit(0).alias("seq"), F.lit("bytes").alias("key"), F.when(_is_known(f), F.col("length").cast("string")).otherwise("not_read").alias("value"))]
    metadata.append(docs.filter(F.col("fmt") != f).select("doc_id", F.lit(1).alias("seq"), F.lit("container_format").alias("key"), f.alias("value")))
    if wanted("html"):
        pages = docs.filter(f == "html").select("doc_id", src.strict_text(F.col("content")).alias("html"))
        blocks.append(html.html_blocks(pages, "doc_id"))
        warnings.append(html.html_warnings(pages, "doc_id"))
    if wanted(*src.TEXTS):
        blocks.append(src.text_blocks(docs.filter(f.isin(*src.TEXTS))))
    if wanted("pdf", "ai"):
        d = docs.filter(f == "pdf")
        made, said, failed = _pdf(d, options, services)
        blocks.append(made)
        warnings.append(said)
        errors.append(failed)
    if as_files and wanted(*src.PACKAGES):
        parts = packages.parts(docs.filter(f.isin(*src.PACKAGES)).select("doc_id", "content"))
        for names, make, warn in (
            (("docx",), office.word_blocks, office.word_warnings), (("pptx",), office.slide_blocks, office.slide_warnings),
            (("xlsx", "xlsm"), office.sheet_blocks, office.sheet_warnings), (("odt", "ods", "odp"), office.opendocument_blocks, office.opendocument_warnings),
        ):
            if wanted(*names):
                blocks.append(make(parts))
                warnings.append(warn(parts))
        warnings.append(office.byte_warnings(parts))
        bad = docs.filter(f.isin(*src.PACKAGES)).join(parts.filter("part IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti")
        blocks.append(src.unsupported_blocks(bad, f))
        warnings.append(_warned(bad, "package", F.concat(F.lit("could not read package of format "), f)))
    if not as_files and wanted(*src.PACKAGES):
        text = src.strict_text(F.col("content"))
        xml = docs.filter(f.isin(*src.PACKAGES)).withColumn("xml", text)
        as_part = lambda fmt, mark, name: xml.filter((f == fmt) & F.col("xml").contains(mark)).select("doc_id", F.lit(name).alias("part"), "content", F.lit(None).cast("string").alias("error"))
        blocks.append(office.slide_blocks(as_part("pptx", "<p:sld", "ppt/slides/slide1.xml")))
        blocks.append(office.sheet_blocks(as_part("xlsx", "<worksheet", "xl/worksheets/sheet1.xml")))
        rest = xml.filter(~(((f == "pptx") & F.col("xml").contains("<p:sld")) | ((f == "xlsx") & F.col("xml").contains("<worksheet"))))
        blocks.append(src.unsupported_blocks(rest, F.when(f == "docx", "DOCX in-memory input").when(f.isin("odt", "ods", "odp"), "OpenDocument in-memory input").otherwise(f)))
        warnings.append(_warned(rest, "package", F.when(f == "docx", "DOCX byte conversion cannot unzip in-memory input; use convert_file for DOCX.").when(f.isin("odt", "ods", "odp"), F.concat(F.upper(f), F.lit(" byte conversion cannot unzip in-memory input; use convert_file for OpenDocument."))).otherwise(F.concat(F.lit("could not read "), f, F.lit(" package from in-memory bytes")))))
    if wanted(*src.IMAGES):
        pictures = docs.filter(f.isin(*src.IMAGES))
        if services.provider and models.may_send(options):
            asked = pictures.select("doc_id", F.lit(0).alias("pos"), F.lit("").alias("context"), mime_type(F.col("name")).alias("mime_type"), base64(F.col("content")).alias("data_base64"))
            told = models.described(asked, services.provider, options)
            blocks.append(blocks_text.markdown_blocks(told.filter("description IS NOT NULL"), "description"))
            warnings.append(_warned(told.filter("error IS NOT NULL"), "image", F.concat(F.lit("image description failed: "), "error")))
            blocks.append(src.unsupported_blocks(pictures.join(told.filter("error IS NOT NULL"), "doc_id", "left_semi"), F.lit("image input")))
        else:
            blocks.append(src.unsupported_blocks(pictures, F.lit("image input")))
            warnings.append(_warned(pictures, "image", "image input requires --llm with a vision-capable backend."))
    if not formats or "other" in formats:
        other = docs.filter(~_is_known(f))
        blocks.append(src.unsupported_blocks(other, f))
        warnings.append(_warned(other, "dispatch", F.concat(F.lit("unsupported input format: "), f)))
    every = blocks[0].select(*_COLUMNS)
    for b in blocks[1:]:
        every = every.unionByName(b.select(*_COLUMNS))
    said = warnings[0].select("doc_id", F.col("seq").cast("long").alias("seq"), "stage", "warning") if warnings else _warned(docs.limit(0), "none", "")
    for w in warnings[1:]:
        said = said.unionByName(w.select("doc_id", F.col("seq").cast("long").alias("seq"), "stage", "warning"))
    diffs = None
    tasks = (["restructure"] if options.restructure else []) + ([f"translate:{options.translate}"] if options.translate else [])
    for task in tasks:
        open_ = docs.filter(f.isin("html", "pdf", *src.TEXTS)).select("doc_id")  # packages and pictures are never sent
        new, told, change = models.filtered(every.join(open_, "doc_id", "left_semi"), services.provider, task, options)
        every = every.join(open_, "doc_id", "left_anti").select(*_COLUMNS).unionByName(new.select(*_COLUMNS))
        said = said.unionByName(told.select("doc_id", F.lit(1).cast("long").alias("seq"), "stage", "warning"))
        diffs = change if diffs is None else diffs.unionByName(change)
    if services.filters:
        every = plugins.apply(every, *services.filters)
    metadata.append(every.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(99).alias("seq"), F.lit("nodes").alias("key"), F.col("n").cast("string").alias("value")))
    meta = metadata[0]
    for m in metadata[1:]:
        meta = meta.unionByName(m)
    if options.extract_media:
        every = report.rewrite_media(every, docs, options.extract_media)
    elif options.inline_base64_media and as_files:
        every = report.rewrite_media(every, extracted_media(docs, every))
    return Conversion(docs.select("doc_id", "name", "fmt", "parse_fmt", "length"), every, said, meta, options, errors[0] if errors else None, diffs)


def _is_known(f: Column) -> Column:
    return f.isin("html", "pdf", *src.TEXTS, *src.PACKAGES, *src.IMAGES)


def extracted_media(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, path, content) of package members that blocks show."""
    paths = report.media_candidates(blocks).select("doc_id", "path", report.package_part(F.col("path")).alias("part")).distinct()
    members = packages.parts(docs.filter(F.col("fmt").isin(*src.PACKAGES)), packages.MEDIA).filter("part IS NOT NULL").select("doc_id", "part", "content")
    return paths.join(members, ["doc_id", "part"]).select("doc_id", "path", "content")


def vector_images(blocks: DataFrame) -> DataFrame:
    """Media that a rasterizer would have to draw."""
    return report.media_candidates(blocks).filter(is_vector_image(F.col("path")))

"""Media catalogue and conversion reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import data_uri, json_array, json_option, json_string, trim
from ..options import Options


def media_candidates(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, sub, media_id, path, caption, source, confidence): images of blocks and table cells, in order."""
    title = F.when(trim(F.col("title")) != "", F.col("title"))
    images = blocks.filter("kind = 'image'").select(
        "doc_id", "pos", F.lit(0).alias("sub"), F.col("path").alias("media_id"), "path", title.alias("caption"),
        F.when(title.isNotNull(), "image-title").otherwise("image-reference").alias("source"), F.when(title.isNotNull(), 1.0).otherwise(0.0).alias("confidence"),
    )
    cells = blocks.filter("kind = 'table'").select("doc_id", "pos", F.posexplode(F.flatten(F.transform("rows", lambda r: r["cells"]))).alias("sub", "c")).filter("c.image IS NOT NULL")
    text = F.when(trim(F.col("c.text")) != "", F.col("c.text"))
    cells = cells.select("doc_id", "pos", "sub", F.col("c.image").alias("media_id"), F.col("c.image").alias("path"), text.alias("caption"), F.lit("table-cell-image").alias("source"), F.when(text.isNotNull(), 0.8).otherwise(0.0).alias("confidence"))
    return images.unionByName(cells)


def media_paths(blocks: DataFrame, distinct: bool = True) -> DataFrame:
    """Rows (doc_id, media): sorted paths, or all of them in order."""
    m = media_candidates(blocks)
    if distinct:
        return m.groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("media"))
    return m.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "path"))), lambda x: x["path"]).alias("media"))


def features(options: Options, has_media: Column) -> Column:
    """Feature tags in their fixed order."""
    tags = [f"format:{options.format}", f"flavor:{options.flavor}"]
    tags += ["extract_media", f"extract_media_dir:{options.extract_media}"] if options.extract_media else []
    tags += ["inline_base64_media"] if options.inline_base64_media else []
    tags += [f"ocr:{options.ocr}"] if options.ocr != "none" else []
    tags += [f"llm:{options.llm_destination}"] if options.llm != "none" else []
    tags += ["llm:restructure"] if options.restructure else []
    tags += [f"llm:translate:{options.translate}"] if options.translate else []
    return F.array_compact(F.concat(F.array(*[F.lit(t) for t in tags]), F.array(F.when(has_media, F.lit("media:referenced")))))


def rewrite_media(blocks: DataFrame, media: DataFrame, folder: str | None = None) -> DataFrame:
    """``blocks`` with image paths replaced: by ``folder``/document/file, or by data URIs of ``media`` (doc_id, path, content)."""
    if folder is not None:
        to = lambda p: F.when(p.isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), media_file(F.col("doc_id"), p)))
        cells = lambda c: F.struct(c["text"].alias("text"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), to(c["image"]).alias("image"))
        return blocks.withColumns({"path": to(F.col("path")), "rows": F.transform("rows", lambda r: F.struct(F.transform(r["cells"], cells).alias("cells")))})
    uris = media.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path", data_uri(F.col("path"), F.col("content")).alias("uri")))).alias("uris"))
    b = blocks.join(uris.withColumnRenamed("doc_id", "u_doc"), F.col("doc_id") == F.col("u_doc"), "left")
    to = lambda p: F.coalesce(F.try_element_at("uris", p), p)
    cells = lambda c: F.struct(c["text"].alias("text"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), to(c["image"]).alias("image"))
    return b.withColumns({"path": to(F.col("path")), "rows": F.transform("rows", lambda r: F.struct(F.transform(r["cells"], cells).alias("cells")))}).drop("u_doc", "uris")


def media_file(doc_id: Column, path: Column) -> Column:
    """Where a document's picture is put: a folder for each document, as nearly all packages call their first picture alike."""
    return F.concat(doc_id.cast("string"), F.lit("/"), F.regexp_extract(path, r"([^/]*)\z", 1))


def package_part(path: Column) -> Column:
    """The member of a Word package that an image path names."""
    return F.when(path.startswith("word/"), path).otherwise(F.concat(F.lit("word/media/"), F.regexp_replace(path, r"\A(?:\./)?media/", "")))


def report_json(reports: DataFrame) -> DataFrame:
    """Rows (doc_id, json): reports with keys in fixed order and a line end; absent values are null."""
    flag = lambda c: F.col(c).cast("string")
    pair = lambda m: F.concat(F.lit('{"key":'), json_string(m["key"]), F.lit(',"value":'), json_string(m["value"]), F.lit("}"))
    one = lambda m: F.concat(
        F.lit('{"media_id":'), json_string(m["media_id"]), F.lit(',"path":'), json_string(m["path"]), F.lit(',"caption":'), json_option(m["caption"]),
        F.lit(',"source":'), json_string(m["source"]), F.lit(',"confidence":'), F.regexp_replace(m["confidence"].cast("string"), r"\.0\z", ""), F.lit("}"),
    )
    fields = [
        ("input_path", json_string(F.col("input_path"))), ("input_format", json_string(F.col("input_format"))), ("output_format", json_string(F.col("output_format"))), ("flavor", json_string(F.col("flavor"))),
        ("warnings", json_array(F.col("warnings"))), ("metadata", F.concat(F.lit("["), F.array_join(F.transform("metadata", pair), ","), F.lit("]"))), ("elapsed_ms", flag("elapsed_ms")),
        ("used_ocr", flag("used_ocr")), ("ocr_engine", json_option(F.col("ocr_engine"))), ("used_llm", flag("used_llm")), ("llm_destination", json_option(F.col("llm_destination"))),
        ("media", json_array(F.col("media"))), ("media_candidates", F.concat(F.lit("["), F.array_join(F.transform("media_candidates", one), ","), F.lit("]"))), ("features", json_array(F.col("features"))),
    ]
    body = [F.concat(F.lit(("," if i else "{") + f'"{n}":'), v) for i, (n, v) in enumerate(fields)]
    return reports.select("doc_id", F.concat(*body, F.lit("}\n")).alias("json"))

"""Files as rows, their formats, and text relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, extension, lossy_text, trim
from ..schema import BLOCK, block

# Formats by how they are read.
PACKAGES = ("docx", "pptx", "xlsx", "xlsm", "odt", "ods", "odp")
IMAGES = ("png", "jpg", "jpeg", "gif", "webp")
TEXTS = {"md": None, "txt": None, "csv": "csv", "xml": "xml", "svg": "xml", "gdoc": "json"}


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """Rows (doc_id, name, length, content) of a folder's files; ``content`` is read only where it is used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    r = r.option("pathGlobFilter", pattern) if pattern else r
    return r.load(path).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("name"), "length", "content")


def from_bytes(df: DataFrame, name: str | Column, content: str | Column, doc_id: str | Column) -> DataFrame:
    """Rows (doc_id, name, length, content) of any table with a binary or string column."""
    c = F.col(content) if isinstance(content, str) else content
    n = F.col(name) if isinstance(name, str) else name
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return df.select(d.cast("long").alias("doc_id"), n.alias("name"), F.length(c.cast("binary")).cast("long").alias("length"), c.cast("binary").alias("content"))


def detected_format(name: Column, content: Column) -> Column:
    """By extension, else by the first bytes."""
    ext = extension(name)
    start = F.substring(content, 1, 4)
    return F.when(ext == "htm", "html").when(ext != "", ext).when(start == F.lit(b"%PDF"), "pdf").when(F.substring(content, 1, 1) == F.lit(b"<"), "html").otherwise("unknown")


def parse_format(fmt: Column, content: Column) -> Column:
    """A PDF inside an ``ai`` file is parsed as one; the format stays ``ai``."""
    return F.when((fmt == "ai") & (F.substring(content, 1, 4) == F.lit(b"%PDF")), "pdf").otherwise(fmt)


def strict_text(content: Column) -> Column:
    """Bytes as UTF-8; an invalid text is empty."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit(""))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of text-like documents (doc_id, fmt, content): text as it stands, data in a fence."""
    t = trim(lossy_text(F.col("content")))
    fence = F.when(F.col("fmt") == "csv", "csv").when(F.col("fmt").isin("xml", "svg"), "xml").when(F.col("fmt") == "gdoc", "json")
    b = block(F.when(fence.isNull(), "raw").otherwise("code"), text=t, language=fence)
    return docs.select("doc_id", F.lit(0).alias("pos"), *[b.getField(f).alias(f) for f in BLOCK])


def unsupported_blocks(docs: DataFrame, what: Column) -> DataFrame:
    """A paragraph that names the format of each document that cannot be converted."""
    b = block("paragraph", text=F.concat(F.lit("Unsupported input format: "), what))
    return docs.select("doc_id", F.lit(0).alias("pos"), *[b.getField(f).alias(f) for f in BLOCK])


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def last_by_path(df: DataFrame, order: str) -> DataFrame:
    """One row a path: the last in ``order``."""
    return df.groupBy("path").agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def write_tsv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def source_text(fmt: Column, content: Column) -> Column:
    """Text of a source for inspection: markup without tags, other texts as they stand."""
    t = lossy_text(content)
    return F.when(fmt.isin("html", "htm", "xml", "svg"), trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), rf"[{SPACE}]+", " "))).otherwise(t)

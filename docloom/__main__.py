"""``python -m docloom INPUT [options]``: convert files of a folder or pattern to Markdown tables or files."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from . import options as opts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("input")
    p.add_argument("-o", "--output", help="folder for a Markdown file a document; without it texts go to standard output")
    p.add_argument("--tables", help="folder for Parquet tables of results, blocks, warnings and reports")
    p.add_argument("--config")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--flavor")
    p.add_argument("--format")
    p.add_argument("--ocr")
    p.add_argument("--llm")
    p.add_argument("--translate")
    for service in ("provider", "recognizer", "rasterizer"):
        p.add_argument(f"--{service}", help="a function, as module:name")
    p.add_argument("--filter", action="append", default=[], help="a registered block filter")
    for flag in ("extract-media", "inline-base64-media", "restructure", "strict", "consent-external-send"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def settings(args: argparse.Namespace) -> opts.Options:
    """Defaults, then a user's configuration, then ``--config``, then flags."""
    o = opts.apply_user_config()
    o = opts.load_config(args.config, o) if args.config else o
    if args.extract_media and not args.output:
        raise ValueError("--extract-media needs --output")
    new = {k: f(getattr(args, k)) or getattr(o, k) for k, f in (("flavor", opts.parse_flavor), ("format", opts.parse_format), ("ocr", opts.parse_ocr)) if getattr(args, k)}
    new |= opts.parse_llm(args.llm) if args.llm else {}
    new |= {"translate": args.translate} if args.translate else {}
    new |= {k: True for k in ("inline_base64_media", "restructure", "strict", "consent_external_send") if getattr(args, k)}
    new |= {"extract_media": os.path.join(args.output, "media")} if args.extract_media else {}
    return replace(o, **new)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        o = settings(args)
    except ValueError as e:
        print(e)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .integrations import ocr
    from .integrations.services import Services, named
    from .operators import report
    from .plans.convert import convert, extracted_media
    from .sources import files, sinks

    recognize = named(args.recognizer) if args.recognizer else ocr.command_recognizer(o.ocr) if o.ocr not in ("none", "auto") else None
    services = Services(named(args.provider) if args.provider else None, recognize, named(args.rasterizer) if args.rasterizer else None, tuple(args.filter))
    try:
        services.check(o)
    except ValueError as e:
        print(e)
        return 2
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    found = files.files(spark, args.input, recursive=args.recursive)
    # Only branches of formats that are there are planned; a name without extension may be any.
    by_name = files.detected_format(F.col("name"), F.lit(None).cast("binary"))
    there = {r[0] for r in found.select(by_name).distinct().collect()}
    formats = None if there & {"unknown", "ai"} else [*there, "other"]
    c = convert(found, o, formats, services=services)
    results = c.results()
    if o.strict and (bad := results.filter("status = 'error'").count()):
        print(f"{bad} document(s) with warnings")
        return 1
    if args.tables:
        sinks.write_tables(c, args.tables)
    if args.output:
        named_files = sinks.file_names(results, "name").withColumn("file", F.concat("file", F.lit(".html" if o.format == "html" else ".md")))
        sinks.write_files(named_files, args.output, "file", "markdown")
        if o.extract_media:
            media = extracted_media(found.withColumn("fmt", by_name), convert(found, replace(o, extract_media=None), formats, services=services).blocks)
            sinks.write_files(media.withColumn("file", report.media_file(F.col("doc_id"), F.col("path"))).dropDuplicates(["file"]), o.extract_media, "file", "content")
    elif not args.tables:
        for r in results.orderBy("name").toLocalIterator():
            print(r["markdown"], end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

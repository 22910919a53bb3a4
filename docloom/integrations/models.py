"""Language-model filters over blocks: consent, prompts, provider calls, validation. No provider is called by default.

A provider is a function of a request dict (backend, task, input, images) that returns text. It runs in Arrow batches, and
only on rows that the consent predicate let through: the filter is part of the input, never of the output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, base64, mime_type, trim
from ..operators.blocks_text import line_diff, markdown_blocks, prompt_markdown, text_length
from ..options import LOCAL_BACKENDS, Options
from ..schema import BLOCK
from .services import once

Provider = Callable[[dict], str]
# What each task asks for where no prompt is configured.
PROMPTS = {
    "restructure": "Restructure this Markdown. Keep every fact, heading, list, table, image, code block and footnote. Return Markdown only.",
    "translate": "Translate this Markdown into {language}. Keep its structure. Return Markdown only.",
    "vision:describe": "Describe this image as Markdown.",
}
DESTINATIONS = {"anthropic": "Anthropic", "gemini": "Gemini", "openai": "OpenAI"}
KEPT_KINDS = ("list", "table", "image", "code", "footnote")


def destination(options: Options) -> str | None:
    """Where content would go, or None if it stays on this machine."""
    if options.llm in LOCAL_BACKENDS:
        return None
    return DESTINATIONS.get(options.llm) or options.llm_endpoint or options.llm_model


def may_send(options: Options) -> bool:
    return options.llm != "none" and (options.llm == "ollama" or options.consent_external_send)


def send_confirmation(options: Options, content: Column) -> Column:
    """The message about what would be sent, null for local backends."""
    to = destination(options)
    if to is None:
        return F.lit(None).cast("string")
    n = F.octet_length(content).cast("string")
    if options.consent_external_send:
        return F.concat(F.lit(f"external send consent granted for {to}; "), n, F.lit(" byte(s) will be sent"))
    return F.concat(F.lit(f"external send consent is required for {to}; "), n, F.lit(" byte(s) would be sent"))


def prompt(task: str, options: Options) -> str:
    key = task.split(":")[0] if task.startswith("translate:") else task
    text = options.llm_prompts.get(task) or options.llm_prompts.get(key) or PROMPTS[key]
    return text.replace("{language}", task.partition(":")[2])


def completed(docs: DataFrame, provider: Provider, task: str, options: Options, text_col: str = "markdown") -> DataFrame:
    """Rows (doc_id, response, error) of provider calls for rows (doc_id, text); without consent no row reaches the provider."""
    head, backend = prompt(task, options), options.llm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said: list[tuple[str | None, str | None]] = []
            for text in b.column(1).to_pylist():
                try:
                    said.append((provider({"backend": backend, "task": task, "input": f"{head}\n\n{text}", "images": []}), None))
                except Exception as e:  # noqa: BLE001  a failed call is a row
                    said.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.string())], names=["doc_id", "response", "error"])

    return docs.filter(F.lit(may_send(options))).select("doc_id", text_col).mapInArrow(run, "doc_id long, response string, error string")


def rejections(task: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (doc_id, reason): why a response is refused, null if it is not; ``before`` has all documents."""
    def counts(blocks: DataFrame, p: str) -> DataFrame:
        k = F.col("kind")
        c = blocks.groupBy("doc_id").agg(*[F.count_if(k == x).alias(f"{p}_{x}") for x in (*KEPT_KINDS, "heading")], F.count("*").alias(f"{p}_blocks"))
        return c.join(text_length(blocks).withColumnRenamed("n", f"{p}_chars"), "doc_id")

    m = counts(before, "b").join(counts(after, "a"), "doc_id", "left").na.fill(0)
    missing = F.array_join(F.array_compact(F.array(*[F.when((F.col(f"b_{x}") > 0) & (F.col(f"a_{x}") == 0), x) for x in KEPT_KINDS])), ", ")
    reason = F.when((F.col("a_blocks") == 0) | (F.col("a_chars") == 0), "empty Markdown response")
    if task == "restructure":
        reason = (
            reason.when(missing != "", F.concat(F.lit("structured attributes missing from response: "), missing))
            .when((F.col("b_heading") > 1) & (F.col("a_heading") * 2 < F.col("b_heading")), "heading count dropped below half of the source")
            .when((F.col("b_chars") > 0) & (F.col("a_chars") * 2 < F.col("b_chars")), "body text dropped below half of the source")
        )
    elif task.startswith("translate:"):
        reason = reason.when((F.col("b_blocks") > 1) & (F.col("a_blocks") <= 1), "translated Markdown collapsed to one block")
    return m.select("doc_id", reason.alias("reason"))


def filtered(blocks: DataFrame, provider: Provider, task: str, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, warnings, diffs): accepted responses replace a document's blocks, and the change is a line diff (doc_id, task, diff);
    failures and refusals leave the blocks and say why."""
    source = prompt_markdown(blocks)
    called = once(completed(source, provider, task, options))
    after = markdown_blocks(called.filter("response IS NOT NULL"), "response")
    why = source.select("doc_id").join(called.select("doc_id", "error"), "doc_id", "left").join(rejections(task, blocks, after), "doc_id", "left")
    tried = F.lit(may_send(options))
    message = (
        F.when(~tried, "LLM filter skipped because external send consent is not configured." if options.llm != "none" else "LLM options requested but no LLM backend was selected.")
        .when(F.col("error").isNotNull(), F.concat(F.lit(f"LLM {task} failed: "), F.col("error")))
        .when(F.col("reason").isNotNull(), F.concat(F.lit(f"LLM {task} response rejected: "), F.col("reason")))
        .otherwise(f"LLM {task} response accepted and diff saved.")
    )
    why = why.withColumn("ok", tried & F.col("error").isNull() & F.col("reason").isNull())
    good = why.filter("ok").select("doc_id")
    columns = ["doc_id", "pos", *BLOCK]
    new = blocks.join(good, "doc_id", "left_anti").select(*columns).unionByName(after.join(good, "doc_id", "left_semi").select(*columns))
    was, now = source.withColumnRenamed("markdown", "was"), prompt_markdown(after).withColumnRenamed("markdown", "now")
    diffs = good.join(was, "doc_id").join(now, "doc_id").select("doc_id", F.lit(task).alias("task"), line_diff(F.col("was"), F.col("now")).alias("diff"))
    return new, why.select("doc_id", F.lit(f"llm:{task}").alias("stage"), message.alias("warning")), diffs


def described(images: DataFrame, provider: Provider, options: Options) -> DataFrame:
    """Rows (doc_id, pos, description, error) for images (doc_id, pos, context, mime_type, data_base64); without consent none is sent."""
    head, backend, task = prompt("vision:describe", options), options.llm, "vision:describe"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said: list[tuple[str | None, str | None]] = []
            for context, kind, data in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                try:
                    text = provider({"backend": backend, "task": task, "input": f"{head}\n\n{context}", "images": [{"mime_type": kind, "data_base64": data}]})
                    said.append((text, None) if text.strip() else (None, "empty image description"))
                except Exception as e:  # noqa: BLE001  a failed call is a row
                    said.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.string())], names=["doc_id", "pos", "description", "error"])

    asked = images.filter(F.lit(may_send(options))).select("doc_id", "pos", "context", "mime_type", "data_base64")
    return once(asked.mapInArrow(run, "doc_id long, pos int, description string, error string"))


def images_to_describe(blocks: DataFrame, media: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, context, mime_type, data_base64) of untitled images that ``media`` (doc_id, path, content) has."""
    i = blocks.filter("kind = 'image' AND title IS NULL").join(media, ["doc_id", "path"])
    return i.select("doc_id", "pos", F.concat(F.lit("Existing image alt text: "), F.coalesce("alt", F.lit(""))).alias("context"), mime_type(F.col("path")).alias("mime_type"), base64(F.col("content")).alias("data_base64"))


def with_captions(blocks: DataFrame, described: DataFrame) -> DataFrame:
    """``blocks`` with titles from (doc_id, pos, description); a blank alt becomes the description's first 80 characters."""
    d = described.filter(trim(F.col("description")) != "").select(F.col("doc_id").alias("d_doc"), F.col("pos").alias("d_pos"), "description")
    m = blocks.join(d, (F.col("doc_id") == F.col("d_doc")) & (F.col("pos") == F.col("d_pos")), "left")
    alt = F.when(F.col("description").isNotNull() & (F.coalesce(F.regexp_replace("alt", rf"[{SPACE}]", ""), F.lit("")) == ""), F.substring(F.substring_index("description", "\n", 1), 1, 80)).otherwise(F.col("alt"))
    return m.withColumns({"alt": alt, "title": F.coalesce("title", "description")}).drop("d_doc", "d_pos", "description")

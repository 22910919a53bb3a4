"""Corpus analytics over inventories, inspections and texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, extension, trim
from .metrics import distance

# Extensions that conversion supports.
SUPPORTED = ["ai", "csv", "docx", "gdoc", "htm", "html", "md", "pdf", "pptx", "svg", "txt", "xlsm", "xlsx", "xml"]
INVENTORY = "path string, status string, elapsed_ms long, chars long, sha256 string, error string"


def supported(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(extension(F.col(path)).isin(SUPPORTED))


def remaining(files: DataFrame, done: DataFrame, retry: list[str] | None = None) -> DataFrame:
    """Files whose path is not done, or done with a status to try again: a left anti join."""
    kept = done if not retry else done.filter(~F.col("status").isin(retry))
    return files.join(kept.select("path"), "path", "left_anti")


def inventory(results: DataFrame) -> DataFrame:
    """Rows of the inventory from (path, markdown, error, elapsed_ms): ok, empty, error or timeout."""
    first = F.substring_index("markdown", "\n", 1)
    refused = first.rlike(r"\A#? ?Unsupported input format:")
    status = F.when(F.col("error") == "timeout", "timeout").when(F.col("error").isNotNull() | F.col("markdown").isNull() | refused, "error").when(F.regexp_replace("markdown", rf"[{SPACE}]", "") == "", "empty").otherwise("ok")
    ok = status.isin("ok", "empty")
    return results.select(
        "path", status.alias("status"), F.col("elapsed_ms").cast("long").alias("elapsed_ms"), F.when(ok, F.length("markdown")).otherwise(0).cast("long").alias("chars"),
        F.when(ok, F.sha2("markdown", 256)).otherwise("").alias("sha256"), F.coalesce("error", F.when(refused, first), F.lit("")).alias("error"),
    )


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two inventories by path: rows (path, a_status, b_status, outcome); absent rows are ``missing``."""
    left, right = a.select("path", F.col("status").alias("a_status")), b.select("path", F.col("status").alias("b_status"))
    met = left.join(right, "path", "full_outer").select("path", F.coalesce("a_status", F.lit("missing")).alias("a_status"), F.coalesce("b_status", F.lit("missing")).alias("b_status"))
    x, y = F.col("a_status") == "ok", F.col("b_status") == "ok"
    return met.withColumn("outcome", F.when(x & y, "both_ok").when(x, "a_only").when(y, "b_only").otherwise("neither"))


def status_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def warned(inspection: DataFrame) -> DataFrame:
    return inspection.filter((F.col("language_status") == "warn") | (F.col("content_status") == "warn"))


def first_of(df: DataFrame, limit: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first rows, and one row (remaining) with how many more there are."""
    return df.orderBy(*order).limit(limit), df.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))


def first_per_bucket(df: DataFrame, bucket: str | Column, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each bucket; Spark keeps only n rows a bucket and task before the shuffle."""
    w = Window.partitionBy(bucket).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def targets(directories: DataFrame, done: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Directories still to evaluate, smallest first."""
    d = directories.filter("file_count > 0")
    d = d.filter(F.col("directory_id").isin(ids)) if ids else d
    return d.join(done.select("directory_id"), "directory_id", "left_anti").orderBy("file_count", "directory_name")


def timeouts_elsewhere_ok(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths on which tool a timed out and tool b succeeded."""
    met = a.filter("status = 'timeout'").select("path").join(b.filter("status = 'ok'").select("path", "elapsed_ms"), "path")
    return met.orderBy("path")


def probe_plan(paths: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each path with each candidate; candidates are a stated few, so they are broadcast."""
    if candidates.limit(1001).count() > 1000:
        raise ValueError("at most 1000 candidates")
    return paths.crossJoin(F.broadcast(candidates))


SAMPLE = 200_000


def language_of(text: Column) -> Column:
    """Script class of a text's first 200,000 characters: ja, latin, mixed-ja-latin, other or unknown."""
    s = F.substring(text, 1, SAMPLE)
    # Counted by what is left without them: runs go at once, and no match is kept.
    without = lambda letters: F.length(s) - F.length(F.regexp_replace(s, f"[{letters}]+", ""))
    ja, latin = without("\u3040-\u30ff\u3400-\u9fff"), without("A-Za-z")
    few = (F.coalesce(F.length(trim(s)), F.lit(0)) < 80) | (ja + latin < 40)
    j, l = ja / (ja + latin), latin / (ja + latin)
    return F.when(few, "unknown").when((j >= 0.25) & (l >= 0.25), "mixed-ja-latin").when(j >= 0.25, "ja").when(l >= 0.70, "latin").otherwise("other")


def language_status(source: Column, markdown: Column) -> Column:
    return F.when((source == "unknown") | (markdown == "unknown"), "unknown").when(source == markdown, "pass").otherwise("warn")


def content_status(source_chars: Column, markdown_chars: Column, overlap: Column) -> Column:
    ratio = markdown_chars / F.greatest(source_chars, F.lit(1))
    return F.when(source_chars < 200, "unknown").when((markdown_chars < 200) | (ratio < 0.45) | (F.coalesce(overlap, F.lit(1.0)) < 0.35), "warn").otherwise("pass")


def overlap_of(a: str | None, b: str | None, size: int = 12) -> float | None:
    """Containment of a's character shingles in b's, by normal form, lower case and without whitespace; None for short texts.

    Texts over 200,000 characters are compared by their beginning, middle and end.
    """
    def grams(t: str | None) -> set[str] | None:
        t = re.sub(r"\s+", "", unicodedata.normalize("NFKC", t or "").lower())
        if len(t) > SAMPLE:
            third = SAMPLE // 3
            mid = max(0, len(t) // 2 - third // 2)
            t = t[:third] + t[mid : mid + third] + t[-third:]
        return {t[i : i + size] for i in range(len(t) - size + 1)} if len(t) >= 120 else None

    x, y = grams(a), grams(b)
    return None if x is None or y is None else len(x & y) / len(x)


@F.pandas_udf(T.DoubleType())
def shingle_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """``overlap_of`` for columns: slices of long strings cost a set of hashes here, and a quadratic scan inside SQL."""
    return pd.Series([overlap_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form, which has no native function."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def engine_scores(rows: DataFrame) -> DataFrame:
    """Rows (engine, key, strip, nfkc, n): mean character scores overall, by orientation and by font, from (engine, orientation, font, expected, actual)."""
    cer = lambda errors, e: 1 - F.least(errors / F.greatest(F.length(e), F.lit(1)), F.lit(1.0))
    strip = lambda c: F.regexp_replace(c, rf"[{SPACE}]+", "")
    t = rows.select("engine", "orientation", "font", *[f(F.col(c)).alias(f"{n}_{c}") for c in ("expected", "actual") for n, f in (("s", strip), ("n", lambda c: strip(nfkc(c))))])
    # Texts that the normal form leaves alone are compared once.
    other = (F.col("s_expected") != F.col("n_expected")) | (F.col("s_actual") != F.col("n_actual"))
    t = t.withColumns({"s": distance("s_expected", "s_actual"), "n": distance(F.when(other, F.col("n_expected")), F.when(other, F.col("n_actual")))})
    each = t.select("engine", "orientation", "font", cer(F.col("s"), F.col("s_expected")).alias("strip"), cer(F.coalesce("n", "s"), F.col("n_expected")).alias("nfkc"))
    keys = F.array(F.lit("overall"), F.concat(F.lit("orient:"), F.col("orientation")), F.concat(F.lit("font:"), F.col("font")))
    return each.select("engine", F.explode(keys).alias("key"), "strip", "nfkc").groupBy("engine", "key").agg(F.avg("strip").alias("strip"), F.avg("nfkc").alias("nfkc"), F.count("*").alias("n"))


def ctc_greedy(best: Column, alphabet: Column) -> Column:
    """Text of a CTC path: repeats collapsed, blanks (0) dropped, class i is the i-th character."""
    kept = F.filter(best, lambda x, i: (x != 0) & ((i == 0) | (x != F.get(best, i - 1))))
    return F.array_join(F.transform(kept, lambda i: F.try_element_at(alphabet, i)), "")


def argmax(scores: Column) -> Column:
    """Index of the first largest value."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def speed_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over paths both tools converted: wins, ties and losses of a, and total, mean, median and p95 of each."""
    met = a.filter("status = 'ok'").select("path", F.col("elapsed_ms").alias("x")).join(b.filter("status = 'ok'").select("path", F.col("elapsed_ms").alias("y")), "path")
    stats = [f(c).alias(f"{n}_{k}") for n, c in (("a", "x"), ("b", "y")) for k, f in (("total", F.sum), ("mean", F.avg), ("median", F.median), ("p95", lambda c: F.percentile(c, F.lit(0.95))))]
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("x") < F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") > F.col("y")).alias("losses"), *stats)

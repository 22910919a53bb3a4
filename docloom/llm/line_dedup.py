"""Line deduplication over overlapping windows of consecutive lines.

Native: DataFrame functions only. Every run of ``width`` (three) consecutive lines is hashed to 128 bits, the first
place of each repeated window is found by a partial aggregate, and the lines that later places cover are removed,
overlaps merged.

Defined results: places are ordered by (doc_id, line), a null doc_id last; a later place may be in the same document;
a null text has no lines and stays null; an empty text has one empty line; a document with fewer lines than ``width`` has no window and
stays whole; rows equal in doc_id and text are one document and share one result; rows equal in doc_id alone are
ordered by a hash of their texts. Extra columns pass through ``dedup_lines`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, let, stored


def covered_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (k, h, heads, tails) for each document that loses lines: its id, its text's hash, and the first line numbers (from 0)
    of the maximal covered runs, with the numbers after their last ones."""
    lines = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("k"), F.xxhash64("text").alias("h"), F.split("text", "\n").alias("l")).filter(F.size("l") >= width)
    part = lambda l, i: [F.get(l, i + j) for j in range(width)]
    windows = let(F.col("l"), lambda l: F.transform(F.sequence(F.lit(0), F.size(l) - width), lambda i: F.struct(i.alias("at"), F.xxhash64(*part(l, i)).alias("a"), F.xxhash64(F.lit("second"), *part(l, i)).alias("b"))))
    each = lines.select("k", "h", F.explode(windows).alias("w"))
    each = each.select("k", "h", F.col("w.at").alias("at"), F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    first = each.groupBy("a", "b").agg(F.min(F.struct("k", "h", "at")).alias("first"), F.max(F.struct("k", "h", "at")).alias("last"))
    # Stored, so that the adaptive planner may split the places of a very common window between tasks.
    first = stored(first.filter("first <> last").select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first"), "windows")
    later = each.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).filter(F.struct("k", "h", "at") > F.col("first"))
    # A document's own lines bound what is gathered for it.
    ats = later.groupBy("k", "h").agg(F.sort_array(F.collect_set("at")).alias("s"))
    heads = let(F.col("s"), lambda s: F.filter(s, lambda x, i: (i == 0) | (x > F.get(s, i - 1) + width)))
    tails = let(F.col("s"), lambda s: F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) > x + width)))
    return ats.select("k", "h", heads.alias("heads"), F.transform(tails, lambda x: x + width).alias("tails"))


def _kept(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` as struct columns (row, n_lines, n_removed, kept)."""
    cov = covered_lines(docs.select("doc_id", "text"), width)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("rk"), F.xxhash64("text").alias("rh"))
    met = rows.join(cov, (F.col("rk") == F.col("k")) & (F.col("rh") == F.col("h")), "left")
    text = F.col("row.text")
    # The lines between covered runs, a slice each: linear in the lines, however many runs there are.
    begin = lambda v, j: F.when(j == 0, 0).otherwise(F.get(v["tails"], j - 1))
    end = lambda v, j: F.coalesce(F.get(v["heads"], j), F.size(v["l"]))
    between = lambda v: F.flatten(F.transform(F.sequence(F.lit(0), F.size(v["heads"])), lambda j: F.slice(v["l"], begin(v, j) + 1, end(v, j) - begin(v, j))))
    left = let(F.struct(F.split(text, "\n").alias("l"), F.col("heads").alias("heads"), F.col("tails").alias("tails")), lambda v: F.array_join(between(v), "\n"))
    removed = F.aggregate(F.zip_with("heads", "tails", lambda a, e: e - a), F.lit(0), lambda n, x: n + x)
    clean = F.col("heads").isNull()
    return met.select(
        "row", F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"), F.when(clean, 0).otherwise(removed).cast("long").alias("n_removed"),
        F.when(clean, text).otherwise(left).alias("kept"),
    )


def line_counts(docs: DataFrame, width: int = 3) -> DataFrame:
    """A row per document: doc_id, n_lines, n_removed, kept (the text left)."""
    return _kept(docs, width).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "kept")


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; documents of which nothing is left go, those that were empty stay."""
    kept = _kept(docs, width).filter(F.col("n_removed") < F.greatest("n_lines", F.lit(1)))
    return kept.select(*[(F.col("kept") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])

"""Benchmark decontamination: broadcast n-gram windows of test items, scanned over all document words.

Native: DataFrame functions only. Each window of an item is filed under its longest word (first of the longest), so a
document word is looked up once in a broadcast hash table, and a hit is verified on the whole window in the same
pipelined stage: no document word is shuffled. A benchmark above ``block_bytes`` is taken in several blocks, each of a
proven size, with one scan per block.

Defined results: a null or empty text has no words; an item with fewer words than ``n`` is one window, an item
without words none; items with equal windows all count; overlapping windows cover a word once; repeated rows of one
doc_id are told apart by their text, and equal rows share one result; a null doc_id is a key like any other.
Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Separators of words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def windows_of(benchmark: DataFrame, n: int) -> DataFrame:
    """Rows (pivot, offset, gram, item_ids) for each distinct window; gram is its array of words."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    w = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.slice("w", i + 1, n))).alias("gram"))
    w = w.groupBy("gram").agg(F.collect_set("item_id").alias("item_ids"))
    longest = F.array_max(F.transform("gram", lambda x: F.length(x)))
    at = F.array_position(F.transform("gram", lambda x: F.length(x)), longest).cast("int") - 1
    return w.select(F.get("gram", at).alias("pivot"), at.alias("offset"), "gram", "item_ids")


def _blocks(grams: DataFrame, benchmark: DataFrame, n: int, block_bytes: int) -> list[DataFrame]:
    """The windows in blocks that may be broadcast: a window has at most n times the bytes of its share of the text."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    k = max(1, -(-2 * n * size // block_bytes))
    return [grams] if k == 1 else [grams.filter(F.pmod(F.xxhash64("gram"), F.lit(k)) == b) for b in range(k)]


def _scan(docs: DataFrame, block: DataFrame, keys: list[str], text_col: str, how: str) -> DataFrame:
    """Rows (keys, n_words, start, len, item_ids) of hits; if ``how`` is left, also a row without start for each document.

    Word 0 is empty and matches nothing: it carries the document's own row through the join.
    """
    each = docs.select(*keys, F.concat(F.array(F.lit("")), words_of(F.col(text_col))).alias("_w"))
    each = each.select(*keys, "_w", F.posexplode_outer("_w").alias("_at", "_word"))
    first = F.col("_at") - F.col("offset")
    same = (F.col("_word") == F.col("pivot")) & (first >= 1) & (F.slice("_w", first + 1, F.size("gram")) == F.col("gram"))
    met = each.join(F.broadcast(block), same, how)
    if how == "left":
        met = met.filter(F.coalesce(F.col("_at"), F.lit(0)).eqNullSafe(0) | F.col("gram").isNotNull())
    words = F.when(F.col("_w").isNull(), 0).otherwise(F.size("_w") - 1).cast("long")
    return met.select(*keys, words.alias("n_words"), (first - 1).alias("start"), F.when(F.col("gram").isNotNull(), F.size("gram")).alias("len"), "item_ids")


def hits(docs: DataFrame, benchmark: DataFrame, keys: list[str], text_col: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES, with_documents: bool = False) -> DataFrame:
    """Rows (keys, n_words, start, len, item_ids) for each place where a window occurs; word positions from 0."""
    grams, out = windows_of(benchmark, n), None
    for i, block in enumerate(_blocks(grams, benchmark, n, block_bytes)):
        got = _scan(docs, block, keys, text_col, "left" if with_documents and not i else "inner")
        out = got if out is None else out.unionByName(got)
    return out


def spans(found: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs (keys, start, stop) of words that hits cover."""
    each = found.groupBy(*keys, "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("far", F.max("stop").over(before))
    run = F.sum(F.when(F.col("far").isNull() | (F.col("start") > F.col("far")), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("start"))
    return each.withColumn("run", run).groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, item_list (sorted as strings, comma-joined), contaminated."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    # One scan of the texts; what it finds is small, stored, and read twice.
    scanned = stored(hits(docs, benchmark, ["doc_id", "_h"], n=n, block_bytes=block_bytes, with_documents=True), "hits")
    found = scanned.filter("start IS NOT NULL")
    covered = spans(found, ["doc_id", "_h"]).groupBy("doc_id", "_h").agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"))
    item = found.select("doc_id", "_h", F.explode("item_ids").alias("item")).distinct().groupBy("doc_id", "_h")
    items = item.agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item").cast("string"))), ",").alias("item_list"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_h"] == b["_h"])
    # A window of items without an id names no item, but its words are hit all the same.
    met = covered.join(items, same(covered, items), "left").select(covered["doc_id"], covered["_h"], "n_hit", "n_items", "item_list")
    base = scanned.filter("start IS NULL").select("doc_id", "_h", "n_words")
    return base.join(met, same(base, met), "left").select(
        base["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_list", F.lit("")).alias("item_list"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window occurs, with their own columns.

    Texts are read twice. The keys of contaminated documents are stored first, so their size is known: few are broadcast, for many
    the documents are shuffled.
    """
    bad = hits(documents.select("doc_id", "text", F.xxhash64("text").alias("_h")), benchmark, ["doc_id", "_h"], n=n, block_bytes=block_bytes)
    bad = stored(bad.select(F.col("doc_id").alias("_bad_id"), F.col("_h").alias("_bad_h")).distinct(), "contaminated")
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(documents["text"]) == bad["_bad_h"]), "left_anti")

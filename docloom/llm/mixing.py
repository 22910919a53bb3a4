"""Mixing sources to target weights by temperature.

Native: DataFrame functions only. A source with token share p gets weight p^a / sum(p^a). The exponent a is bisected
in [0, 1]: the largest at which the entropy of the weights reaches ``min_entropy_share`` of log(number of sources),
raised where needed until no source is repeated more than ``max_repeats`` times (that limit comes first, as a flat mix
repeats small sources). The tree of a bisection's next ``LEVELS`` midpoints is evaluated in one aggregate, so a bisection
takes a few small jobs whatever the number of sources. Weights become budgets of tokens: a source's documents are dealt into
blocks by hash, each epoch takes the blocks in an order of its own, and the block in which the budget ends is cut at a
document. Only blocks' sums meet in one window, at most ``MAX_BLOCKS`` a source, and one block's documents in another.

Defined results: a null source is a source of its own; texts without tokens (null and empty ones too) are never drawn;
an empty table gives an empty mix; a single source has weight 1; rows equal in doc_id, source and text are drawn
together and counted in ``n_rows``; ties in the permuted order are broken by doc_id and text hash; a budget that ends
inside a document leaves that document out; extra columns are ignored by ``draws`` and kept by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_TOKENS = 200_000
MAX_BLOCKS = 65_536
LEVELS, PASSES = 6, 5


def tokens_of(text: Column) -> Column:
    """Whitespace-separated tokens of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def choose_exponent(totals: DataFrame, budget_tokens: int, min_entropy_share: float, max_repeats: float) -> tuple[float, float]:
    """The exponent and its normaliser sum(p^a); ``totals`` has rows (p) with p > 0."""
    first = totals.agg(F.count("*").alias("n"), F.min("p").alias("least"), F.sum("n_tokens").alias("tokens")).first()
    if not first["n"]:
        return 1.0, 1.0
    n, least, scale = first["n"], first["least"], budget_tokens / first["tokens"]

    def sums(exponents: list[float]) -> dict[float, tuple[float, float]]:
        each = totals.select("p", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
        got = each.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.ln("p")).alias("y"))
        return {r["a"]: (r["z"], r["y"]) for r in got.collect()}  # as many rows as exponents

    def flat(a: float, z: float, y: float) -> bool:
        return math.log(z) - a * y / z >= min_entropy_share * math.log(n) - 1e-12

    def repeated(a: float, z: float, y: float) -> bool:
        return scale * least ** (a - 1) / z > max_repeats * (1 + 1e-12)

    def bisect(low_side) -> float:
        """The point of [0, 1] up to which ``low_side`` holds."""
        ends = sums([0.0, 1.0])
        if low_side(1.0, *ends[1.0]):
            return 1.0
        if not low_side(0.0, *ends[0.0]):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            k = 2**LEVELS
            points = [lo + (hi - lo) * i / k for i in range(1, k)]
            known, low, high = sums(points), 0, k
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if low_side(points[mid - 1], *known[points[mid - 1]]) else (low, mid)
            lo, hi = lo + (hi - lo) * low / k, lo + (hi - lo) * high / k
        return (lo + hi) / 2

    a = max(bisect(flat), bisect(repeated))
    return a, sums([a])[a][0]


def source_weights(totals: DataFrame, budget_tokens: int | None = None, min_entropy_share: float = 0.9, max_repeats: float = 4.0) -> DataFrame:
    """Rows (source, n_tokens, alpha, weight, budget) for ``totals`` (source, n_tokens > 0)."""
    every = totals.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
    budget = every if budget_tokens is None else budget_tokens
    shares = totals.withColumn("p", F.col("n_tokens") / F.lit(float(max(every, 1))))
    a, z = choose_exponent(shares, budget, min_entropy_share, max_repeats)
    w = F.pow("p", F.lit(a)) / F.lit(z)
    # Rounded, so that a sum's order, which may differ between runs, never moves a budget.
    return shares.select("source", "n_tokens", F.round(F.lit(a), 9).alias("alpha"), F.round(w, 9).alias("weight"), F.floor(F.round(w, 9) * budget).cast("long").alias("budget"))


def draws(docs: DataFrame, budget_tokens: int | None = None, min_entropy_share: float = 0.9, max_repeats: float = 4.0, block_tokens: int = BLOCK_TOKENS, seed: str = "mix") -> DataFrame:
    """A row per drawn document and epoch: doc_id, text_hash, source, n_tokens, n_rows, weight, epoch, block, block_rank, pos.

    Sorting by (epoch, block_rank, source, pos) gives the order of training.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", tokens_of(F.col("text")).alias("n_tokens")).filter("n_tokens > 0")
    # Texts are read once: the passes below take small rows from here.
    rows = stored(rows.groupBy("doc_id", "text_hash", "source", "n_tokens").agg(F.count("*").alias("n_rows")), "tokens")
    totals = stored(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_rows")).alias("n_tokens")), "totals")
    w = source_weights(totals, budget_tokens, min_entropy_share, max_repeats).select(F.col("source").alias("w_source"), F.col("n_tokens").alias("all_tokens"), "weight", "budget")
    # No hint: the planner broadcasts the weights where their measured size allows, and splits hot sources where not.
    met = rows.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    blocks = F.least(F.ceil(F.col("all_tokens") / block_tokens), F.lit(MAX_BLOCKS)).cast("long")
    met = met.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), blocks))
    met = met.withColumn("full", F.floor(F.col("budget") / F.col("all_tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("full") * F.col("all_tokens"))
    # The last, partial epoch, over the blocks' sums alone.
    sums = met.groupBy("source", "block", "full", "rest").agg(F.sum(F.col("n_tokens") * F.col("n_rows")).alias("b_tokens"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "full", "source", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("b_tokens").over(order), F.lit(0)))
    sums = sums.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), (F.col("rest") - F.col("before")).alias("b_rest"))
    met = met.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))).drop("b_source", "b_block")
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("within"), "doc_id", "text_hash"), "doc_id", "text_hash")
    met = met.withColumn("pos", F.row_number().over(inside)).withColumn("upto", F.sum(F.col("n_tokens") * F.col("n_rows")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    copies = F.col("full") + F.when(F.col("upto") <= F.col("b_rest"), 1).otherwise(0)
    met = met.withColumn("copies", copies).filter("copies > 0")
    out = met.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rank = F.xxhash64(F.lit(seed), "epoch", "source", "block")
    return out.select("doc_id", "text_hash", "source", "n_tokens", "n_rows", "weight", "epoch", "block", rank.alias("block_rank"), F.col("pos").cast("long").alias("pos"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as drawn: its columns, then mix_epoch, mix_block_rank and mix_pos."""
    d = draws(docs, **parameters).select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), F.col("source").alias("d_source"), "epoch", "block_rank", "pos")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("r_id"), F.xxhash64(docs["text"]).alias("r_hash"), docs["source"].alias("r_source"))
    met = rows.join(d, F.col("r_id").eqNullSafe(F.col("d_id")) & (F.col("r_hash") == F.col("d_hash")) & F.col("r_source").eqNullSafe(F.col("d_source")))
    return met.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("epoch").alias("mix_epoch"), F.col("block_rank").alias("mix_block_rank"), F.col("pos").alias("mix_pos"))

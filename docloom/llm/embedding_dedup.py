"""Embedding near-duplicates over a pivot-permutation index.

Reference points are chosen from a bounded sample (at most ``8 * MAX_PIVOTS`` vectors) so that no two are close. Each
vector is described by its ``depth`` nearest ones in order and filed under the first of them (by number) in inverted
lists of its label; two vectors that share ``shared`` of their pivots always meet in the list of their smallest common one. There the shared
pivots are counted, and only pairs with enough are verified by cosine in double precision.

Equal vectors of a label are one class, which is filed once and counts for all its members. Lists longer than ``CHUNK`` are
dealt out as pairs of chunks, so no task holds a whole list. A task sends link counts and one link to a local
representative per class, never its pairs; components are joined in distributed tables.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those with a null label or a null vec_id, link with
nothing; vectors of different lengths never link; rows that share a vec_id are one vector with the links of each, not linked to itself and
counted once by its neighbours; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, stored
from .components import components

MIN_PIVOTS, MAX_PIVOTS = 256, 4096
CHUNK = 2048
APART = 0.8


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` unit vectors of ``sample``, no two with a cosine above ``APART``: a dense group gives one."""
    kept, n = np.zeros((min(most, len(sample)), sample.shape[1] if sample.ndim == 2 else 0)), 0
    for x in sample:
        if n == len(kept):
            break
        if not n or (kept[:n] @ x).max() <= APART:
            kept[n] = x
            n += 1
    return kept[:n]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled first, so that squares neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def links_within(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, pivot: int, shared: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of x, rows of y) to be reported in the list of ``pivot``: enough shared pivots, none smaller, cosine high."""
    known, code = np.unique(np.concatenate([px.ravel(), py.ravel()]), return_inverse=True)
    hot = np.zeros((len(px) + len(py), len(known)), np.float32)
    np.put_along_axis(hot, code.reshape(len(px) + len(py), -1), 1, axis=1)
    hx, hy, low = hot[: len(px)], hot[len(px) :], int(np.searchsorted(known, pivot))
    rows, cols = [], []
    for a in range(0, len(x), 512):
        e = min(a + 512, len(x))
        ok = (hx[a:e] @ hy.T >= shared) & (hx[a:e, :low] @ hy[:, :low].T == 0)
        ok &= x[a:e] @ y.T >= threshold
        i, j = np.nonzero(ok)
        i = i + a
        if same:
            i, j = i[i < j], j[i < j]
        rows.append(i)
        cols.append(j)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_vectors(embeddings: DataFrame, threshold: float = 0.98, depth: int = 8, shared: int = 3, chunk: int = CHUNK) -> DataFrame:
    """A row per row of ``embeddings``: vec_id, n_links, component_id, kept."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    label_type = dict(rows.dtypes)["label"]
    # Equal vectors of one label are one class: its smallest id stands for all, so copies never meet each other.
    good = stored(rows.filter(sound).filter(finite).distinct().withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")}), "vectors")
    same = ["label", "dim", "h1", "h2"]
    classes = stored(good.groupBy(*same).agg(F.min("vec_id").alias("rep")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")  # numbered once, as it is stored
    member = stored(good.select("vec_id", *same).join(classes, same).select("vec_id", "cls", "rep"), "vector-members")
    # An id with several vectors or labels is one neighbour of whoever it is linked to: such ids are counted by themselves.
    several = member.groupBy("vec_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("vec_id").alias("m_id"))
    member = stored(member.join(several, F.col("vec_id") == F.col("m_id"), "left").withColumn("several", F.col("m_id").isNotNull()).drop("m_id"), "vector-members")
    weights = stored(member.groupBy("cls").agg(F.count_if(~F.col("several")).alias("w"), F.max("several").alias("mixed")), "class-weights")
    most = int(max(MIN_PIVOTS, min(MAX_PIVOTS, 2 * embeddings.count() ** 0.5)))
    sample = hashed_sample(good, 8 * most, "vec_id", "label").select("v").collect()  # bounded by 8 * MAX_PIVOTS
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {d: choose_pivots(_unit(np.array(v)), most) for d, v in by_dim.items()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in pc.unique(b.column(2)).to_pylist():
                whole = b.filter(pc.equal(b.column(2), dim))
                for i in range(0, len(whole), 4096):
                    part = whole.slice(i, 4096)
                    p = pivots.get(dim)
                    if p is None:  # a width that the sample has not: one list of all its vectors
                        top = np.zeros((len(part), 1), np.int64)
                    else:
                        near, n = -(_unit(_matrix(part.column(3))) @ p.T), min(depth, len(p))
                        top = np.argpartition(near, n - 1, axis=1)[:, :n] if n < len(p) else np.tile(np.arange(n), (len(part), 1))
                        top = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)  # the permutation's prefix
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(top.astype(np.int32)), pa.list_(pa.int32()))], names=["cls", "label", "dim", "v", "w", "mixed", "near"])

    first = good.join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", *same]).select("cls", "label", "dim", "v").join(weights, "cls").select("cls", "label", "dim", "v", "w", "mixed")
    described = stored(first.mapInArrow(describe, f"cls long, label {label_type}, dim int, v array<double>, w long, mixed boolean, near array<int>"), "described")
    # Sharing `shared` of `depth` numbers, two sorted lists have a common number among the first depth - shared + 1.
    heads = F.slice(F.array_sort("near"), 1, F.size("near") - F.least(F.lit(shared), F.size("near")) + 1)
    entries = described.select("cls", "label", "dim", "v", "w", "mixed", "near", F.explode(heads).alias("pivot"))
    lists = described.select("label", "dim", F.explode(heads).alias("pivot")).groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    lists = stored(lists.select(F.col("label").alias("l_label"), F.col("dim").alias("l_dim"), F.col("pivot").alias("l_pivot"), "chunks"), "lists")
    dealt = entries.join(lists, (F.col("label") == F.col("l_label")) & (F.col("dim") == F.col("l_dim")) & (F.col("pivot") == F.col("l_pivot")))
    mine = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cls", "v", "w", "mixed", "near", "label", "dim", "pivot", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        pivot, i, j = key[2].as_py(), key[3].as_py(), key[4].as_py()
        table = table.combine_chunks()
        ids, own = table.column("cls").to_numpy(), table.column("mine").to_numpy()
        order = np.lexsort((ids, own))
        table, ids, own = table.take(pa.array(order)), ids[order], own[order]
        w, mixed = table.column("w").to_numpy(), table.column("mixed").to_numpy(zero_copy_only=False)
        x = _unit(_matrix(table.column("v").combine_chunks()))
        near = _matrix(table.column("near").combine_chunks()).astype(np.int64)
        cut, need = int(np.searchsorted(own, i, "right")), min(shared, near.shape[1])
        if i == j:
            a, b = links_within(x, x, near, near, pivot, need, threshold, True)
        else:
            a, b = links_within(x[:cut], x[cut:], near[:cut], near[cut:], pivot, need, threshold, False)
            b = b + cut
        count = np.bincount(a, w[b], len(ids)) + np.bincount(b, w[a], len(ids))
        to, before = ids.copy(), None
        while before is None or (to != before).any():  # the smallest class that this task's links reach
            before = to.copy()
            np.minimum.at(to, a, before[b])
            np.minimum.at(to, b, before[a])
        hit = np.unique(np.concatenate([a, b]))
        # Links to classes that hold ids counted by themselves, one by one.
        l, r = np.concatenate([a[mixed[b]], b[mixed[a]]]), np.concatenate([b[mixed[b]], a[mixed[a]]])
        kind = np.repeat([0, 1], [len(hit), len(l)])
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(np.concatenate([ids[hit], ids[l]]), pa.int64()), "n": pa.array(np.concatenate([count[hit].astype(np.int64), np.zeros(len(l), np.int64)]), pa.int64()), "b": pa.array(np.concatenate([to[hit], ids[r]]), pa.int64())})

    found = stored(dealt.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(meet, "kind int, a long, n long, b long"), "vector-links")
    counts = found.filter("kind = 0").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("n_cls"), "n")
    per = stored(weights.join(counts, F.col("cls") == F.col("n_cls"), "left").select("cls", (F.coalesce("n", F.lit(0)) + F.col("w")).alias("n")), "class-links")
    # Ids counted by themselves: of each class, those in it and in classes linked with it; for each such id, the ids of all its classes' neighbourhoods.
    own = member.filter("several").select(F.col("cls").alias("o_cls"), F.col("vec_id").alias("o_id"))
    ties = found.filter("kind = 1").select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(own.select(F.col("o_cls").alias("x"), F.col("o_cls").alias("y"))).distinct()
    beside = ties.join(own, F.col("y") == F.col("o_cls")).select("x", "o_id").distinct()
    extra = beside.groupBy("x").agg(F.count("*").alias("k"))
    single = member.filter("NOT several").join(per, "cls").join(extra, F.col("cls") == F.col("x"), "left").select("vec_id", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("n"))
    back = ties.select(F.col("y").alias("from"), F.col("x").alias("to")).join(own, F.col("from") == F.col("o_cls")).select("o_id", "to").distinct()
    alone = back.join(weights, F.col("to") == F.col("cls")).groupBy("o_id").agg(F.sum("w").alias("n"))
    others = back.join(own.withColumnsRenamed({"o_id": "p_id", "o_cls": "p_cls"}), F.col("to") == F.col("p_cls")).filter("p_id <> o_id").select("o_id", "p_id").distinct().groupBy("o_id").agg(F.count("*").alias("k"))
    multiple = alone.join(others, "o_id", "left").select(F.col("o_id").alias("vec_id"), (F.col("n") + F.coalesce("k", F.lit(0))).alias("n"))
    numbers = single.unionByName(multiple).select(F.col("vec_id").alias("c_id"), "n")
    # Components run over ids: each class's links from its representative, each member's to it.
    named = member.select("cls", "rep").distinct()
    between = found.filter("kind = 0").select("a", "b").join(named.withColumnsRenamed({"cls": "a_cls", "rep": "a_rep"}), F.col("a") == F.col("a_cls")).join(named.withColumnsRenamed({"cls": "b_cls", "rep": "b_rep"}), F.col("b") == F.col("b_cls"))
    edges = between.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).unionByName(member.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges).select(F.col("id").alias("l_id"), F.col("label").alias("least"))
    out = rows.select("vec_id").join(numbers, F.col("vec_id") == F.col("c_id"), "left").join(labels, F.col("vec_id") == F.col("l_id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

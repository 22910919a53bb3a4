"""Connected components of links, without gathering links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the links (a, b), and for each the smallest id that it reaches."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(ids)))  # ids are sorted, so the smallest number is the smallest id
    for x, y in zip(code[: len(a)].tolist(), code[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x < y:
            up[y] = x
        else:
            up[x] = y
    for i in range(len(up)):
        up[i] = up[up[i]]  # a smaller number is settled already
    return ids, ids[np.array(up, np.int64)] if len(ids) else ids


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, label) for each id of ``edges`` (a, b); the label is the smallest id that links reach.

    Each pass points every id at its smallest neighbour, follows pointers twice, and contracts the links to those
    labels, so stars vanish in one pass and paths shrink by a factor. Each pass is stored, so a lost executor costs one pass.
    All sizes take this path; partial aggregates keep an id of many links from gathering them in one task.
    """
    e = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, left = None, not e.isEmpty()
    while left or labels is None:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")), "pointers")
        up = near
        for _ in range(2):
            up = _followed(up, "to", near)
        up = stored(up, "pointers")
        new = stored(up.withColumnRenamed("to", "label") if labels is None else _followed(labels, "label", up), "labels")
        e2 = _followed(_followed(e, "a", up), "b", up).filter("a <> b")
        e2 = stored(e2.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        forget(e, near, up, *([] if labels is None else [labels]))
        e, labels, left = e2, new, not e2.isEmpty()
    forget(e)
    return labels


def _followed(df: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """``df`` with the ids of ``column`` replaced by what ``pointers`` (id, to) say of them.

    Both sides are stored tables, so where one label is that of very many rows, the adaptive planner splits them.
    """
    told = pointers.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
    met = df.join(told, F.col(column) == F.col("_id"), "left")
    return met.select(*[F.coalesce("_to", c).alias(c) if c == column else F.col(c) for c in df.columns])

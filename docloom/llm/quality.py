"""Quality scores by Bradley-Terry pairwise ranking.

Features of whole texts are compared in preference pairs (a document labelled 1 beats one labelled 0); weights fit the
logistic loss of feature differences. The cut is the score quantile that leaves as many fitted documents below it as
are labelled 0; a score is the logistic of the distance to that cut.

The fit takes at most ``max_fit`` labelled documents, those with the smallest hashes, and ``max_pairs`` pairs; scoring
takes all documents. Only texts are inputs of a score.

Defined results: a null text scores as an empty one; repeated rows get equal scores; several labels of one document are
averaged, and a tie is 1; null labels and labels without documents are left out; without documents of both labels every score is
0.5; a null doc_id is scored and never fitted or held out. Extra columns pass through ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_sample

NAMES = ("distinct_words", "repeated_neighbours", "upper", "letters", "digits", "marks", "mark_runs", "lone_marks", "distinct_lines", "log_words", "word_length", "longest_word")
MAX_FIT, MAX_PAIRS = 20_000, 200_000

_byte = np.arange(256)
_upper = (_byte >= 65) & (_byte <= 90)
_letter = _upper | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_digit = (_byte >= 48) & (_byte <= 57)
_space = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))
_mark = (_byte > 32) & (_byte < 127) & ~_letter & ~_digit


def features(text: str) -> list[float]:
    """The features of one whole text, in the order of ``NAMES``."""
    words = text.split()
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, size = max(len(words), 1), max(len(raw), 1)
    count = np.bincount(raw, minlength=256)
    mark, space = _mark[raw], np.concatenate([[True], _space[raw], [True]])
    lines = text.split("\n")
    return [
        len(set(words)) / n if words else 1.0,
        sum(map(eq, words, islice(words, 1, None))) / n,
        float(count[_upper].sum()) / size,
        float(count[_letter].sum()) / size,
        float(count[_digit].sum()) / size,
        float(count[_mark].sum()) / size,
        float((mark[1:] & mark[:-1]).sum()) / n if len(raw) else 0.0,
        float((mark & space[:-2] & space[2:]).sum()) / n if len(raw) else 0.0,
        len(set(lines)) / len(lines),
        math.log1p(len(words)),
        min(len(text) / n, 50.0),
        math.log1p(max(map(len, words), default=0)),
    ]


@dataclass(frozen=True)
class Ranker:
    """A linear score over standardised features, and its cut."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights) - self.cut, -700, 700)))


def fit_pairs(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Fit by Newton steps on up to ``max_pairs`` preference pairs; the rows' order decides the pairs."""
    width = len(NAMES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z, rng = np.clip((x - mean) / scale, -8, 8), np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(width)
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # of the wrong order
        step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) / n + ridge * np.eye(width), d.T @ p / n - ridge * w)
        w += step * min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort(z @ w)
    k = len(bad)
    return Ranker(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), float((s[k - 1] + s[min(k, len(s) - 1)]) / 2))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: remainder 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Ranker:
    """Fit on labelled rows outside the held-out fold."""
    known = labels.filter(F.col("quality").isNotNull() & (fold_of(F.col("doc_id")) != 1)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # At most max_fit small rows: the bound that allows the broadcast.
    chosen = hashed_sample(known, max_fit, "doc_id").select(F.col("doc_id").alias("fit_id"), "y")
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("fit_id")).select("doc_id", "y", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # An id's repeated rows count once, so max_fit bounds what comes to the driver.
    got = rows.mapInArrow(measured, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    return fit_pairs(np.array([r["x"] for r in got]).reshape(-1, len(NAMES)), np.array([r["y"] for r in got]))


def scored(documents: DataFrame, ranker: Ranker, text_at: int, keep: list[int]) -> DataFrame:
    """The columns numbered ``keep`` and a last column, score, for every row; ``text_at`` is the text's column."""
    schema = T.StructType([documents.schema[i] for i in keep]).add("score", "double")
    names = [f.name for f in schema]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(text_at).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(ranker.scores(x))], names=names)

    return documents.mapInArrow(score, schema)


def quality_scores(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    s = scored(documents.select("doc_id", "text"), fit(documents, labels, max_fit), 1, [0])
    return s.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """The documents with a score of at least 0.5, with their own columns."""
    n = len(documents.columns)
    plain = documents.toDF(*[f"c{i}" for i in range(n)])  # whatever the columns are called
    return scored(plain, fit(documents, labels, max_fit), documents.columns.index("text"), list(range(n))).filter("score >= 0.5").drop("score").toDF(*documents.columns)

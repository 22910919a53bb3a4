"""The pipeline and the mix against plain Python, and the classifier against real labels."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from docloom.llm import mixing, quality

from .conftest import DOCS
from .test_dedup import deduped_lines, near_components
from .test_scans import contaminated


def hashed(spark, rows, schema, *columns):
    """Spark's 64-bit hash of some columns, a value a row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at long, " + schema)
    return [r.h for r in df.select("at", F.xxhash64(*columns).alias("h")).orderBy("at").collect()]


def drawn(spark, docs, block_tokens=200_000, share=0.9, repeats=4.0):
    """The mix of rows (doc_id, text, source) in plain Python: a counter of (doc_id, source, epoch) and the weights."""
    rows = Counter((d, t, s) for d, t, s in docs if (t or "").split())
    every = list(rows)
    tokens = [len(t.split()) for _, t, _ in every]
    own = Counter()
    for r, n in zip(every, tokens):
        own[r[2]] += n * rows[r]
    total = sum(own.values())
    p = {s: n / total for s, n in own.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def last(holds):
        if holds(1.0):
            return 1.0
        if not holds(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    a = max(last(lambda a: entropy(a) >= share * math.log(len(p)) - 1e-12), last(lambda a: max(weights(a)[s] * total / own[s] for s in p) > repeats * (1 + 1e-12)))
    w = {s: round(x, 9) for s, x in weights(a).items()}
    text_hash = hashed(spark, [(t,) for _, t, _ in every], "t string", "t")
    keys = [(d, h, s) for (d, _, s), h in zip(every, text_hash)]
    of = "d long, h long, s string"
    block_hash, inside = hashed(spark, keys, of, F.lit("mix"), "d", "h"), hashed(spark, keys, of, F.lit("mix"), F.lit("within"), "d", "h")
    out = Counter()
    for s in p:
        budget = math.floor(w[s] * total)
        full, rest = divmod(budget, own[s])
        n_blocks = min(math.ceil(own[s] / block_tokens), mixing.MAX_BLOCKS)
        blocks = {}
        for i, r in enumerate(every):
            if r[2] == s:
                blocks.setdefault(block_hash[i] % n_blocks, []).append(i)
        order = hashed(spark, [(full, s, b) for b in blocks], "f int, s string, b long", F.lit("mix"), "f", "s", "b")
        for _, b in sorted(zip(order, blocks)):
            left = rest
            rest -= sum(tokens[i] * rows[every[i]] for i in blocks[b])
            for i in sorted(blocks[b], key=lambda i: inside[i]):
                left -= tokens[i] * rows[every[i]]
                for epoch in range(full + (left >= 0)):
                    out[(every[i][0], s, epoch)] += 1
    return out, w


def test_draws_match_plain_python(spark):
    rng = random.Random(12)
    docs = [(i, "tok " * rng.randrange(1, 40), "hot") for i in range(500)] + [(1000 + i, "tok " * rng.randrange(1, 30), "warm") for i in range(100)] + [(2000 + i, "tok " * 9, None) for i in range(6)]
    docs += [(3000, "twice the same row", "hot")] * 2 + [(3001, None, "hot"), (3002, " ", "void")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for block_tokens in (400, 200_000):
        got = mixing.draws(df, block_tokens=block_tokens).collect()
        want, w = drawn(spark, docs, block_tokens)
        assert Counter((r.doc_id, r.source, r.epoch) for r in got) == want
        assert all(abs(r.weight - w[r.source]) < 2e-9 for r in got)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, documents):
    """Good prose and junk, near copies, shared passages, repeated lines, benchmark passages, nulls and empty texts."""
    rng = random.Random(30)
    words = "the river ran over stones and trees slowly down to where old mills once stood by bridges of grey rock".split()
    good = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ly"]) + str(rng.randrange(60)) for _ in range(n)) + "."
    junk = lambda: rng.choice([lambda: "BUY NOW!! " * 30, lambda: "a | b | c | " * 25, lambda: "x*** y$$$ z### " * 15])()
    item, passage, base = good(24), "\n".join(good(12) for _ in range(4)), good(90)
    texts = [good(rng.randrange(30, 90)) if i % 4 else junk() for i in range(240)]
    texts += [good(20) + "\n" + passage + "\n" + good(20) for _ in range(8)] + [good(15) + " " + item[5:].upper() + " " + good(15) for _ in range(6)]
    for _ in range(10):
        w = base.split()
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(99))
        texts.append(" ".join(w))
    texts += [None, "", base, base, good(8_000)]
    rows = [(i, t, "en", ("hot", "hot", "warm", "cold")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_pipeline_matches_plain_python(spark, tables):
    d, rows = tables
    ranker = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    scores = ranker.scores(np.array([quality.features(r[1] or "") for r in rows]))
    kept = [r for r, s in zip(rows, scores) if s >= 0.5]
    assert len(kept) < len(rows) and all(r[0] % 4 for r in kept if r[0] < 240)
    texts = {(r[0], r[1]): r for r in kept}
    h = hashed(spark, [(t,) for _, t in texts], "t string", "t")
    lined = deduped_lines([(i, t, x) for (i, t), x in zip(texts, h)])
    after = [(i, t) for i, n, gone, t in lined if gone < max(n, 1)]
    top = near_components(after, 5, 80, 100)
    after = [(i, t) for i, t in after if top[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    bad = {i for i, _, n_hit, _, _, _ in contaminated(after, items) if n_hit}
    after = [(i, t) for i, t in after if i not in bad]
    source = {r[0]: r[3] for r in rows}
    want, _ = drawn(spark, [(i, t, source[i]) for i, t in after])
    got = pipeline.run(spark, d).collect()
    assert Counter((r.doc_id, r.source, r.mix_epoch) for r in got) == want
    final = dict(after)
    assert all(r.text == final[r.doc_id] and r.n_chars == len(r.text) and r.lang == "en" for r in got)
    assert bad and len(top) > len(set(top.values()))


def test_pipeline_stages_keep_columns_and_empty_tables(spark, tables, clashing, empty, tmp_path):
    d, _ = tables
    for _, stage in pipeline.STAGES[1:-1]:
        assert stage(spark, clashing, d).columns == clashing.columns
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


REAL = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(REAL), reason="needs the driver's tables")
def test_quality_meets_labels_of_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{REAL}/{n}.parquet") for n in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.quality_scores(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got) and len(got) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)

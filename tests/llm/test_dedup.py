import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import components, embedding_dedup, line_dedup, minhash, suffix_dedup
from docloom.llm.suffix_dedup import SuffixFamily

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def removed_bytes(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, LAST + 1), LAST if d is None else d)
    out = Counter()
    for d, t in rows:
        b, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (LAST if d is None else d):
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"batch": 300, "block_bytes": 2000}])
def test_suffix_dedup_matches_brute_force(documents, options):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.substring_duplicates(documents, **options).collect())
    assert got == removed_bytes(rows)


def test_suffix_dedup_of_nothing_and_of_clashing_columns(empty, clashing, documents):
    assert suffix_dedup.substring_duplicates(empty).count() == 0
    assert suffix_dedup.substring_duplicates(clashing).count() == documents.count()


def test_suffix_family_keeps_few_levels():
    rng, family, seen = np.random.default_rng(0), SuffixFamily(), {}
    for batch in range(32):
        words = np.array([b"%02d" % rng.integers(60) for _ in range(40)], "S2")
        docs = np.sort(rng.integers(batch * 10, batch * 10 + 10, 40))
        for w, d in zip(words, docs):
            seen[w] = min(seen.get(w, 10**9), d)
        got = family.add(words, docs)
        assert got.tolist() == [seen[w] < d for w, d in zip(words, docs)]
        assert len(family.levels) <= 7


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(rows, k, num, den):
    ids, sets = sorted({d for d, _ in rows if d is not None}), defaultdict(list)
    for d, t in rows:
        sets[d].append(shingles(t, k))
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x & y and den * len(x & y) >= num * len(x | y):
                        p, q = sorted((top(a), top(b)))
                        up[q] = p
    return {d: top(d) for d in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(documents, k, num):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = near_components(rows, k, num, 100)
    got = minhash.near_duplicates(documents, k=k, num=num).collect()
    expected = Counter((d, len(shingles(t, k)), want.get(d), True if d is None else want[d] == d) for d, t in rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == expected


@pytest.mark.parametrize("tight", [False, True])
def test_a_large_group_of_near_copies(spark, prose_of, monkeypatch, tight):
    import random

    if tight:  # large neighbourhoods by bucket, chunks of few members and of few bytes
        monkeypatch.setattr(minhash, "HOOD", 50)
        monkeypatch.setattr(minhash, "CHUNK", 64)
        monkeypatch.setattr(minhash, "CHUNK_BYTES", 40_000)
    rng = random.Random(3)
    base = prose_of(rng, 150).split(" ")
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 30)):
            w[rng.randrange(len(w))] = "e" + str(rng.randrange(10_000))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_components(rows, 3, 85, 100)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=3, num=85).collect()} == want


def test_half_of_all_rows_are_one_text(spark, prose_of):
    import random

    rng = random.Random(6)
    text = prose_of(rng, 60)
    rows = [(i, text) for i in range(5, 605)] + [(1000 + i, prose_of(rng, 60)) for i in range(590)] + [(2000 + i, text + f" more{i}") for i in range(10)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85).collect()}
    assert all(c == (5 if d < 1000 or d >= 2000 else d) for d, c in got.items()) and len(got) == 1200


def test_stored_tables_go(spark, empty, documents):
    from docloom.llm import common

    a = common.stored(documents, "a")
    common.forget(a)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a._stored_at)
    here = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not here.exists(fs)
    minhash.near_duplicates(empty).count()
    assert here.exists(fs.getParent())
    left = len(here.listStatus(fs.getParent()))
    minhash.near_duplicates(empty).count()
    assert len(here.listStatus(fs.getParent())) == left + 1  # the result alone stays


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one(empty).columns == empty.columns


def test_keep_one_keeps_columns(clashing):
    kept = minhash.keep_one(clashing, k=5, num=80)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} >= {100, None, 400, 401}
    assert kept.filter("doc_id BETWEEN 101 AND 104").count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    order = np.random.default_rng(1).permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (5000, 5000)], "a long, b long")
    got = {r.id: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_pruning_needs_more_matches_for_higher_thresholds():
    low, high = minhash.least_matches(64, 0.5, 1e-6), minhash.least_matches(64, 0.9, 1e-6)
    assert all(a[1] <= b[1] for a, b in zip(low, high)) and high[-1][1] > low[-1][1]
    assert minhash.banding(0.85, 1e-6)[0] >= 20


def deduped_lines(rows, width=3):
    key = lambda r: (LAST if r[0] is None else r[0])
    first, out = {}, []
    hashed = [(key(r), r[2], r[1]) for r in rows]
    for k, h, t in sorted(hashed, key=lambda x: x[:2]):
        ls = t.split("\n") if t is not None else []
        for i in range(len(ls) - width + 1):
            w = tuple(ls[i : i + width])
            first[w] = min(first.get(w, (LAST + 1, 0, 0)), (k, h, i))
    for d, t, h in rows:
        ls, gone = (t.split("\n") if t is not None else []), set()
        for i in range(len(ls) - width + 1):
            if first[tuple(ls[i : i + width])] < (LAST if d is None else d, h, i):
                gone |= set(range(i, i + width))
        out.append((d, len(ls), len(gone), None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return Counter(out)


def test_line_dedup_matches_brute_force(documents):
    rows = [(r.doc_id, r.text, r.h) for r in documents.withColumn("h", F.xxhash64("text")).collect()]
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in line_dedup.line_counts(documents).collect())
    assert got == deduped_lines(rows)


def test_line_dedup_keeps_columns_and_clean_documents(clashing, empty):
    kept = line_dedup.dedup_lines(clashing)
    assert kept.columns == clashing.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {100, 400, 401, 403, 404, 405} <= ids and not ids & {101, 102, 103, 104}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_a_very_long_document_and_a_very_common_window(spark):
    """100,000 lines of which half repeat in short runs; one window in half of all documents."""
    import time

    common = "same one\nsame two\nsame three"
    long = "\n".join(f"line {i}\na {i % 7}\nb\nc" for i in range(25_000))
    rows = [(i, f"head {i}\n{common}\ntail {i}" if i % 2 else f"only {i}\nown {i}\nlines {i}") for i in range(4_000)] + [(5_000, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.line_counts(df).collect()}
    assert time.time() - began < 60  # linear: a square would take hours
    want = {d: (n, k, t) for (d, n, k, t) in deduped_lines([(d, t, 0) for d, t in rows])}
    assert got == want and got[5_000][1] > 0 and got[3][1] == 3


VECS = "vec_id long, embedding array<float>, label int"


def near_vectors(rows):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = defaultdict(set), {i: i for i, _, _ in rows}
    for a in range(len(ok)):
        for b in range(a):
            (i, x, l), (j, y, m) = ok[a], ok[b]
            if l == m and i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                n[i].add(j)
                n[j].add(i)
                p, q = i, j
                while up[p] != p:
                    p = up[p]
                while up[q] != q:
                    q = up[q]
                up[max(p, q)] = min(p, q)
    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    return {i: (len(n[i]), top(i)) for i, _, _ in rows}


@pytest.mark.parametrize("chunk", [2048, 40])
def test_embeddings_match_brute_force(spark, chunk):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 30] + rng.normal(size=16) * (0.01 + 0.2 * (i % 7 == 0)))], int(i % 3)) for i in range(300)]
    rows += [(900 + i, [float(x) for x in np.float32(centres[0] + rng.normal(size=16) * 0.02)], 0) for i in range(150)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [1.0, None] * 8, 1), (505, [1.0] * 3, 1), (506, [float("inf")] * 16, 1), (507, rows[0][1], 0), (508, [], 0)]
    rows += [(600 + i, [1.0, 2.0, 3.0 + i // 3], 1) for i in range(6)] + [(610, [5.0], 2), (611, [7.0], 2)]  # rarer widths
    rows += [(700 + i, rows[3][1], 0) for i in range(20)]  # copies
    rows += [(7, rows[3][1], 0), (8, rows[3][1], 0), (8, rows[4][1], 0), (10, rows[1][1], 1), (10, rows[1][1], 1)]  # ids with several vectors
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECS), chunk=chunk).collect()}
    want = near_vectors(rows)
    assert got.keys() == want.keys()
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())  # recall
    assert got == want


@pytest.mark.parametrize(("n", "dim"), [(1_000, 16), (2_000, 64), (4_000, 128)])
def test_recall_of_planted_pairs(spark, n, dim):
    """Pairs just above the threshold, one beside each of n random vectors: at least 0.99 of them are found."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(n, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * side
    rows = [(2 * i + j, [float(a) for a in v], 0) for i in range(n) for j, v in enumerate((x[i], y[i]))]
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(n)) >= 0.99 * n


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECS)).count() == 0
    one = embedding_dedup.near_vectors(spark.createDataFrame([(None, [1.0, 2.0], 1), (1, None, None)], VECS)).collect()
    assert sorted((r.vec_id is None, r.n_links, r.kept) for r in one) == [(False, 0, True), (True, 0, True)]

"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of distinct word shingles. Rows of one set form a class. Signatures are banded; in each bucket of a
band all members are compared with a pivot, then, in blocks that send no pairs on, those that are still in different components. A comparison reads the signatures in batches and stops when the posterior
probability (uniform prior, binomial matches) that the similarity reaches the threshold falls below ``prune``; pairs
that survive are verified on the full sets. Links, buckets and components stay in distributed tables.

Banding misses a pair at the threshold with probability ``miss`` at most; pruning adds about ``prune`` a batch.

Defined results: a null or empty text, or one without words, has an empty set and no links; fewer words than ``k`` are
one shingle; rows of equal sets are linked, repeated rows too; rows that share a doc_id are one document with the
links of each; a row with a null doc_id has no links and is kept. Extra columns pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, shuffle_width, stored
from .components import components, joined
from .shingles import buffers, mix, shingle_sets

ROWS = 5
BATCH = 16
#: Members, and bytes of their sets, of a chunk: two chunks meet in a task.
CHUNK, CHUNK_BYTES = 512, 32 << 20
#: Ids of a neighbourhood up to which its ids meet once, not once a bucket.
HOOD = 4096


def banding(threshold: float, miss: float, rows: int = ROWS) -> tuple[int, int]:
    """Bands, and hashes in all, such that a pair at ``threshold`` is missed with probability ``miss`` at most."""
    bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    return bands, -(-bands * rows // BATCH) * BATCH


def least_matches(hashes: int, threshold: float, prune: float) -> list[tuple[int, int]]:
    """(n, m): after n hashes, go on only with m matches; below, P(similarity >= threshold | matches) < prune."""
    x = (np.arange(20_000) + 0.5) / 20_000
    lx, lr, out = np.log(x), np.log1p(-x), []
    for n in range(BATCH, hashes + 1, BATCH):
        for m in range(n + 1):
            d = m * lx + (n - m) * lr
            w = np.exp(d - d.max())
            if w[x >= threshold].sum() / w.sum() >= prune:
                break
        out.append((n, m))
    return out


def signatures(docs: DataFrame, k: int, bands: int, hashes: int, rows: int = ROWS) -> DataFrame:
    """Rows (id, n, s1, s2, sig, bands) for rows (id, text): set size, 128-bit set digest, 16 bits a hash, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        factor = rng.integers(1, 2**63, hashes, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        seeds = rng.integers(1, 2**63, (bands, 1), dtype=np.uint64)
        for b in batches:
            n, s1, s2, sig, keys = [], [], [], [], []
            for s in shingle_sets(b.column(1), k):
                n.append(len(s))
                s1.append(int(np.add.reduce(s, dtype=np.uint64).view(np.int64)))
                s2.append(int(np.add.reduce(mix(s), dtype=np.uint64).view(np.int64)))
                if not len(s):
                    sig.append(b"")
                    keys.append([])
                    continue
                least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), 2048):
                    np.minimum(least, (factor * s[None, i : i + 2048]).min(axis=1), out=least)
                least = mix(least)
                sig.append((least >> np.uint64(48)).astype(np.uint16).tobytes())
                g, key = least[: bands * rows].reshape(bands, rows), seeds[:, 0].copy()
                for c in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + g[:, c])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "s1", "s2", "sig", "bands"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, sig binary, bands array<long>")


def likely(pairs: DataFrame, hashes: int, threshold: float, prune: float) -> DataFrame:
    """The first two columns of the rows of ``pairs`` (a, b, sig_a, sig_b) that sequential verification does not prune."""
    steps = least_matches(hashes, threshold, prune)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 20_000):
                part = batch.slice(i, 20_000)
                x, y = (np.frombuffer(buffers(part.column(c))[0].tobytes(), np.uint16).reshape(len(part), hashes) for c in (2, 3))
                alive, m = np.arange(len(part)), np.zeros(len(part), np.int64)
                for n, least in steps:
                    m[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                    alive = alive[m[alive] >= least]
                yield part.select([0, 1]).take(pa.array(alive))

    return pairs.mapInArrow(run, pairs.select(*pairs.columns[:2]).schema)


def set_table(texts: DataFrame, k: int) -> DataFrame:
    """Rows (id, set): the sorted shingles of texts (id, text), 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), k)], pa.binary())], names=["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary")


def links_between(x: slice, y: slice, same: bool, band: int | None, label: np.ndarray, sig: np.ndarray, bands: np.ndarray, code: np.ndarray, off: np.ndarray, steps: list, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of different labels that share a band (the given one first, if one is given).

    Signatures are compared in batches, and full sets for the pairs that are not pruned: one set is marked, and its meetings with all of ``y`` counted at once.
    """
    left, right = [], []
    sizes, mark = np.diff(off), np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
    flat, starts = code[off[y.start] : off[y.stop]], off[y.start : y.stop] - off[y.start]
    for a in range(x.start, x.stop, 256):
        e = min(a + 256, x.stop)
        ok = label[a:e, None] != label[None, y]
        if same:
            ok &= np.arange(a, e)[:, None] < np.arange(y.start, y.stop)[None, :]
        shares = np.zeros_like(ok)
        for c in range(bands.shape[1]) if band is None else [band]:
            shares |= bands[a:e, c][:, None] == bands[y, c][None, :]
        for c in range(band or 0):
            shares &= bands[a:e, c][:, None] != bands[y, c][None, :]
        i, j = np.nonzero(ok & shares)
        m = np.zeros(len(i), np.int64)
        for n, least in steps:
            m += (sig[i + a, n - BATCH : n] == sig[j + y.start, n - BATCH : n]).sum(axis=1)
            on = m >= least
            i, j, m = i[on], j[on], m[on]
        for r in np.unique(i):
            mine = code[off[r + a] : off[r + a + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[mine] = False
            js = j[i == r]
            hit = js[den * both[js] >= num * (len(mine) + sizes[y][js] - both[js])]
            left.append(np.full(len(hit), r + a))
            right.append(hit + y.start)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def meet_in_blocks(rows: DataFrame, hashes: int, num: int, den: int, prune: float, slots: int) -> DataFrame:
    """Links (a, b) that join the ids of each group as all its linked pairs of different labels do.

    Rows are (id, label, grp, by_key, chunks, sig, bands, set). A group of several chunks is dealt out as pairs of chunks; small
    groups share tasks. With ``by_key`` the group is a bucket, and takes the pairs of which it is the first that they share.
    """
    steps = least_matches(hashes, num / den, prune)
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("id", "label", "grp", "by_key", "sig", "bands", "set", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    dealt = dealt.withColumn("slot", F.when(F.col("j") == 0, F.pmod(F.xxhash64("grp"), F.lit(slots))).otherwise(F.xxhash64("grp", "by_key", "i", "j")))

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        g, by, c, d, m, v = (table.column(n).to_numpy() for n in ("grp", "by_key", "i", "j", "mine", "id"))
        order = np.lexsort((v, m, d, c, by, g))
        table = table.take(pa.array(order))
        g, by, c, d, m, v = g[order], by[order], c[order], d[order], m[order], v[order]
        label = table.column("label").to_numpy()
        sig = np.frombuffer(buffers(table.column("sig").combine_chunks())[0].tobytes(), np.uint16).reshape(len(v), hashes)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(v), -1)
        raw, at = buffers(table.column("set").combine_chunks())
        _, code = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)
        off = at // 8
        new = (g[1:] != g[:-1]) | (by[1:] != by[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        head = np.flatnonzero(np.concatenate([[True], new]))
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, e in zip(head, np.append(head[1:], len(v)), strict=True):
            x, y = slice(a, e), slice(a, e)
            if c[a] != d[a]:
                mid = a + int(np.searchsorted(m[a:e], c[a], "right"))
                if mid in (a, e):
                    continue
                x, y = slice(a, mid), slice(mid, e)
            band = int(np.flatnonzero(bands[a] == g[a])[0]) if by[a] else None
            i, j = links_between(x, y, c[a] == d[a], band, label, sig, bands, code, off, steps, num, den)
            ids, least = joined(v[i], v[j])
            out.append((ids[ids != least], least[ids != least]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("slot").applyInArrow(meet, "a long, b long")


def verified(pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` (a, b, text_a, text_b) whose full sets meet den * intersection >= num * union.

    Neighbouring rows often share ``text_b``, whose set is then made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                other = part.column(3).dictionary_encode()
                sets = list(shingle_sets(other.dictionary, k))
                for j, (x, at) in enumerate(zip(shingle_sets(part.column(2), k), other.indices.to_pylist(), strict=True)):
                    y = sets[at]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and den * both >= num * (len(x) + len(y) - both):
                        good.append(i + j)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    return pairs.mapInArrow(run, "a long, b long")


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for n, c in names.items()])


def star_links(live: DataFrame, compared: DataFrame, texts: DataFrame, k: int, num: int, den: int, hashes: int, prune: float) -> DataFrame:
    """Links (a, b) between the members of each bucket and its pivot: rows (id, key, pivot, n) with the bucket's size n.

    A pivot's text meets its members in parts of ``CHUNK``, so a large bucket is no single task.
    """
    pairs = live.filter("id <> pivot").groupBy("id", "pivot").agg(F.max("n").alias("n"))
    pairs = pairs.join(_renamed(compared, ia="id", sig_a="sig"), F.col("id") == F.col("ia")).join(_renamed(compared, ib="id", sig_b="sig"), F.col("pivot") == F.col("ib"))
    packed = F.struct("pivot", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).alias("part"))
    near = likely(pairs.select("id", packed.alias("to"), "sig_a", "sig_b"), hashes, num / den, prune)
    near = stored(near.select("id", "to.pivot", "to.part").distinct(), "likely")
    ends = near.select("pivot", "part").distinct().join(_renamed(texts, t_id="id", text_b="text"), F.col("pivot") == F.col("t_id"))
    met = near.join(_renamed(texts, ta="id", text_a="text"), F.col("id") == F.col("ta")).select("id", "pivot", "part", "text_a")
    met = met.join(_renamed(ends, e_pivot="pivot", e_part="part", text_b="text_b"), (F.col("pivot") == F.col("e_pivot")) & (F.col("part") == F.col("e_part")))
    out = stored(verified(met.select("id", "pivot", "text_a", "text_b"), k, num, den).distinct(), "links")
    forget(near)
    return out


def near_duplicates(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100, miss: float = 1e-6, prune: float = 1e-9) -> DataFrame:
    """A row per row of ``documents``: doc_id, n_shingles, component_id, kept; sets of ``k`` words, links at num/den and more."""
    bands, hashes = banding(num / den, miss)
    rows = documents.select(F.col("doc_id").alias("id"), "text")
    feats = stored(signatures(rows, k, bands, hashes), "signatures")
    full = feats.filter("id IS NOT NULL AND n > 0")
    # One row for each class of equal sets; the smallest id stands for it. Aggregates that a hot key joins are stored first:
    # between two stored tables the adaptive planner splits such a key.
    classes = stored(full.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "classes")
    member = stored(full.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("id", "rep").distinct(), "members")
    reps = stored(full.join(member.filter("id = rep").select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "s1", "s2"]), "representatives")
    entries = reps.select("id", F.col("n").alias("size"), F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "key"), "id")).alias("p"))
    shared = stored(shared.filter("lo < hi").select("key", "n", F.col("p.id").alias("pivot")), "shared")
    live = stored(entries.join(shared, "key").groupBy("id", "key", "n", "pivot").agg(F.max("size").alias("size")), "buckets")
    ids = stored(live.select("id").distinct(), "live")
    compared = stored(reps.join(ids, "id", "left_semi").select("id", "n", "sig", "bands"), "compared")
    texts = stored(rows.filter("id IS NOT NULL").join(ids, "id", "left_semi").distinct(), "texts")
    # Ids with rows of several sets tie those sets' classes together.
    ties = member.filter("id <> rep").join(member.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id"), "id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # First a star in each bucket, around a pivot of its own, so that groups join without comparing their members.
    star = star_links(live, compared, texts, k, num, den, hashes, prune)
    labels = components(ties.unionByName(star))
    # Then members of a bucket that are still apart meet in blocks, and only a link for each id joined comes out.
    now = live.join(labels.withColumnRenamed("id", "l_id"), F.col("id") == F.col("l_id"), "left").select("id", "key", "size", F.coalesce("label", "id").alias("label"))
    weight = F.sum(8 * F.col("size") + 2 * hashes).alias("bytes")
    apart = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("least"), F.count("*").alias("n"), weight).filter("lo < hi")
    apart = stored(apart.select(F.col("key").alias("a_key"), "least", F.col("n").alias("b_n"), F.col("bytes").alias("b_bytes")), "apart-keys")
    rest = stored(now.join(apart, F.col("key") == F.col("a_key")).drop("a_key"), "apart")
    # Buckets that share members form a neighbourhood, in which each id is needed once; where one grows large, its buckets meet apart.
    hoods = components(rest.select(F.col("id").alias("a"), F.col("least").alias("b")))
    alone = rest.groupBy("id", "label").agg(F.max("size").alias("size"))
    placed = stored(alone.join(_renamed(hoods, n_id="id", hood="label"), F.col("id") == F.col("n_id")).drop("n_id"), "near")
    sizes = stored(placed.groupBy("hood").agg(F.count("*").alias("h_n"), weight.alias("h_bytes")).withColumnRenamed("hood", "s_hood"), "sizes")
    near = placed.join(sizes, F.col("hood") == F.col("s_hood")).drop("s_hood")
    chunks = lambda n, size: F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(size) / CHUNK_BYTES)).cast("int").alias("chunks")
    small = near.filter(F.col("h_n") <= HOOD).select("id", "label", F.col("hood").alias("grp"), F.lit(False).alias("by_key"), chunks("h_n", "h_bytes"))
    wide = near.filter(F.col("h_n") > HOOD).select(F.col("id").alias("w_id"))
    large = rest.join(wide.distinct(), F.col("id") == F.col("w_id")).select("id", "label", F.col("key").alias("grp"), F.lit(True).alias("by_key"), chunks("b_n", "b_bytes"))
    asked = stored(small.unionByName(large), "asked")
    sets = set_table(texts.join(asked.select(F.col("id").alias("r_id")).distinct(), F.col("id") == F.col("r_id"), "left_semi"), k)
    full_rows = asked.join(_renamed(compared, c_id="id", sig="sig", bands="bands"), F.col("id") == F.col("c_id")).join(_renamed(sets, t_id="id", set="set"), F.col("id") == F.col("t_id"))
    # Groups of one chunk share tasks, as many to each as measured bytes allow.
    held = asked.filter("chunks = 1").join(_renamed(compared, c_id="id", n="n"), F.col("id") == F.col("c_id")).agg(F.sum(8 * F.col("n") + 2 * hashes)).first()[0] or 0
    slots = max(8 * shuffle_width(documents.sparkSession), -(-held // CHUNK_BYTES))
    blocks = stored(meet_in_blocks(full_rows.select("id", "label", "grp", "by_key", "chunks", "sig", "bands", "set"), hashes, num, den, prune, slots).distinct(), "links")
    again = components(ties.unionByName(star).unionByName(blocks))
    top = member.groupBy("id").agg(F.min("rep").alias("rep"))
    top = top.join(_renamed(again, l_id="id", label="label"), F.col("rep") == F.col("l_id"), "left").select(F.col("id").alias("m_id"), F.coalesce("label", "rep").alias("label"))
    found = feats.select("id", "n").join(top, F.col("id") == F.col("m_id"), "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))
    found = stored(found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
    forget(feats, classes, member, reps, shared, live, ids, compared, texts, star, labels, apart, rest, hoods, placed, sizes, asked, blocks, again)
    return found


def keep_one(documents: DataFrame, **parameters) -> DataFrame:
    """``documents`` with one document left of each component: the one with the smallest doc_id."""
    gone = near_duplicates(documents, **parameters).filter("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["gone_id"], "left_anti")

"""Exact substring deduplication with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id.

1. Anchors. Every window of ``length`` bytes picks the least-hashed gram of ``GRAM`` bytes in it, so equal windows pick
   equal grams. Blocks of documents send the hashes of their anchors, packed, to ranges of hashes, and learn which
   anchors other documents share. Few do.
2. Suffixes. For a shared anchor, a block sends the bytes around it (all windows that hold it, once for each distinct
   surrounding) to the anchor's range. There batches of them arrive in order of doc_id; each batch gets a suffix array of its
   windows, is merge-scanned against the existing levels for windows of earlier documents, and becomes a level; two levels of like
   size merge, so n batches leave O(log n) levels and each window moves O(log n) times.
3. Spans. Windows found earlier go back to the block as byte spans, whose union is removed.

Matches compare bytes; hashes only decide what meets where. An anchor in more than ``hot`` places is dealt out again by
its single windows, so no range gathers all documents that quote one passage. Texts cross one shuffle, by block.

Defined results: a null text is empty; matches never cross documents; a document shorter than ``length`` loses nothing; rows of
equal doc_id do not count as earlier than each other; a null doc_id comes after all others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, input_bytes, shuffle_width
from .shingles import buffers, mix

LENGTH = 50
GRAM = 16
#: Input bytes to a block of documents.
BLOCK_BYTES = 4 << 20
#: Suffixes to a batch of the index family.
BATCH = 1 << 19
HOT = 50_000
#: Blocks to a task, at most on average.
TASK_BLOCKS = 16
_SLICE = 1 << 20
_U = np.uint64
_KEY_BITS = 40


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x, have = op(x[:-have], x[have:]), have * 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _gram_hashes(raw: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    words = np.ndarray(len(raw) - 7, "<u8", buffer=raw, strides=(1,))
    lo, hi = words[: len(raw) - GRAM + 1][at], words[GRAM - 8 :][at]
    h = lo * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h += hi * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    h *= _U(0x165667B19E3779F9)
    return h ^ (h >> _U(32))


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Positions of the anchors of some texts that lie one after another."""
    out, n, w = [], len(raw), length - GRAM + 1
    ends = off[1:][np.diff(off) > 0]
    for a in range(0, n - length + 1, _SLICE):
        # Windows that start in [a, e); a position near the edge may be picked on both sides.
        e = min(a + _SLICE, n - length + 1)
        part = np.ascontiguousarray(raw[a : e + length - 1])
        h = (_gram_hashes(part, slice(None)) >> _U(33)).astype(np.uint32) + np.uint32(1)
        least = _slide(h, w, np.minimum)
        near = ends[(ends > a) & (ends < e + length)] - a
        for back in range(1, length):
            s = near - back
            least[s[(s >= 0) & (s < len(least))]] = 0  # such a window would cross into the next text
        pad = np.zeros(w - 1, np.uint32)
        reach = _slide(np.concatenate([pad, least, pad]), w, np.maximum)
        out.append(np.flatnonzero(reach == h) + a)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _split(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's range and its 40-bit key within it."""
    return ((h >> _U(_KEY_BITS)) % _U(ranges)).astype(np.int64), h & _U((1 << _KEY_BITS) - 1)


def _squeezed(rows: np.ndarray) -> bytes:
    """A structured array column by column, compressed: rows of one block share ids and much of their text."""
    flat = b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)
    return len(rows).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def _expanded(cell: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(cell[:8], "little")
    flat, at, out = pa.decompress(cell[8:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), 0, np.zeros(n, kind)
    for f in kind.names:
        size = n * kind[f].itemsize
        out[f] = np.frombuffer(flat[at : at + size], kind[f])
        at += size
    return out


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _block(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in order of doc_id and text: the order, the ids, the bytes and their offsets."""
    order = pc.sort_indices(table.select(["id", "text"]), sort_keys=[("id", "ascending"), ("text", "ascending")])
    raw, off = buffers(table.column("text").combine_chunks().take(order))
    return order, table.column("id").combine_chunks().take(order).to_numpy(), np.ascontiguousarray(raw), off


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(-1, width)


def _keys(cells: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cells), 8), np.uint8)
    out[:, :5] = cells[:, :5]
    return out.view("<u8")[:, 0]


class SuffixFamily:
    """Levels of sorted windows with the smallest document of each; a batch is scanned against all, then added."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which windows a smaller document has. Batches come in order of document."""
        order = np.lexsort((docs, windows))  # the batch's suffix array; equal windows by document
        w, d = windows[order], docs[order]
        head = _runs(w)
        size = np.diff(np.append(head, len(w)))
        keys, first = w[head], d[head]
        earliest = first.copy()
        for level, owners in self.levels:
            at = _merge_scan(level, keys)
            hit = at >= 0
            earliest[hit] = np.minimum(earliest[hit], owners[at[hit]])
        found = np.zeros(len(w), bool)
        found[order] = np.repeat(earliest, size) < d
        self.levels.append((keys, earliest))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, da), (b, db) = self.levels.pop(), self.levels.pop()
            k, o = np.concatenate([b, a]), np.concatenate([db, da])
            order = np.argsort(k, kind="stable")  # two sorted runs: a merge
            k, o = k[order], o[order]
            head = _runs(k)
            self.levels.append((k[head], np.minimum.reduceat(o, head)))
        return found


def _merge_scan(level: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of the sorted ``keys`` its place in the sorted ``level``, or -1, in one merge of the two."""
    n = len(level)
    order = np.argsort(np.concatenate([level, keys]), kind="stable")
    is_key = order >= n
    last = np.maximum.accumulate(np.where(is_key, -1, order))
    at = np.full(len(keys), -1)
    at[order[is_key] - n] = last[is_key]
    ok = at >= 0
    ok[ok] = level[at[ok]] == keys[ok]
    return np.where(ok, at, -1)


def substring_duplicates(documents: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot: int = HOT, batch: int = BATCH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, starts, stops (byte offsets of spans), kept_sha256; kept (the bytes left) if ``with_kept``."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = documents.sparkSession
    size = 2 * input_bytes(documents)  # the planner knows the bytes of files, compressed
    if size >= 1 << 60:  # and of nothing else
        size = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(shuffle_width(spark), size // block_bytes)
    width = max(shuffle_width(spark), blocks // TASK_BLOCKS)  # tasks grow with the input, not the bytes of a task
    ranges, left, right = blocks, length - GRAM, length
    span = left + right

    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(id_col, F.lit(LAST_ID)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition(width, "block")

    def emit(block: int, kind: int, rng: np.ndarray, rows: np.ndarray) -> pa.Table:
        """Rows (range, block, kind, cells) with the rows of each range in one cell."""
        order = np.argsort(rng, kind="stable")
        rng, rows = rng[order], rows[order]
        head = _runs(rng)
        edge = np.append(head, len(rng))
        cells = [_squeezed(rows[a:e]) if rows.dtype.names else rows[a:e].tobytes() for a, e in zip(edge[:-1], edge[1:], strict=True)]
        n = len(cells)
        return pa.table({"range": pa.array(rng[head], pa.int64()), "block": pa.array(np.full(n, block), pa.int64()), "kind": pa.array(np.full(n, kind), pa.int32()), "cells": pa.array(cells, pa.binary())})

    packed = "range long, block long, kind int, cells binary"

    def announce(key: tuple, table: pa.Table) -> pa.Table:
        _, ids, raw, off = _block(table)
        p = anchors(raw, off, length)
        if not len(p):
            return emit(key[0].as_py(), 0, np.zeros(0, np.int64), np.zeros((0, 6), np.uint8))
        h = _gram_hashes(raw, p)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], ids[np.searchsorted(off, p[order], "right") - 1]
        head = _runs(h)
        size = np.diff(np.append(head, len(h)))
        several = owner[head] != owner[head + size - 1]
        level = np.where(several, np.ceil(np.log2(size)).astype(np.int64), 0) * 2 + several
        rng, k = _split(h[head], ranges)
        cell = np.empty((len(k), 6), np.uint8)
        cell[:, :5] = k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        cell[:, 5] = level
        return emit(key[0].as_py(), 0, rng, cell)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        cells = [_unpacked(c, 6) for c in table.column("cells").to_pylist()]
        sizes = [len(c) for c in cells]
        cells = np.concatenate(cells)
        k = _keys(cells)
        order = np.argsort(k, kind="stable")
        head = _runs(k[order])
        size = np.diff(np.append(head, len(k)))
        several = np.add.reduceat((cells[order, 5] & 1).astype(np.int64), head) > 0
        places = np.add.reduceat(2.0 ** (cells[order, 5] >> 1), head)
        shared = np.zeros(len(k), bool)
        shared[order] = np.repeat(several | (size > 1), size)
        warm = np.zeros(len(k), np.uint8)
        warm[order] = np.repeat(places > hot, size)
        cells = np.concatenate([cells[:, :5], warm[:, None]], axis=1)
        blocks_of = table.column("block").to_numpy()
        edge = np.concatenate([[0], np.cumsum(sizes)])
        out = [(b, cells[x:y][shared[x:y]].tobytes()) for b, x, y in zip(blocks_of, edge[:-1], edge[1:], strict=True)]
        out = [x for x in out if x[1]]
        n = len(out)
        return pa.table({"range": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array([b for b, _ in out], pa.int64()), "kind": pa.array([0] * n, pa.int32()), "cells": pa.array([c for _, c in out], pa.binary())})

    # A surrounding: owner 8, place in its block 4 + 8, bytes before and after the anchor 1 + 1 (lengths up to 255), the bytes.
    cell_type = np.dtype([("id", "<i8"), ("row", "<i4"), ("at", "<i8"), ("l", "<u2"), ("r", "<u2"), ("bytes", f"V{span}")])
    # A run [at, stop) of starts of windows found, or (other >= 0) the word that the place ``at`` has the surroundings of
    # the place ``other`` in row ``stop``, of the same document: windows found around that place are found here too.
    span_type = np.dtype([("row", "<i4"), ("at", "<i8"), ("stop", "<i8"), ("other", "<i8"), ("l", "<u2")])

    def surround(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        block = key[0].as_py()
        if not len(table) or not len(shared):
            return emit(block, 1, np.zeros(0, np.int64), np.zeros(0, cell_type))
        _, ids, raw, off = _block(table)
        p = anchors(raw, off, length)
        if not len(p):
            return emit(block, 1, np.zeros(0, np.int64), np.zeros(0, cell_type))
        rng, k = _split(_gram_hashes(raw, p), ranges)
        cells = [_unpacked(c, 6) for c in shared.column("cells").to_pylist()]
        theirs = _keys(np.concatenate(cells)) | (np.repeat(shared.column("range").to_numpy(), [len(c) for c in cells]).astype(_U) << _U(_KEY_BITS))
        order = np.argsort(theirs)
        theirs, warm = theirs[order], np.concatenate(cells)[order, 5] > 0
        mine = k | (rng.astype(_U) << _U(_KEY_BITS))
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        met = theirs[at] == mine
        p, rng, warm = p[met], rng[met], warm[at[met]]
        row = np.searchsorted(off, p, "right") - 1
        l, r = np.minimum(left, p - off[row]), np.minimum(right, off[row + 1] - p)
        if warm.any():  # single windows instead, dealt out by their own hashes
            many = [(p[warm] - j, row[warm]) for j in range(left + 1)]
            q, qrow = np.concatenate([x for x, _ in many]), np.concatenate([x for _, x in many])
            fits = (q >= off[qrow]) & (q + length <= off[qrow + 1])
            q, pick = np.unique(q[fits], return_index=True)
            qrow = qrow[fits][pick]
            lo = np.array([int.from_bytes(hashlib.blake2b(raw[x : x + length].tobytes(), digest_size=8).digest(), "little") for x in q], _U) if len(q) else np.zeros(0, _U)
            p, row = np.concatenate([p[~warm], q]), np.concatenate([row[~warm], qrow])
            l, r = np.concatenate([l[~warm], np.zeros(len(q), np.int64)]), np.concatenate([r[~warm], np.full(len(q), length)])
            rng = np.concatenate([rng[~warm], (lo % _U(ranges)).astype(np.int64)])
        fits = l + r >= length
        p, row, l, r, rng = p[fits], row[fits], l[fits], r[fits], rng[fits]
        padded = np.concatenate([np.zeros(left, np.uint8), raw, np.zeros(right, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, span)
        out_rows, out_rng, told = [], [], []
        # The anchors of one hash together, so that equal surroundings meet; slices bound the memory.
        order = np.argsort(rng, kind="stable")
        edges = np.append(_runs(rng[order]), len(order))
        start = 0
        while start < len(edges) - 1:
            stop = start + 1
            while stop < len(edges) - 1 and edges[stop + 1] - edges[start] <= 100_000:
                stop += 1
            pick = order[edges[start] : edges[stop]]
            start = stop
            pick = np.sort(pick)  # by row, so by document
            c = around[p[pick]].copy()
            c[np.arange(span)[None, :] < (left - l[pick])[:, None]] = 0
            c[np.arange(span)[None, :] >= (left + r[pick])[:, None]] = 0
            tagged = np.concatenate([c, l[pick].astype("<u2")[:, None].view(np.uint8), r[pick].astype("<u2")[:, None].view(np.uint8)], axis=1)
            _, first, inverse = np.unique(np.ascontiguousarray(tagged).view(f"V{span + 4}")[:, 0], return_index=True, return_inverse=True)
            least = np.full(len(first), len(pick))
            np.minimum.at(least, inverse, np.arange(len(pick)))
            rep = least[inverse]
            lead = rep == np.arange(len(pick))
            cell = np.zeros(int(lead.sum()), cell_type)
            g = pick[lead]
            cell["id"], cell["row"], cell["at"], cell["l"], cell["r"] = ids[row[g]], row[g], p[g] - off[row[g]], l[g], r[g]
            cell["bytes"] = np.ascontiguousarray(c[lead]).view(f"V{span}")[:, 0]
            out_rows.append(cell)
            out_rng.append(rng[g])
            rest, base = pick[~lead], pick[rep[~lead]]
            s = np.zeros(len(rest), span_type)
            s["row"], s["at"], s["stop"], s["other"] = row[rest], p[rest] - off[row[rest]] - l[rest], p[rest] - off[row[rest]] + r[rest] - length + 1, -1
            same = ids[row[rest]] == ids[row[base]]
            s["at"][same], s["stop"][same] = (p[rest] - off[row[rest]])[same], row[base][same]
            s["other"][same], s["l"][same] = (p[base] - off[row[base]])[same], l[rest][same]
            told.append(s)
        parts = [emit(block, 1, np.concatenate(out_rng), np.concatenate(out_rows))] if out_rows else []
        s = np.concatenate(told) if told else np.zeros(0, span_type)
        plain, alias = s[s["other"] < 0], s[s["other"] >= 0]
        if len(plain):
            parts.append(_cell(block, 2, _squeezed(_merged(plain))))
        if len(alias):
            parts.append(_cell(block, 3, _squeezed(alias)))
        return pa.concat_tables(parts) if parts else emit(block, 1, np.zeros(0, np.int64), np.zeros(0, cell_type))

    def _cell(block: int, kind: int, cells: bytes) -> pa.Table:
        return pa.table({"range": pa.array([block], pa.int64()), "block": pa.array([block], pa.int64()), "kind": pa.array([kind], pa.int32()), "cells": pa.array([cells], pa.binary())})

    def _merged(s: np.ndarray) -> np.ndarray:
        """The union of runs, row by row."""
        s = s[np.lexsort((s["at"], s["row"]))]
        big = int(s["stop"].max()) + 1
        a, e = s["row"] * np.int64(big) + s["at"], s["row"] * np.int64(big) + s["stop"]
        reach = np.maximum.accumulate(e)
        head = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
        out = s[head]
        out["stop"] = np.maximum.reduceat(e, head) - out["row"] * np.int64(big)
        return out

    def search(key: tuple, table: pa.Table) -> pa.Table:
        kinds, cells, owners = table.column("kind").to_numpy(), table.column("cells").to_pylist(), table.column("block").to_numpy()
        passed = [_cell(int(b), int(k), c) for k, c, b in zip(kinds, cells, owners, strict=True) if k != 1]
        asked = [(b, _expanded(c, cell_type)) for k, c, b in zip(kinds, cells, owners, strict=True) if k == 1]
        if not asked:
            return pa.concat_tables(passed) if passed else emit(0, 2, np.zeros(0, np.int64), np.zeros(0, span_type))
        block = np.repeat([b for b, _ in asked], [len(c) for _, c in asked])
        q = np.concatenate([c for _, c in asked])
        order = np.argsort(q["id"], kind="stable")
        q, block = q[order], block[order]
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def told(i: np.ndarray, a: np.ndarray, e: np.ndarray) -> None:
            s = np.zeros(len(i), span_type)
            s["row"], s["at"], s["stop"], s["other"] = q["row"][i], a, e, -1
            found.append((block[i], s))

        # Equal surroundings of other documents: every window of the later one is found.
        tag = np.zeros(len(q), np.dtype([("l", "<u2"), ("r", "<u2"), ("bytes", f"V{span}")]))
        for n in ("l", "r", "bytes"):
            tag[n] = q[n]
        _, inverse = np.unique(tag.view(f"V{span + 4}"), return_inverse=True)
        least = np.full(int(inverse.max()) + 1, len(q))
        np.minimum.at(least, inverse, np.arange(len(q)))
        rep = least[inverse]
        later = np.flatnonzero(q["id"] > q["id"][rep])
        told(later, q["at"][later] - q["l"][later], q["at"][later] + q["r"][later].astype(np.int64) - length + 1)
        # Anchors with one surrounding have no other windows to find.
        lead = np.flatnonzero(q["id"] == q["id"][rep])
        text = np.frombuffer(q["bytes"][lead].tobytes(), np.uint8).reshape(len(lead), span)
        gram = np.ascontiguousarray(text[:, left : left + GRAM]).view(f"S{GRAM}")[:, 0]
        _, gid, count = np.unique(gram, return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[gid] > 1)
        family, per = SuffixFamily(), max(1, batch // (left + 1))
        for i in range(0, len(many), per):
            part = many[i : i + per]
            g = lead[part]
            low, high = np.maximum(0, length - q["r"][g].astype(np.int64)), q["l"][g].astype(np.int64)  # bytes before the anchor
            n = high - low + 1
            who = np.repeat(np.arange(len(part)), n)
            before = np.repeat(low, n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            view = np.lib.stride_tricks.sliding_window_view(text[part], length, axis=1)
            w = np.ascontiguousarray(view[who, left - before]).view(f"S{length}")[:, 0]
            hit = family.add(w, q["id"][g][who])
            a = q["at"][g][who][hit] - before[hit]
            told(g[who][hit], a, a + 1)
        b, s = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        parts = list(passed)
        order = np.argsort(b, kind="stable")
        edges = np.append(_runs(b[order]), len(b))
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            pick = order[x:y]
            parts.append(_cell(int(b[pick[0]]), 2, _squeezed(_merged(s[pick]))))
        return pa.concat_tables(parts) if parts else emit(0, 2, np.zeros(0, np.int64), np.zeros(0, span_type))

    def remove(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        order, ids, raw, off = _block(table)
        cells, kinds = told.column("cells").to_pylist(), told.column("kind").to_pylist()
        none = np.zeros(0, span_type)
        s = np.concatenate([none, *[_expanded(c, span_type) for c, k in zip(cells, kinds, strict=True) if k == 2]])
        alias = np.concatenate([none, *[_expanded(c, span_type) for c, k in zip(cells, kinds, strict=True) if k == 3]])
        step = np.zeros(len(raw) + 1, np.int32)
        np.add.at(step, off[s["row"]] + s["at"], 1)
        np.add.at(step, off[s["row"]] + s["stop"], -1)
        found = np.cumsum(step)[:-1] > 0  # starts of windows that go
        if len(alias):
            there, here, extra = off[alias["stop"]] + alias["other"], off[alias["row"]] + alias["at"], []
            for before in range(left + 1):
                ok = (before <= alias["l"]) & (there - before >= off[alias["stop"]]) & (there - before + length <= off[alias["stop"] + 1])
                extra.append((here - before)[ok][found[(there - before)[ok]]])
            found[np.concatenate(extra)] = True
        upto = np.concatenate([[0], np.cumsum(found)])
        gone = upto[1:] > upto[np.maximum(np.arange(1, len(raw) + 1) - length, 0)]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        begins = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone])[:-1]))
        ends = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone, [False]])[1:])) + 1
        cut = np.searchsorted(begins, off)
        starts, stops, kept, hashes, removed = [], [], [], [], []
        for i in range(len(ids)):
            a, e = off[i], off[i + 1]
            starts.append(begins[cut[i] : cut[i + 1]] - a)
            stops.append(ends[cut[i] : cut[i + 1]] - a)
            removed.append(int((stops[-1] - starts[-1]).sum()))
            left_over = raw[a:e].tobytes() if not removed[-1] else raw[a:e][~gone[a:e]].tobytes()
            hashes.append(hashlib.sha256(left_over).hexdigest())
            if with_kept:
                kept.append(left_over)
        return pa.table(
            {
                "doc_id": table.column("doc_id").combine_chunks().take(order),
                "n_bytes": pa.array(np.diff(off), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array([len(x) for x in starts], pa.int64()),
                "starts": pa.array(starts, pa.list_(pa.int64())),
                "stops": pa.array(stops, pa.list_(pa.int64())),
                **({"kept": pa.array(kept, pa.binary())} if with_kept else {}),
                "kept_sha256": pa.array(hashes, pa.string()),
            }
        )

    told = docs.groupBy("block").applyInArrow(announce, packed)
    told = told.groupBy("range").applyInArrow(answer, packed)
    told = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(surround, packed)
    told = told.groupBy("range").applyInArrow(search, packed)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, stops array<long>, " + ("kept binary, " if with_kept else "") + "kept_sha256 string"
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, out)

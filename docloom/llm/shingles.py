"""Word shingles of whole texts as 64-bit hashes, over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_STEP = _rng.integers(1, 2**62, 2, dtype=_U) * _U(4) + _U(3)
_POWERS = [np.cumprod(np.full(1 << 12, s, dtype=_U), dtype=_U) for s in _STEP]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of texts that are hashed at once, unless one text alone has more.
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array; nulls are empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, at, data = texts.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, in order, and the number of the text of each."""
    b = _LOWER[raw]
    ink = ~_SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate([[False], ink[:-1]])))
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    stops = np.flatnonzero(ink & (edge[1:] | ~np.concatenate([ink[1:], [False]]))) + 1
    lengths = stops - starts
    at = np.flatnonzero(ink)
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pos = np.arange(len(at)) - np.repeat(heads, lengths)
    v = _BYTE[b[at]] * _POWERS[0][pos & 0xFFF]
    if lengths.max() > 0xFFF:
        v *= _POWERS[1][(pos >> 12) & 0xFFF]
    h = np.add.reduceat(v, heads)
    return mix(h + lengths.astype(_U) * _GOLD), np.searchsorted(off, starts, "right") - 1


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingles of ``k`` words; fewer words are one shingle, none are none."""
    raw, off = buffers(texts)
    for i, j in _pieces(off):
        h, doc = _words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        s = h.copy()
        n = max(len(h) - k + 1, 0)
        for d in range(1, k):
            s[:n] = mix(s[:n] * _GOLD + h[d : d + n])
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for a, e in zip(cut[:-1], cut[1:], strict=True):
            if e - a >= k:
                yield np.unique(s[a : e - k + 1])
            elif e > a:
                short = h[a]
                with np.errstate(over="ignore"):
                    for x in h[a + 1 : e]:
                        short = mix(np.array([short * _GOLD + x]))[0]
                yield mix(np.array([short ^ _U(e - a)]))
            else:
                yield np.zeros(0, _U)

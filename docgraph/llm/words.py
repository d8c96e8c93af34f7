"""Words and word shingles of Arrow string columns as 64-bit hashes, computed over whole batches of bytes."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut at white space.
SLICE = 2 << 20
U = np.uint64


@cache
def _tables() -> tuple:
    rng = np.random.default_rng(20240229)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    exact = value.copy()
    value[65:91] = value[97:123]  # A-Z as a-z
    base = U(0x9E3779B97F4A7C15)
    inverse = U(pow(int(base), -1, 1 << 64))
    n = SLICE + (1 << 16)
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    return space, value, np.cumprod(up), np.cumprod(down), exact


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings (null: none) and len + 1 offsets into them."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.dtype(np.int64 if wide else np.int32)
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offs[-1] - offs[0], offs[0]) if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def spans(gap: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs without a gap inside each text; gap says which bytes are one."""
    n = len(gap)
    first, last = np.empty(n, bool), np.empty(n, bool)
    if n:
        first[0] = last[-1] = True
        first[1:], last[:-1] = gap[:-1], gap[1:]
        edges = offs[(offs > 0) & (offs < n)]
        first[edges] = True
        last[edges - 1] = True
    return np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, exact: bool = False) -> np.ndarray:
    """Hashes of the spans of data, that come in order and do not overlap; A-Z count as a-z unless exact."""
    _, folded, up, down, cased = _tables()
    value = cased if exact else folded
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + SLICE, "right")))
        at, to = int(begin[i]), int(end[j - 1])
        if to - at <= len(up):
            sums = np.zeros(to - at + 1, np.uint64)
            np.cumsum(value[data[at:to]] * up[: to - at], out=sums[1:])
            out[i:j] = (sums[end[i:j] - at] - sums[begin[i:j] - at]) * down[begin[i:j] - at] + (end[i:j] - begin[i:j]).astype(np.uint64)
        else:  # one span longer than a slice
            h = 0
            for k in range(at, to, SLICE):
                part = value[data[k : min(to, k + SLICE)]]
                h = (h * 0x100000001B3 + int((part * up[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
            out[i] = h
        i = j
    return mixed(out)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (maximal runs of other bytes than 0x20 and 0x09-0x0D, A-Z lower-cased), and len + 1 offsets by text."""
    begin, end = spans(_tables()[0][data], offs)
    return span_hashes(data, begin, end), np.searchsorted(begin, offs)


def shingle_hashes(words: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words, with repeats, and offsets by text. A text with fewer words has its whole sequence as one run; one without words has none."""
    counts = np.diff(offs)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    factors = np.random.default_rng(width).integers(0, 1 << 63, width, dtype=np.uint64) * U(2) + U(1)  # of no common pattern, or permuted words collide
    for k in range(width):
        rolled += words[k : n - width + 1 + k] * factors[k] if len(rolled) else U(0)
    rolled = mixed(rolled)
    keep = np.zeros(len(rolled) + 1, np.int32)  # +1 where a text's runs begin, -1 where they end
    long = counts >= width
    np.add.at(keep, offs[:-1][long], 1)
    np.add.at(keep, offs[1:][long] - width + 1, -1)
    own = rolled[np.cumsum(keep[:-1]) > 0]
    n_own = np.where(long, counts - width + 1, (counts > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(n_own)])
    short = np.flatnonzero(~long & (counts > 0))
    if not len(short):
        return own, to
    out = np.empty(to[-1], np.uint64)
    mask = np.ones(to[-1], bool)
    mask[to[short]] = False
    out[mask] = own
    for i in short:
        h = 0xC2B2AE3D27D4EB4F + int(counts[i])
        for w in words[offs[i] : offs[i + 1]]:
            h = (h * 0x9E3779B185EBCA87 + int(w)) % (1 << 64)
        out[to[i]] = mixed(np.array([h], np.uint64))[0]
    return out, to

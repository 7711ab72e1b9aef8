"""Hashes of bytes, words and runs of them, computed for whole batches with numpy.

A run of symbols s_i..s_j-1 has the polynomial hash sum(s_x * BASE**(x - i)) modulo 2**64, taken from
prefix sums, so that the hash of any run costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
BYTE_SYMBOL = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Symbols handled at a time; a longer text is taken in overlapping pieces.
PIECE = 1 << 19
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * powers(BASE, len(symbols)), out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(BASE_INVERSE, len(sums))[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column end to end as UTF-8 bytes, and where each starts. Null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts, each with up to `most` bytes, or one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ([^\\x20\\x09-\\x0D]+) in data, and the first word of each text (n + 1 numbers)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(letter[:-1], out=before[1:])
    before |= cut[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(letter[1:], out=after[:-1])
    after |= cut[1:]
    starts, ends = np.flatnonzero(letter & before), np.flatnonzero(letter & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; taken piece by piece so that memory stays small."""
    out = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        low = starts[first]
        sums = prefix_sums(BYTE_SYMBOL[data[low : ends[last - 1]]])
        out[first:last] = run_hash(sums, starts[first:last] - low, ends[first:last] - low) ^ mix(
            (ends[first:last] - starts[first:last]).astype(U64)
        )
        first = last
    return out


def anchors(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Every window of `window` symbols within one text, held by its anchor.

    A window's anchor is its gram (run of `gram` symbols) of smallest hash, the leftmost if several: equal
    windows have equal anchors at equal places. Consecutive windows with the same anchor make one row:
    text (index), first (first window's start), n (windows), at (anchor's place from first), gram (hash of
    the anchor), ctx (hash of all that the row's windows cover). In periodic text the next n windows may have
    the same anchor and content again, and so on: they stay in the row, times tells how often.
    """
    parts = []
    for a, b in groups_of(offsets, PIECE):
        if offsets[b] - offsets[a] <= PIECE:
            parts.append((a, offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a], offsets[a], offsets[b]))
        else:  # a long text, in pieces that overlap by a window less one
            for low in range(int(offsets[a]), max(int(offsets[b]) - window + 1, int(offsets[a]) + 1), PIECE - window + 1):
                high = min(low + PIECE, int(offsets[b]))
                parts.append((a, np.array([0]), np.array([high - low]), low, high))
    found = [x for part in parts if (x := _anchors(symbols, *part, offsets, window, gram)) is not None]
    names = ("text", "first", "n", "at", "gram", "ctx", "times")
    return {k: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i, k in enumerate(names)}


def _anchors(symbols, text, begin, end, low, high, offsets, window, gram):
    counts = np.maximum(end - begin - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return None
    sums = prefix_sums(symbols[low:high])
    n = high - low
    grams = mix((sums[gram:] - sums[:-gram]) * powers(BASE_INVERSE, n + 1)[: n - gram + 1])
    key = (grams & U64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=U64)
    m = window - gram + 1
    padded = np.full(-(-len(key) // m) * m, np.iinfo(U64).max, U64)
    padded[: len(key)] = key
    block = padded.reshape(-1, m)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(total)
    place = (np.minimum(after[start], before[start + m - 1]) & U64(0xFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    first, last = start[edge], start[np.concatenate((edge[1:] - 1, [total - 1]))]
    at = place[edge]
    ctx = run_hash(sums, first, last + window) ^ mix((at - first).astype(U64) * U64(1000003) + (last - first).astype(U64))
    index = text + np.searchsorted(begin, first, "right") - 1
    gram_hash = grams[at]
    again = (index[1:] == index[:-1]) & (gram_hash[1:] == gram_hash[:-1]) & (ctx[1:] == ctx[:-1])
    head = np.flatnonzero(np.concatenate(([True], ~again)))
    times = np.diff(np.append(head, len(index)))
    index, first, last, at = index[head], first[head], last[head], at[head]
    return index, first + low - offsets[index], last - first + 1, at - first, gram_hash[head].view(np.int64), ctx[head].view(np.int64), times

"""Array kernels on raw UTF-8 bytes: words, word hashes, n-gram hashes, sliding minima.

All work on whole batches of texts at once. A word's hash depends on its bytes only, a
window's hash on its words only, so equal content has equal hashes on any machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_BLOCK = 1 << 20

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Separators of "blank" words are space and 0x09-0x0D; all else belongs to words.
BLANK_WORD = np.ones(256, dtype=bool)
BLANK_WORD[[32, 9, 10, 11, 12, 13]] = False
#: "Alphanumeric" words (of lower-cased text) hold 0-9, a-z and every byte of a non-ASCII character.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[48:58] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (in place on a fresh array)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def _stream(seed: int, n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    return mix(x)


_TABLE = _stream(0x5EED, 256)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, dtype=U64), np.full(size, inverse, dtype=U64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
        if size <= 1 << 22:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and n + 1 offsets into them. A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int):
    """(first, end) ranges of texts of about `most` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(end, n)
        first = min(end, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words as byte offsets, and n + 1 offsets of the texts into these."""
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=U64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        up, down = powers(_BASE, to - at)
        total = np.empty(to - at + 1, dtype=U64)
        total[0] = 0
        np.cumsum(_TABLE[data[at:to]] * up, out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def gram_hashes(symbols: np.ndarray, n: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of each run of n symbols (64-bit values); one for each start, none beyond the end."""
    m = len(symbols) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    if n <= 8:
        up, _ = powers(base, n)
        out = symbols[:m] * up[0]
        for k in range(1, n):
            out += symbols[k : k + m] * up[k]
        return mix(out)
    out = np.empty(m, dtype=U64)
    for at in range(0, m, _BLOCK):
        to = min(m, at + _BLOCK)
        up, down = powers(base, to - at + n)
        total = np.empty(to - at + n, dtype=U64)
        total[0] = 0
        np.cumsum(symbols[at : to + n - 1] * up[: to + n - 1 - at], out=total[1:])
        out[at:to] = (total[n:] - total[: to - at]) * down[: to - at]
    return mix(out)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def inside_text(offsets: np.ndarray, n: int) -> np.ndarray:
    """For each start of a run of n symbols, whether the run stays in one text. offsets: of the texts into symbols."""
    m = int(offsets[-1]) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=bool)
    room = np.repeat(offsets[1:], np.diff(offsets))[:m]
    return np.arange(n, m + n) <= room


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` grams, the index of its smallest gram; the leftmost of equals.

    Grams are compared by their upper 40 bits and then by place, so that equal windows choose
    the gram at the same place inside them.
    """
    out = np.empty(max(0, len(grams) - width + 1), dtype=np.int64)
    most = (1 << 24) - width
    for at in range(0, len(out), most):
        to = min(len(out), at + most)
        part = (grams[at : to + width - 1] & U64(0xFFFFFFFFFF000000)) | np.arange(to - at + width - 1, dtype=U64)
        out[at:to] = (sliding_min(part, width) & U64(0xFFFFFF)).astype(np.int64) + at
    return out


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a run of `length` symbols from any of the starts."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def isin_sorted(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values

"""Distinct word shingles of whole texts as 64-bit hashes, over a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z; other letters stay as they are
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = _RNG.integers(1, 2**63, 65, dtype=np.uint64)
#: Bytes whose hashes are made at once (a longer word goes alone), so that a text of any length takes few bytes a byte.
PIECE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_table(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes and bounds of the texts; for each word its hash, text number, first byte and byte after the last.

    Words are runs of bytes other than white space; A-Z count as a-z. Nulls are empty.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    word = (data != 32) & ((data < 9) | (data > 13))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, at = np.empty(len(start), np.uint64), 0
    power, inverse = _powers(_BASE, min(PIECE, len(data))), _powers(_INVERSE, min(PIECE, len(data)) + 1)
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
            low, high = start[at], end[to - 1]
            if high - low > len(power):
                power, inverse = _powers(_BASE, high - low), _powers(_INVERSE, high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[data[low:high]] * power[: high - low], out=sums[1:])
            a, b = start[at:to] - low, end[at:to] - low
            hashes[at:to] = mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
            at = to
    return data, offsets, hashes, (np.searchsorted(offsets, start, "right") - 1).astype(np.int32), start, end


def sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words.

    Words are runs of bytes other than white space, A-Z lower-cased. A text of fewer
    words has its whole sequence as one shingle; one without words, or a null, has none.
    """
    _, _, word, doc, _, _ = word_table(texts)
    with np.errstate(over="ignore"):
        ends = np.searchsorted(doc, np.arange(len(texts)), "right")
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        n = len(word)
        runs = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            runs += word[k : n - width + 1 + k] * _PLACE[k]
        runs = mixed(runs + _LENGTH[width])
        out = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(runs[a : b - width + 1]))
            elif b > a:
                out.append(mixed((word[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _LENGTH[b - a]))
            else:
                out.append(np.empty(0, np.uint64))
    return out

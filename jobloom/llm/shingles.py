"""Word shingles of whole texts as 64-bit names, for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._common import LOWER, WORD_GAP, chunks

_RNG = np.random.default_rng(20240117)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit name of each word of lower-cased bytes."""
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = WORD_GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _long_text(data: np.ndarray, piece: int) -> np.ndarray:
    """Word names of one long text, a piece at a time, cut between words."""
    names, at = [], 0
    while at < len(data):
        end = min(at + piece, len(data))
        while end < len(data) and not WORD_GAP[data[end]]:
            more = np.flatnonzero(WORD_GAP[data[end : end + piece]])
            end = end + int(more[0]) if len(more) else min(end + piece, len(data))
        names.append(word_names(LOWER[data[at:end]])[1])
        at = end
    return np.concatenate(names) if names else np.zeros(0, np.uint64)


def _joined(names: np.ndarray, words: int) -> np.ndarray:
    """Names of all runs of so many words; with fewer words, of the whole sequence."""
    n = len(names)
    width = min(words, n)
    if not n:
        return names
    out = np.full(n - width + 1, np.uint64(width * 0xA24BAED4963EE407 % 2**64))
    for k in range(width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + names[k : n - width + 1 + k])
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for first, last in chunks(offsets, piece):
        lo, hi = int(offsets[first]), int(offsets[last])
        if last == first + 1 and hi - lo > piece:
            yield np.unique(_joined(_long_text(data[lo:hi], piece), words))
            continue
        # One byte of space after each text keeps the words of two texts apart.
        sizes = np.diff(offsets[first : last + 1])
        shift = np.repeat(np.arange(last - first), sizes)
        spaced = np.full(hi - lo + last - first, 0x20, dtype=np.uint8)
        spaced[np.arange(hi - lo) + shift] = LOWER[data[lo:hi]]
        start, names = word_names(spaced)
        begin = offsets[first:last] - lo + np.arange(last - first)
        cut = np.append(np.searchsorted(start, begin), len(start))
        for k in range(last - first):
            yield np.unique(_joined(names[cut[k] : cut[k + 1]], words))

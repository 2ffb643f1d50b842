"""Anchors: places that depend on the text near them only, so that equal windows have equal anchors.

A window's anchor is the leftmost of its runs of GRAM bytes with the least hash. Consecutive windows with one anchor
make a context: the bytes that those windows cover.
"""

from __future__ import annotations

import numpy as np

from .shingles import _BYTE, mix, powers

GRAM = 64


def contexts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, first, count, name, anchor) of each context of the texts data[begin:end], at most 2**24 bytes in all: the windows
    starting at first, first + 1, ... (count of them) have the same anchor; name is the hash of its run of bytes,
    which starts at anchor."""
    none = np.zeros(0, np.int64)
    n, width = len(data), window - GRAM + 1
    if n < window:
        return none, none, none, none.astype(np.uint64), none
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    name = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    grams = len(name)
    low = np.uint64(0xFFFFFF)
    padded = np.full(-(-grams // width) * width, np.uint64(2**64 - 1))
    padded[:grams] = (name & ~low) | np.arange(grams, dtype=np.uint64)
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = grams - width + 1
    anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & low).astype(np.int64)
    # Windows that lie in one text.
    fits = np.zeros(n + 1, dtype=np.int8)
    long = end - begin >= window
    np.add.at(fits, begin[long], 1)
    np.add.at(fits, end[long] - window + 1, -1)
    valid = np.cumsum(fits[:starts]) > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(fresh)
    stops = np.flatnonzero(valid & ~np.append(valid[1:] & ~fresh[1:], False))
    text = np.searchsorted(begin, first, side="right") - 1
    return text, first, stops - first + 1, name[anchor[first]], anchor[first]

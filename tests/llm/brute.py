"""Brute-force versions that the operators are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(docs, words=2, percent=80):
    sets = {}
    for d, text in docs:
        w = WORD.findall((text or "").translate(FOLD))
        sets[d] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    for d, s in sets.items():
        seen = {}
        for x in s:
            for e in index[x]:
                if e < d:
                    seen[e] = seen.get(e, 0) + 1
        for e, common in seen.items():
            if 100 * common >= percent * (len(s) + len(sets[e]) - common):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def windows_removed(docs, window=200):
    """{doc: (n_bytes, n_removed, n_spans, sha256)} by counting every window of bytes."""
    import hashlib
    from collections import Counter

    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[k : k + window] for _, b in raw for k in range(len(b) - window + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\x01" * window
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out

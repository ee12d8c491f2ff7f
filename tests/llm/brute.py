"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, percent):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    at = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    shared = defaultdict(int)
    for ds in at.values():
        ds.sort()
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(rows, n=100):
    """{doc_id: (bytes, removed, runs, sha of the rest)} for strings of n bytes that start earlier."""
    first, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in first:
                gone[i : i + n] = b"\1" * n
            first.add(s)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out

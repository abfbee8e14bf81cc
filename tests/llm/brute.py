"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import defaultdict


def repeated_bytes(rows, length):
    """rows: (doc_id, text or None) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    least = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - length + 1):
                x = b[i : i + length]
                least[x] = min(least.get(x, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(rows, length):
    """rows: (doc_id, text or None) -> (doc_id, n_words, n_removed, kept_sha256) per row."""
    first = {}
    data = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in data:
        if d is not None:
            for i in range(len(w) - length + 1):
                x = tuple(w[i : i + length])
                first[x] = min(first.get(x, (d, i)), (d, i))
    out = []
    for d, w in data:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i : i + length])] < (d, i):
                    gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5):
    w = (text or "").split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}

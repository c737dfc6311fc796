"""Plain versions of what the operators compute."""

import re

import numpy as np
import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def roots(n, pairs):
    """The smallest member of each one's component."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def lowest(keys, root):
    """For each row the smallest key of its component, nulls only if there is nothing else."""
    low = {}
    for k, r in zip(keys, root, strict=True):
        low[r] = min((v for v in (low.get(r), k) if v is not None), default=None)
    return [low[r] for r in root]


def simhash(text, size=3):
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORDS.findall(lowered)
    spans = [b" ".join(words[i: i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_fingerprints(fps, limit=2):
    a = np.array(fps, np.uint64)
    return [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= limit)]


def words_of(text):
    return len(WORDS.findall((text or "").encode()))


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets of sources by repeated capping; sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = [s for s in order if s not in full]
        if not left:
            return {s: most * sizes[s] for s in order}
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def plain_near_copies(rows, least=0.8):
    """doc_ids that stay, from all pairs of five-word shingle sets."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = lambda a, b: a == b or min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) / len(a | b) >= least
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])
    return sorted(set(lowest([k for k, _ in rows], root)))

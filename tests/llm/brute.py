"""Plain versions of the operators, one document after the other."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for i, t in docs:
        n = SPACE.sub(" ", t or "")
        have = [x for x in groups[n] if x is not None]
        keep = min(have) if have else None
        out.append((i, keep, len(groups[n]), i == keep, sha(n)))
    return out


def substrings(docs, window=13):
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - window + 1):
            s = tuple(w[p:p + window])
            first[s] = min(first.get(s, float("inf")), key(i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < key(i):
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[p:p + n]) for p in range(max(1, len(w) - n + 1))} if w else set()


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def linked(ids, pairs):
    """(id, smallest id of its component, links, kept) from pairs of places."""
    n = Counter(x for p in pairs for x in p)
    root = union(len(ids), pairs)
    key = lambda i: float("inf") if i is None else i
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, float("inf")), key(ids[k]))
    got = [None if least[r] == float("inf") else least[r] for r in root]
    return [(ids[k], got[k], n[k], key(ids[k]) == key(got[k])) for k in range(len(ids))]


def near(docs, threshold=0.8):
    sets = [shingles(t) for _, t in docs]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    both = Counter((a, b) for ks in by.values() for x, a in enumerate(ks) for b in ks[x + 1:])
    pairs = [(a, b) for (a, b), n in both.items() if n / (len(sets[a]) + len(sets[b]) - n) >= threshold]
    return linked([i for i, _ in docs], pairs)


def vectors(rows, threshold=0.93):
    """rows: (vec_id, embedding or None, label)."""
    def good(e, label):
        return label is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)

    groups = defaultdict(list)
    for k, (_, e, label) in enumerate(rows):
        if good(e, label):
            groups[label, len(e)].append(k)
    pairs = []
    for ks in groups.values():
        x = np.array([rows[k][1] for k in ks], float)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        pairs += [(ks[i], ks[j]) for i, j in zip(a, b)]
    return linked([r[0] for r in rows], pairs)


def pieces(docs, encode, capacity=2048):
    out = []
    for i, t in docs:
        ids = encode(t or "") + [0]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        out += [(i, p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:]))]
    return out


def token_rows(docs, encode):
    out, start = [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = encode(t or "") + [1]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def ordered(rows):
    return sorted((tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))

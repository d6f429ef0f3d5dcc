"""Plain versions of the corpus operators, for small tables."""

import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def water_fill(sizes, weights, epochs=3):
    total, level = sum(sizes), 0.0
    held = [False] * len(sizes)
    while True:
        free = sum(w for w, h in zip(weights, held) if not h)
        if not free:
            break
        level = (total - sum(epochs * s for s, h in zip(sizes, held) if h)) / free
        now = [epochs * s <= level * w for s, w in zip(sizes, weights)]
        if now == held:
            break
        held = now
    return [epochs * s if h else level * w for s, w, h in zip(sizes, weights, held)]


def minimax(sizes, shards):
    """Least capacity for a contiguous partition, by binary search over plain sizes."""
    if not sizes:
        return 0
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        n, room = 1, mid
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def closest_components(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_components(rows, percent=85):
    """doc_id -> (n_shingles, component) for (doc_id, text) rows."""
    s = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    comp = closest_components(len(rows), links)
    least = defaultdict(lambda: None)
    for (d, _), c in zip(rows, comp):
        least[c] = d if least[c] is None else min(least[c], d)
    return {d: (len(x), least[c]) for (d, _), x, c in zip(rows, s, comp)}


def repeated_windows(rows, width=50):
    """doc_id -> (n_words, n_removed, kept words)."""
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), [x for i, x in enumerate(w) if i not in gone])
    return out


def crc(text):
    return zlib.crc32((text or "").encode())

"""Plain versions of the operators, one document after another."""

import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [w for w in SPACE.split((text or "").translate(LOWER)) if w]


def shingles(text, size=5):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_groups(texts):
    """{id: (set size, smallest id reachable)}"""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            shared.update((j, i) for j in post[x])
            post[x].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def exact_groups(rows):
    """[(id, keep, size)] of (id, text) rows."""
    by = defaultdict(list)
    for i, t in rows:
        by[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        group = by[SPACE.sub("", t or "")]
        out.append((i, min(group)[2], len(group)))
    return out

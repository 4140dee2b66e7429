"""Plain versions of what the operators do, for small tables."""

import itertools
import re
from collections import Counter


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def shingles(text, k=5):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least) if a or b else 0.0


def classes(nodes, links):
    """The least node of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edit_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def kept_lines(rows, edits, least):
    """{(doc_id, line_no): (first occurrence, links, kept)} for rows (doc_id, text)."""
    found = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if len(x) >= least]
    first = {}
    for d, i, x in sorted(found):
        first.setdefault(x, (d, i))
    near = {x: set() for x in first}
    for x, y in itertools.combinations(first, 2):
        if abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits:
            near[x].add(y)
            near[y].add(x)
    return {
        (d, i): (first[x], len(near[x]), first[x] == (d, i) and all(first[y] > first[x] for y in near[x]))
        for d, i, x in found
    }

"""Plain versions of the operators for small inputs."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_components(rows):
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for a, b in {p for h in holders.values() for p in combinations(sorted(h), 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated_windows(rows, k=20):
    """doc_id -> (n_words, kept words)."""
    seen, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            seen.setdefault(tuple(words[d][i : i + k]), (d, i))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] < (d, i):
                gone.update(range(i, i + k))
        out[d] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out

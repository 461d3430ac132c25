"""Plain Python versions of the contracts."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def repeats(rows, window):
    """Kept words of (id, text) rows and how many were removed."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    place = [(float("inf") if i is None else i) for i, _ in rows]
    for d, w in zip(place, words, strict=True):
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            first[key] = min(first.get(key, (d, p)), (d, p))
    out = []
    for d, w in zip(place, words, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (d, p):
                gone.update(range(p, p + window))
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def lines(ids, texts, min_docs):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = {}
    for i, s in zip(ids, split, strict=True):
        for x in s:
            seen.setdefault(key(x), set()).add(i)
    keep = [[x for x in s if not key(x) or len(seen[key(x)]) < min_docs] for s in split]
    return [("\n".join(k), len(s), len(s) - len(k)) for s, k in zip(split, keep, strict=True)]

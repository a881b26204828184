"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def repeats(texts, width=50):
    """doc_id -> (words, removed, hash of what is kept)."""
    own = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(own):
        for k in range(len(own[i]) - width + 1):
            first.setdefault(tuple(own[i][k : k + width]), i)
    out = {}
    for i, w in own.items():
        drop = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                drop.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in drop)
        out[i] = (len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, k):
    w = WORD.findall((text or "").translate(_LOW))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def similar(texts, k=4, percent=85):
    """doc_id -> (shingles, smallest id that links lead to)."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    union, holders = Union(sets), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, common in Counter(j for x in s for j in holders[x]).items():
            if j < i and 100 * common >= percent * (len(s) + len(sets[j]) - common):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def quality(text):
    """(words, characters in words, symbols, repeated lines, words in repeated windows)."""
    text = text or ""
    w, seen, lines = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    mark = set()
    for k in range(len(w) - 4):
        if times[tuple(w[k : k + 5])] > 1:
            mark.update(range(k, k + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, lines, len(mark)

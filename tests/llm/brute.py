"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import defaultdict


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_components(rows):
    """id -> (n_shingles, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(plain.encode()).hexdigest()].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], d) for d, g in groups.items() for _, i in g}


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for k in range(max(0, len(w) - window) + 1 if w else 0):
            windows[tuple(w[k : k + window])].add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(found))
    return out

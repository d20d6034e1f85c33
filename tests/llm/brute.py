"""Plain versions of the contracts, one text at a time, to hold the operators against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def near(docs, width=5, similarity=85):
    """docs: [(id, text)] with distinct ids."""
    sets = {}
    for i, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = Counter()
    for held in by.values():
        for a in range(len(held)):
            for b in range(a):
                pairs[held[b], held[a]] += 1
    for (a, b), common in pairs.items():
        if 100 * common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least = {}
    for i in sets:
        least[find(i)] = min(i, least.get(find(i), i))
    return {i: (len(s), least[find(i)]) for i, s in sets.items()}


def substrings(docs, window=50):
    first = {}
    split = [(i, words(t)) for i, t in docs]
    for i, w in split:
        if i is None:
            continue
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def quality(text):
    w = [x.decode() for x in words(text)]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().strip()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def secrets(text):
    text = text or ""
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    pattern = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in names)
    found = [("assign", *m.span()) for m in re.finditer(rf"""({pattern})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    found.sort(key=lambda s: (s[1], order.index(s[0])))
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (*[sum(s[0] == k for s in found) for k in order], hashlib.sha256(joined.encode()).hexdigest(), joined)


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())

"""Plain brute-force versions of the operators, for small fixtures."""
import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def op1(docs, length=20):
    first, out = {}, {}
    docs = sorted(docs.items())
    for d, text in docs:
        w = words(text)
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i:i + length]), (d, i))
    for d, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] != (d, i):
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), sha(kept))
    return out


def op3(docs, length=200):
    count = defaultdict(int)
    raw = {d: (t or "").encode() for d, t in docs.items()}
    for b in raw.values():
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, k=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def op2(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs.items()}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    cand = set()
    for ds in by.values():
        if len(ds) < 400:
            cand.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1:])
        else:
            cand.update(zip(ds, ds[1:]))
    links = []
    for a, b in cand:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    root = union_find(docs, links)
    return {d: (len(sets[d]), root[d]) for d in docs}

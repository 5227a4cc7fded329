"""Plain restatements of the contracts, for small tables."""

import base64
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def quality_base(text):
    w, lines, seen, dup = words(text), (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def contamination(docs, items, window=10):
    found = {}
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, ids = BENCH_WORD.findall((text or "").translate(LOWER)), set(), set()
        for k in {len(f) for f in found}:
            for p in range(len(w) - k + 1):
                if owners := found.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    ids |= owners
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def groups(docs, size, percent):
    sets, parent = {}, {}
    for doc, text in docs:
        w = [x.translate(LOWER) for x in words(text)]
        k = min(size, len(w))
        sets.setdefault(doc, []).append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a is not None and b is not None and a < b:
                if any(100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b] if s and t):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {doc: root(doc) for doc in sets}, sets


def repeats(docs, window=50):
    first = {}
    order = lambda d: (d is None, d)
    for doc, text in docs:
        w = words(text)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key not in first or order(doc) < order(first[key]):
                first[key] = doc
    out = []
    for doc, text in docs:
        w, gone = words(text), set()
        for p in range(len(w) - window + 1):
            if order(first[tuple(w[p : p + window])]) < order(doc):
                gone |= set(range(p, p + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def warc(pages):
    same = {}
    for page, _, html in pages:
        same.setdefault((html or "").encode(), []).append(page)
    out = []
    for payload, ids in same.items():
        top = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            kept = top is None or i == top
            out.append((i, len(payload), digest, "response" if kept else "revisit", None if kept else top))
    return out

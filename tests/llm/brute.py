"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def folded(text):
    return FOLDED.findall((text or "").translate(UPPER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    w, text = words(text), text or ""
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    counts = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)
    return (*counts, len(w) < 20 or 100 * len(hit) > 30 * len(w))


def repeats(rows, window=13):
    """{row number: (n_words, n_removed, kept text)}"""
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            order = (doc is None, doc)
            if key not in first or order < first[key]:
                first[key] = order
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc is None, doc):
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = folded(text)
        if w:
            size = min(13, len(w))
            for i in range(len(w) - size + 1):
                windows[tuple(w[i : i + size])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = folded(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                if key in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), names))
    return out


def shingle_counts(text):
    w = folded(text)
    size = min(5, len(w))
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else Counter()


def near_classes(rows, least=0.8):
    """{id: smallest id of its class}"""
    counts = [(doc, shingle_counts(text)) for doc, text in rows if doc is not None]
    parent = {doc: doc for doc, _ in counts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, (_, c) in enumerate(counts):
        for k in c:
            holders[k].append(i)
    for i, (doc, c) in enumerate(counts):
        for j in {j for k in c for j in holders[k] if j < i}:
            d = counts[j][1]
            common = sum((c & d).values())
            if common >= least * (sum(c.values()) + sum(d.values()) - common):
                a, b = find(doc), find(counts[j][0])
                parent[max(a, b)] = min(a, b)
    return {doc: find(doc) for doc in parent}

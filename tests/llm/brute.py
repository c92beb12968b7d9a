"""Plain-Python answers for small inputs, written without the package's helpers."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_windows(rows, window=35):
    """{row number: (n_words, n_removed, sha256)} by counting every window of every row."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(rows, size=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256): strings that start in a document of a smaller id."""
    data = [(doc, (t or "").encode()) for doc, t in rows]
    first = {}
    for doc, b in data:
        for i in range(len(b) - size + 1):
            s = b[i:i + size]
            key = (doc is not None, doc)
            if s not in first or key < first[s]:
                first[s] = key
    out = []
    for doc, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i:i + size]] < (doc is not None, doc):
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, size=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked_components(fingerprints, max_bits=4):
    """{fingerprint: root} by comparing all pairs."""
    fps = sorted(set(fingerprints))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def near_duplicates(rows):
    fps = [simhash(t) for _, t in rows]
    roots, least = linked_components(fps), defaultdict(list)
    for (doc, _), f in zip(rows, fps):
        if doc is not None:
            least[roots[f]].append(doc)
    return [(doc, f"{f:016x}", min(least[roots[f]], default=None)) for (doc, _), f in zip(rows, fps)]

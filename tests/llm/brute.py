"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LAST = 1 << 63
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order(doc_id):
    return LAST if doc_id is None else doc_id


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def cut_repeats(rows, sequence, window):
    """Rows (doc_id, text) to (doc_id, symbols, removed flags)."""
    least = {}
    for doc_id, text in rows:
        s = sequence(text)
        for i in range(len(s) - window + 1):
            key = tuple(s[i : i + window])
            least[key] = min(least.get(key, LAST), order(doc_id))
    out = []
    for doc_id, text in rows:
        s = sequence(text)
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if least[tuple(s[i : i + window])] < order(doc_id):
                gone[i : i + window] = [True] * window
        out.append((doc_id, s, gone))
    return out


def cut_words(rows, window=13):
    return [
        (doc_id, len(s), sum(gone), sha(" ".join(w for w, g in zip(s, gone) if not g)))
        for doc_id, s, gone in cut_repeats(rows, words, window)
    ]


def cut_bytes(rows, window=50):
    out = []
    for doc_id, s, gone in cut_repeats(rows, lambda t: (t or "").encode(), window):
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((doc_id, len(s), sum(gone), spans, sha(bytes(b for b, g in zip(s, gone) if not g))))
    return out


def shingles(text, n=5):
    w = words((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(rows):
    sets = [shingles(t) for _, t in rows]
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                near[i].add(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        least = min(order(rows[k][0]) for k in seen)
        out.append((doc_id, len(sets[i]), None if least == LAST else least))
    return out


def hits(rows, items, window=13):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))

    spans = defaultdict(set)
    for item, text in items:
        w = split(text)
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                spans[tuple(w[i : i + n])].add(item)
    out = []
    for doc_id, text in rows:
        w = split(text)
        hit, found = set(), set()
        for n in {len(k) for k in spans}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in spans:
                    hit |= set(range(i, i + n))
                    found |= spans[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def targets(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    """Source sizes (None last) to targets, by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > limit * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in open_}
        for s in above:
            out[s] = limit * sizes[s]
            left -= out[s]
        open_ -= above
    return out

"""Plain definitions of the results, one text at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingles(text):
    w = words(text, lower=True)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_duplicates(rows):
    """rows: (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [(d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets]


def leaks(rows, items):
    def read(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    out = []
    windows = defaultdict(set)
    for item, text in items:
        w = read(text)
        k = min(len(w), 10)
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    for d, text in rows:
        w, hit, found = read(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), listed, bool(hit)))
    return out


_SECRETS = {
    "assign": (
        r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        12,
    ),
    "access": (r"(AKIA[A-Z0-9]+)", 18),
    "hex": (r"([0-9a-f]+)", 16),
}


def base_spans(text):
    spans = []
    for rank, (kind, (pattern, least)) in enumerate(_SECRETS.items()):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[1]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(spans)]


def repeats(rows, k=50):
    first = {}
    for d, text in rows:
        if d is not None:
            w = words(text)
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                first[g] = min(d, first.get(g, d))
    out = []
    for d, text in rows:
        w = words(text)
        gone = set()
        if d is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < d:
                    gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality(d, text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def unigram(rows):
    counts, read = Counter(), []
    for d, text in rows:
        held_out = zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        w = [*words(text, lower=True), None]
        read.append((d, held_out, w))
        if not held_out:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    size = math.log10(total + 0.5 * (distinct + 1))
    return [
        (d, h, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10(counts[x] + 0.5) - size for x in w))
        for d, h, w in read
    ]

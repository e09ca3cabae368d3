"""Brute-force versions on plain lists."""

import hashlib
import re
from collections import Counter

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = split(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, prints):
    """Smallest id (None: no id) of the component of each row."""
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(b)] = root(a)
    least = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for p in prints]


def repeats(rows, window=13):
    """(n_words, n_removed, sha) of each (doc_id, text); no id counts as the largest."""
    big = float("inf")
    first = {}
    for i, text in rows:
        w, i = split(text), big if i is None else i
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, big))
    out = []
    for i, text in rows:
        w, i = split(text), big if i is None else i
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_rules(text):
    w = split(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by source: shares by weight, capped, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, float(sum(sizes.values())), list(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def smith_waterman(a, b, match=2, miss=-1, gap=1):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, last[j - 1] + (match if x == y else miss), last[j] - gap, row[j - 1] - gap))
        best, last = max(best, *row), row
    return best

"""Plain-Python versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(s):
    return s.encode().lower().decode()


def measures(text):
    t = text or ""
    w = words(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = [x for x in t.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(w)
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup,
        "n_repeat_words": len(covered), "base_failed": n < 50 or 100 * len(covered) > 50 * n, "n_lines": len(lines),
    }


def targets(sizes, weights=(5, 2, 1), most=3):
    """source -> target by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def line_key(line):
    return lower_ascii(line.strip(" \t\n\x0b\x0c\r"))


def line_dedup(docs, least=5, chars=40):
    """docs: (doc_id, text) -> (doc_id, n_lines, n_dropped, sha)."""
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(i)
    drop = {k: max(v) for k, v in holders.items() if len(k) >= chars and len(v) >= least}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if drop.get(line_key(x), i) == i]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def shingles(text, n=5):
    w = words(lower_ascii(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard_components(docs):
    """(doc_id, n_shingles, component_id), by an inverted list of all shingles."""
    sets = {i: shingles(t) for i, t in docs}
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
    common = Counter()
    for members in by.values():
        members.sort()
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                common[members[a], members[b]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [(i, len(s), find(i)) for i, s in sets.items()]


def window_dedup(docs, size=13):
    """(doc_id, n_words, n_removed, sha) with each word in a window that starts in a smaller document removed."""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, i), i)
    for i, t in docs:
        w = words(t)
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        yield i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()

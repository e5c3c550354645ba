"""Plain single-process versions of the operators, to hold results against."""

import re
import string
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w = words(text)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def simhash(text, k=3):
    import xxhash

    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    """Component of each of n items, as the least index, where ``linked`` yields pairs."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_components(rows):
    """doc_id -> component_id for (doc_id, text) rows."""
    import numpy as np

    prints = np.array([simhash(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    root = classes(len(rows), zip(*np.nonzero(near)))
    least = {}
    for r, (d, _) in zip(root, rows):
        least[r] = min(least.get(r, d), d)
    return {d: least[r] for r, (d, _) in zip(root, rows)}


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, got, free = sum(sizes.values()), {}, set(order)
    while free:
        left, share = total - sum(got.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / share > 3 * sizes[s]}
        if not over:
            return got | {s: left * weight[s] / share for s in free}
        got |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return got


def line_classes(lines, k, threshold):
    """Component (least line) of each distinct line, by Jaccard similarity of character shingles."""
    sets = [frozenset(x[i : i + k] for i in range(max(1, len(x) - k + 1))) for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    return classes(len(lines), pairs), Counter()

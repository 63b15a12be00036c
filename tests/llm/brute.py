"""Plain versions of the training-data queries, one row at a time."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rules_base(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def substrings(rows, window=13):
    """(key, text) rows to (n_words, n_removed, kept); a null key is the largest."""
    keys = [float("inf") if k is None else k for k, _ in rows]
    split = [words(t) for _, t in rows]
    least = {}
    for k, w in zip(keys, split):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, k), k)
    out = []
    for k, w in zip(keys, split):
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def leaks(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = ITEM.findall(lower(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in docs:
        w, hit, found = ITEM.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        out.append((len(w), sorted(hit), sorted(map(str, found))))
    return out


def fingerprint(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, fps, radius=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius) + i + 1:
            parent[root(int(j))] = root(i)
    groups = {}
    for i in range(len(f)):
        groups.setdefault(root(i), []).append(i)
    out = [None] * len(f)
    for members in groups.values():
        named = [keys[i] for i in members if keys[i] is not None]
        for i in members:
            out[i] = min(named) if named else None
    return out


ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def differencing(weights, k):
    """Karmarkar-Karp with the sets themselves: the sorted sums of the parts."""
    heap = [([w] + [0] * (k - 1), i) for i, w in enumerate(weights)]
    n = len(weights)
    while len(heap) > 1:
        heap.sort(key=lambda x: (-(x[0][0] - x[0][-1]), x[1]))
        (a, _), (b, _), *heap = heap
        heap.append((sorted((x + y for x, y in zip(a, reversed(b))), reverse=True), n))
        n += 1
    return heap[0][0] if heap else [0] * k


def similar_heads(keys, texts, groups, least=0.8):
    """The smallest key of each group that ``groups`` and five-word-shingle similarity connect; the sets are compared in full."""
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(groups)
    by = {}
    for i, s in enumerate(sets):
        near = {j for g in s for j in by.get(g, ())} if s else {j for j in range(i) if not sets[j]}
        for j in near:
            if s == sets[j] or len(s & sets[j]) >= least * len(s | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
        for g in s:
            by.setdefault(g, []).append(i)
    return {min(k for k, r in zip(keys, root) if r == x) for x in set(root)}


def runs(w, least=24, power=3):
    """(start, length, period) of every run, by start and period: all stretches of equal words at every distance."""
    names = {}
    c, best = np.array([names.setdefault(x, len(names)) for x in w], np.int64), {}
    for q in range(1, len(c) // power + 1):
        step = np.diff(np.concatenate(([0], (c[:-q] == c[q:]).astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if b - a + q >= max(least, power * q):
                best.setdefault((a, b - a + q), q)
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda r: (r[0], r[2]))


def negatives(rows, positives=5, negatives=5, low=80, high=100):
    """Rows (key, label, vector); keys divisible by ten are anchors."""
    good = [(k, c, [int(x) for x in v]) for k, c, v in rows if c is not None and v is not None and all(x is not None and abs(x) < 2**62 for x in v) and sum(x * x for x in v) < 2**62]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (k, c, v) in enumerate(good):
        if k is None or k % 10:
            continue
        scores = [(sum(x * y for x, y in zip(v, u)), name, label == c) for j, (name, label, u) in enumerate(good) if j != i and len(u) == len(v)]
        for top, positive, _ in sorted((s for s in scores if s[2]), key=order)[:positives]:
            hard = sorted((s for s in scores if not s[2] and low * top <= 100 * s[0] <= high * top), key=order)[:negatives]
            out += [(k, positive, rank, s[1], top, s[0]) for rank, s in enumerate(hard, 1)]
    return out

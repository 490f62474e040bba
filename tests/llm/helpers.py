"""Brute-force forms of the operators, as plain as can be."""

from __future__ import annotations

import re
from collections import defaultdict

WS = " \t\n\x0b\x0c\r"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(s: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def kept_lines(rows, min_chars=20, min_docs=3):
    """rows: (id, text); a null id sorts first."""
    rank = lambda i: -(2**63) if i is None else i
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[low(line.strip(WS))].add(rank(i))
    gone = lambda i, key: len(key) >= min_chars and len(seen[key]) >= min_docs and rank(i) != max(seen[key])
    return [(i, "\n".join(x for x in (t or "").split("\n") if not gone(i, low(x.strip(WS))))) for i, t in rows]


def shingle_sets(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(SPACE_WORD, low(t))
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def jaccard_components(rows, k, percent):
    """(number of shingles, least id of the component) by row."""
    sets = shingle_sets(rows, k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        ids[find(n)].append(i)
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return [(len(s), least[find(n)]) for n, s in enumerate(sets)]


def hits(docs, items, window=13):
    grams = defaultdict(set)
    for i, t in items:
        w = re.findall(ITEM_WORD, low(t))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[j : j + k])].add(i)
    out = []
    for i, t in docs:
        w = re.findall(ITEM_WORD, low(t))
        hit, own = set(), set()
        for k in {len(g) for g in grams}:
            for j in range(len(w) - k + 1):
                if found := grams.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    own |= found
        out.append((i, len(w), len(hit), sorted(str(x) for x in own if x is not None)))
    return out


def repeats_removed(rows, length=100):
    """(id, bytes, removed, spans, kept) by row, in order of id."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone) if not g)))
    return out


def plain_png(media):
    """Lines of an 8-bit grey PNG, one pixel after the other."""
    import struct
    import zlib

    at, data = 8, b""
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        if kind == b"IHDR":
            w, h = struct.unpack(">II", media[at + 8 : at + 16])
        if kind == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    raw, out, above = zlib.decompress(data), [], [0] * w
    for y in range(h):
        kind, line, now = raw[y * (w + 1)], raw[y * (w + 1) + 1 : (y + 1) * (w + 1)], []
        for x in range(w):
            a, b, c = (now[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now.append((line[x] + (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out.append(now)
        above = now
    return out


def plain_hash(lines, grid=32, low=8):
    """Signs of the low cosine frequencies, by their sums."""
    import math
    from statistics import median

    def cells(rows):
        n = len(rows)
        cut = [(i * n // grid, max((i + 1) * n // grid, i * n // grid + 1)) for i in range(grid)]
        return [[sum(rows[y][x] for y in range(a, b)) / (b - a) for x in range(len(rows[0]))] for a, b in cut]

    small = [list(r) for r in zip(*cells([list(r) for r in zip(*cells(lines))]))]
    wave = [[math.cos(math.pi * (2 * x + 1) * k / (2 * grid)) for x in range(grid)] for k in range(low)]
    freq = [round(sum(wave[u][y] * sum(wave[v][x] * small[y][x] for x in range(grid)) for y in range(grid)), 6) for u in range(low) for v in range(low)]
    middle = median(freq[1:])
    return "".join(str(int(f > middle)) for f in freq), freq, middle

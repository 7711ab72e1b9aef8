"""Plain versions of the operators, over rows in memory."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORDS = "time river stone under light paper garden window silver morning quiet letter bridge market winter yellow copper forest engine harbour".split()
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return SPACE.findall((text or "").encode())


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def crc(doc_id: int | None) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def cover(n: int, starts: list[int], width: int) -> list[bool]:
    out = [False] * n
    for s in starts:
        out[s : s + width] = [True] * width
    return out


def windows_dedup(rows: list[tuple], width: int = 20) -> list[tuple]:
    """op3: rows (doc_id, text); the earlier of equal windows stays; a row given twice is one document."""
    first: dict[tuple, tuple] = {}
    docs = {(-1 if i is None else i, t): words(t) for i, t in rows}
    for (i, t), w in sorted(docs.items(), key=lambda x: x[0][0]):
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), (i, t, s))
    out = []
    for i, t in rows:
        w = words(t)
        key = (-1 if i is None else i, t)
        gone = cover(len(w), [s for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] != (*key, s)], width)
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def bytes_dedup(rows: list[tuple], width: int = 200) -> list[tuple]:
    """op4."""
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(hashlib.md5(b[s : s + width]).digest() for b in raw for s in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = cover(len(b), [s for s in range(len(b) - width + 1) if count[hashlib.md5(b[s : s + width]).digest()] > 1], width)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def fingerprint(text: str | None) -> int:
    w = SPACE.findall((text or "").encode().lower())
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows: list[tuple]) -> list[tuple]:
    """op8."""
    fps = [fingerprint(t) for _, t in rows]
    kinds = sorted(set(fps))
    root = {x: x for x in kinds}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(kinds):
        for y in kinds[a + 1 :]:
            if (x ^ y).bit_count() <= 3:
                root[find(y)] = find(x)
    least: dict[int, int | None] = defaultdict(lambda: None)
    for (i, _), f in zip(rows, fps):
        r = find(f)
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return [(i, f"{f:016x}", least[find(f)]) for (i, _), f in zip(rows, fps)]


def base_lm(rows: list[tuple]) -> list[tuple]:
    """op9's columns up to base_score."""
    held = lambda i: i is not None and crc(i) % 10 == 0
    tokens = [[*SPACE.findall((t or "").encode().lower()), None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    log = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(map(log, ws))) for (i, _), ws in zip(rows, tokens)]

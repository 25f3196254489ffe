"""Plain versions of the text operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def op3(text: str | None) -> tuple[int, int, int, int, int, bool]:
    ws = [w.decode() for w in words(text)]
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    inside = set()
    for i in range(len(ws) - 4):
        if grams[tuple(ws[i : i + 5])] >= 2:
            inside |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, r = len(ws), len(inside)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, r, n < 10 or 100 * r > 20 * n


def op6(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    seen, found = set(), {}
    for key, text in sorted(docs):
        ws = words(text)
        gone = set()
        for i in range(len(ws) - 19):
            w = tuple(ws[i : i + 20])
            if w in seen:
                gone |= set(range(i, i + 20))
            seen.add(w)
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        found[key] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return found


def fingerprint(text: str | None) -> int:
    ws = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op7(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    import numpy as np

    fps = {k: fingerprint(t) for k, t in docs}
    distinct = sorted(set(fps.values()))
    at = np.array(distinct, np.uint64)
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(at ^ at[i]) <= 3).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    place = {f: i for i, f in enumerate(distinct)}
    least: dict[int, int] = {}
    for k, f in fps.items():
        r = root(place[f])
        least[r] = min(k, least.get(r, k))
    return {k: (f, least[root(place[f])]) for k, f in fps.items()}


def op10(texts: list[str | None], depth: int = 400) -> list[tuple[int, int, int, str]]:
    datas = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + depth] for d in datas for i in range(len(d) - depth + 1))
    found = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if counts[d[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        found.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return found


def near(docs: list[tuple[int, str | None]], similarity: float = 0.8, width: int = 5) -> dict[int, int]:
    """Key to the least key that it reaches by links of sets of word shingles (fewer words: all of them) of that Jaccard similarity."""
    sets = {}
    for key, text in docs:
        ws = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]
        sets[key] = frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)) or frozenset([tuple(ws)] if ws else [])
    least = {k: k for k in sets}

    def root(k: int) -> int:
        while least[k] != k:
            k = least[k]
        return k

    holders: dict = {}
    for key, held in sets.items():
        for x in held or [None]:
            holders.setdefault(x, []).append(key)
    for key, held in sets.items():
        shared = Counter(other for x in held or [None] for other in holders[x])
        for other, same in shared.items():
            if not held and not sets[other] or held and same >= similarity * (len(held) + len(sets[other]) - same):
                a, b = root(key), root(other)
                least[max(a, b)] = min(a, b)
    return {k: root(k) for k in sets}


def repeated_words(texts: list[str | None], depth: int = 50) -> list[set[int]]:
    """The places of the words of each text that stand in a window found at two places or more."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(ws[i : i + depth]) for ws in split for i in range(len(ws) - depth + 1))
    return [{j for i in range(len(ws) - depth + 1) if seen[tuple(ws[i : i + depth])] > 1 for j in range(i, i + depth)} for ws in split]


def later_words(texts: list[str | None], depth: int = 50) -> list[set[int]]:
    """The places of the words of each text that stand in a window found at an earlier place too, in this text or one before."""
    seen, out = set(), []
    for ws in map(words, texts):
        gone: set[int] = set()
        for i in range(len(ws) - depth + 1):
            window = tuple(ws[i : i + depth])
            if window in seen:
                gone |= set(range(i, i + depth))
            seen.add(window)
        out.append(gone)
    return out


def op12(docs: list[tuple[int, str | None]], similarity: tuple[int, int] = (85, 100)) -> dict[int, tuple[int, int]]:
    """Key to (shingles, least key that it reaches); sets without a shingle reach themselves only."""
    sets = {}
    for key, text in docs:
        ws = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]
        sets[key] = frozenset(tuple(ws[i : i + 3]) for i in range(len(ws) - 2)) or frozenset([tuple(ws)] if ws else [])
    least = {k: k for k in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    holders: dict = {}
    for key, held in sets.items():
        for x in held:
            holders.setdefault(x, []).append(key)
    for key, held in sets.items():
        for other, same in Counter(o for x in held for o in holders[x]).items():
            if similarity[1] * same >= similarity[0] * (len(held) + len(sets[other]) - same):
                a, b = root(key), root(other)
                least[max(a, b)] = min(a, b)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def op13(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """The rows of the audit from (id, text, source) and (id, quality, toxic), document by document."""
    from itertools import permutations

    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    fails, parts = [], []
    for key, text, source in docs:
        t, ws = text or "", words(text)
        a = len(ws) < 200
        b = 100 * len(set(ws)) < 50 * len(ws)
        c = 100 * sum("A" <= x <= "Z" for x in t) > 2 * len(t)
        d = any(x in "#$%&*|" for x in t)
        e = key is not None and any(k is not None and k < key and (u or "") == t for k, u, _ in docs)
        fails.append({x for x, yes in zip("ABCDE", (a, b, c, d, e), strict=True) if yes})
        parts.append(source or "")
    out = []
    for part in set(parts):
        mine = [i for i, p in enumerate(parts) if p == part]
        rows, shares = [], Counter()
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, x in enumerate(order, 1):
                here = {i for i in left if x in fails[i]}
                gone = [i for i in mine if i not in left and x in fails[i]]
                left -= here
                shares[x] += len(here)
                alone = sum(fails[i] == {x} for i in mine)
                rows.append((part, "".join(order), step, len(left), len(here), len(gone), alone, sum(docs[i][0] in good for i in here), sum(docs[i][0] in toxic for i in here)))
        out += [(*r, shares[r[1][r[2] - 1]]) for r in rows]
    return out

"""Plain twins of the operators, in Python, for small inputs."""

import hashlib
import re
from collections import Counter


def near_classes(docs: dict, words: int = 5, threshold: int = 75) -> dict:
    """id -> (set size, smallest id of its component)."""
    sets = {}
    for d, text in docs.items():
        w = (text or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for d in sorted(docs):
        common = Counter(e for s in sets[d] for e in holders.get(s, ()))
        for e, n in common.items():
            if 100 * n >= threshold * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d: (len(sets[d]), find(d)) for d in docs}


def licenses(text: str | None, phrases: dict) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def notices(text: str | None, templates: dict, slack: int, coverage: float) -> dict:
    """label -> share of the template's word pairs in the longest chain that runs forward in both and shifts little from step to step."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = {}
    for label, template in templates.items():
        t = template.split()
        hits = [(i, j) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2]]
        best: list = []
        for k, (i, j) in enumerate(hits):
            best.append(1 + max((best[m] for m in range(k) if hits[m][0] < i and hits[m][1] < j and abs((i - j) - (hits[m][0] - hits[m][1])) <= slack), default=0))
        if best and max(best) / (len(t) - 1) >= coverage:
            out[label] = max(best) / (len(t) - 1)
    return out


def secrets(text: str | None) -> list:
    found, t = [], text or ""
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def exact(docs: dict) -> dict:
    """id -> (keep_id, group size, sha256)."""
    norm = {d: re.sub(r"[\x20\x09-\x0D]", "", t or "") for d, t in docs.items()}
    groups: dict = {}
    for d, n in norm.items():
        groups.setdefault(n, []).append(d)
    best = {n: min(g, key=lambda d: (-len(docs[d] or ""), d)) for n, g in groups.items()}
    return {d: (best[n], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for d, n in norm.items()}


def least_capacity(sizes: list[int], shards: int) -> int:
    def fits(c):
        used, n = 0, 1
        for s in sizes:
            if s > c:
                return False
            if used + s > c:
                used, n = 0, n + 1
            used += s
        return n <= shards

    low, high = 1, max(1, sum(sizes))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def edit_distance_infix(item: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)

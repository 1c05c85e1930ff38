"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter


def lower_ascii(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t: str | None, n: int = 5) -> frozenset:
    w = words(lower_ascii(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def reach(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest id that each id reaches."""
    up = {i: i for i in ids}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows: list[tuple[int, str | None]], t: int = 80) -> dict[int, tuple[int, int]]:
    sets = {i: shingle_set(x) for i, x in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= t * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    low = reach(ids, links)
    return {i: (len(sets[i]), low[i]) for i in ids}


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Shares of 150 % by weights 3, 1, 2, capped at twice a source's size, by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


BASE = (
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(t: str | None) -> list[tuple[str, int, int]]:
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, fits) in enumerate(BASE) for m in pattern.finditer(t or "") if fits(m)]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def entropy_spans(t: str | None, window: int, hex_bits: float, mixed_bits: float, allow: tuple[str, ...]) -> list[tuple[int, int]]:
    """Every window counted anew."""
    out = set()
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{window},}}", t or ""):
        s = m[0]
        if any(re.search(a if not a.startswith("^(?i)") else "(?i)^" + a[5:], s) for a in allow):
            continue
        some = [(m.start() + h.start(), h[0], hex_bits) for h in re.finditer(rf"[0-9a-fA-F]{{{window},}}", s)]
        if not re.fullmatch("[0-9a-fA-F]+", s):
            some.append((m.start(), s, mixed_bits))
        for at, w, bits in some:
            if not re.search("[0-9]", w) or not re.search("[A-Za-z]", w):
                continue
            last = None
            for i in range(len(w) - window + 1):
                if -sum(c / window * math.log2(c / window) for c in Counter(w[i : i + window]).values()) >= bits - 1e-12:
                    if last is not None and i <= last[1]:
                        last[1] = i + window
                    else:
                        if last is not None:
                            out.add((at + last[0], at + last[1]))
                        last = [i, i + window]
            if last is not None:
                out.add((at + last[0], at + last[1]))
    return sorted(out)

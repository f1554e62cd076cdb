"""Plain-Python statements of the operators' contracts, written without the operators."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    inside = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed


def luhn(digits):
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        s += d - 9 * (d > 9)
    return s % 10 == 0


def pii(text):
    t, out = text or "", []
    only = lambda s: re.sub(r"[^0-9]", "", s)
    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(only(s)) <= 19 and luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15)]
    for rank, (kind, pat, ok) in enumerate(checks):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pat, t) if ok(m.group())]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def secrets(text):
    t, out = text or "", []
    checks = [
        ("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         lambda m: len(m.group(2)) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32)]
    for rank, (kind, pat, ok) in enumerate(checks):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pat, t) if ok(m)]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(text):
    w = words(lower_ascii(text))
    if not w:
        return frozenset()
    if len(w) < 5:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (set size, component)}."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    hold = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            hold[x].append(d)
    overlap = Counter()
    for ds in hold.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                overlap[(a, b)] += 1
    for (a, b), n in overlap.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    places, labels = [], set()
    for p, lab in PHRASES:
        p = p.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += hits
        labels |= {lab} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def url(u):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = lower_ascii(host)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best and best[0], best and best[1]


def targets(sizes):
    """{source: size} -> {source: target}; null sources last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in held]
        if not open_:
            return {s: float(v) for s, v in held.items()}
        level = (total - sum(held.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**{s: float(v) for s, v in held.items()}, **{s: level * weight[s] for s in open_}}
        held.update({s: 3 * sizes[s] for s in over})


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1

"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def _lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > i}:
            if (i, j) not in seen:
                seen.add((i, j))
                common = len(s & sets[j])
                if 100 * common >= 85 * (len(s) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [(d, len(sets[i]), least.get(root(i)), least.get(root(i)) == d if d is not None else least.get(root(i)) is None) for i, (d, _) in enumerate(docs)]


def repeats(docs: list[tuple[int | None, str | None]], span: int = 200) -> list[tuple]:
    data = [(t or "").encode() for _, t in docs]
    count: dict[bytes, int] = defaultdict(int)
    key = lambda b: hashlib.blake2b(b, digest_size=12).digest()
    for b in data:
        for i in range(len(b) - span + 1):
            count[key(b[i : i + span])] += 1
    out = []
    for (d, _), b in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[key(b[i : i + span])] > 1:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def contaminated(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]]) -> list[tuple]:
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
    windows: dict[tuple[str, ...], set] = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = cut(t)
        hit, named = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    named |= {str(i) for i in windows[x] if i is not None}
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def secrets(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    assign = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = []
    for d, t in docs:
        t = t or ""
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        found.sort()
        n = [sum(f[1] == k for f in found) for k in range(3)]
        out.append((d, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()))
    return out


def top(vectors: list[tuple[int, list[float] | None]], k: int = 10, every: int = 100) -> list[tuple]:
    import math

    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in sorted({i: v for i, v in rows if i % every == 0}.items()):
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def shares(sizes: list[int], most: int = 3) -> list[float]:
    """Targets by a water level that is found by bisection: min(most * size, level * weight) sums to the sum of the sizes."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    low, high = 0.0, most * float(max(sizes, default=0)) + 1
    fill = lambda level: [min(most * s, level * w) for s, w in zip(sizes, weights, strict=True)]
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(fill(mid)) < sum(sizes) else (low, mid)
    return fill(high)


def _folded(text: str) -> bytes:
    """A-Z and the capitals of Latin-1 lowered, in UTF-8."""
    return "".join(c.lower() if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text).encode()


_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def language(text: str | None, train: list[tuple[str | None, str | None]], m) -> tuple[str, float]:
    """Predicted language and score; ``m`` has the constants and the script ranges."""
    import math
    from functools import lru_cache

    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0

    def grams(word: bytes) -> list[int]:
        b = b"\0" + word + b"\0"
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % (1 << 32)) >> 17 for i in range(len(word))]

    def script(word: bytes) -> int:
        names = [[n for first, n in m._RANGES if first <= ord(c)][-1] for c in word.decode()]
        return max(m.SCRIPT_NAMES.index(n) for n in names)

    counts, words = _counted(tuple(train), m, grams, script)
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) + m.SMOOTH * m.BUCKETS for k in langs}
    allowed = {s: [k for k in langs if words[k][s] >= m.SCRIPT_SHARE * sum(words[k].values())] or langs for s in range(m.SCRIPTS)}

    @lru_cache(None)
    def scores(word: bytes) -> tuple[float, ...]:
        return tuple(sum(math.log((counts[k][g] + m.SMOOTH) / total[k]) for g in grams(word)) - (0 if k in allowed[script(word)] else 1e4) for k in langs)

    found = _LETTERS.findall(_folded(text))
    best, back = list(scores(found[0])), []
    for w in found[1:]:
        top = max(range(len(langs)), key=lambda i: best[i])
        stay = [best[i] >= best[top] - m.SWITCH for i in range(len(langs))]
        back.append([i if stay[i] else top for i in range(len(langs))])
        best = [max(best[i], best[top] - m.SWITCH) + s for i, s in enumerate(scores(w))]
    at = max(range(len(langs)), key=lambda i: best[i])
    path = [at]
    for b in reversed(back):
        at = b[at]
        path.append(at)
    mass: dict[str, int] = defaultdict(int)
    for w, i in zip(found, reversed(path), strict=True):
        mass[langs[i]] += len(w)
    pred = max(langs, key=lambda k: mass[k])
    return pred, round(mass[pred] / sum(mass.values()), 6)


_COUNTS: dict = {}


def _counted(train, m, grams, script):
    if train not in _COUNTS:
        counts, words = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
        for t, k in train:
            for w in _LETTERS.findall(_folded(t)):
                words[k][script(w)] += 1
                for g in grams(w):
                    counts[k][g] += 1
        _COUNTS[train] = counts, words
    return _COUNTS[train]


def toxicity(text: str | None, model: dict, m, kernel) -> float:
    """The classifier's score from features worked out word by word."""
    import math

    import numpy as np

    raw, low = (text or "").encode(), _folded(text or "")
    one = lambda w: int(kernel.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), kernel.SAME)[0])
    number = {n: dict(zip((int(h) for h in known), (int(i) for i in which), strict=True)) for n, (known, which) in model["by_length"].items()}
    words = _LETTERS.findall(low)
    votes, hits, seen = np.zeros(model["voters"]), 0, {}
    for w in words:
        if w not in seen:
            found = []
            for n in m.LENGTHS:
                if n == 0 or len(w) >= n:
                    h = (one(w) if n == 0 else one(w[:n]) + n) % (1 << 64)
                    if h in number[n]:
                        found.append(number[n][h])
            seen[w] = found
        for i in seen[w]:
            votes[i] = 1
        hits += bool(seen[w])
    letters = sum(1 for c in raw if c >= 128 or chr(c).isalpha())
    upper, bangs = sum(65 <= c <= 90 for c in raw), raw.count(b"!")
    you = sum(w in (b"you", b"your", b"yourself") for w in words)
    signs = m._SIGNS
    odd = [w for w in re.findall(rb"[A-Za-z\x80-\xff013457@$!]+", low) if any(chr(c) in signs for c in w) and any(chr(c) not in signs for c in w)]
    disguised = any("".join(signs.get(chr(c), chr(c)) for c in w) in m.LEXICON for w in odd)
    dense = [upper > 0.5 * max(letters, 1), bangs > 0.01 * max(len(raw), 1), you > 0.02 * max(len(words), 1), disguised, math.log1p(hits), min(1, 20 * hits / max(len(words), 1))]
    odds = min(float(votes @ np.maximum(model["fire"], 0)), 20) / 5
    z = float(np.concatenate([votes, dense, [odds]]) @ model["linear"][:-1] + model["linear"][-1])
    return 1 / (1 + math.exp(-max(min(z, 30), -30)))

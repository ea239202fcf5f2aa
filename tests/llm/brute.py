"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from fieldtally.llm.katz import discounts
from fieldtally.llm.licences import PHRASES
from fieldtally.llm.pii import KINDS
from fieldtally.llm.urls import RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENTITIES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered), failed


def shingles(text: str | None, width: int = 5) -> set:
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return set()
    n = min(width, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def near(rows: list[tuple], percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) for (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return [(d, len(sets[i]), least[root(i)], d is not None and d == least[root(i)]) for i, (d, _) in enumerate(rows)]


def base_scores(rows: list[tuple]) -> list[tuple]:
    def tokens(text):
        return WORD.findall(ascii_lower(text or "")) + [None]

    def out(doc_id):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2

    counts = Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(d, out(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows]


def tiles(a: list, b: list, least: int) -> list[tuple[int, int, int]]:
    """The longest common run of unmarked tokens, the earliest of equals, again and again."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for t in range(len(b)):
                n = 0
                while i + n < len(a) and t + n < len(b) and a[i + n] == b[t + n] and not used_a[i + n] and not used_b[t + n]:
                    n += 1
                best = min(best, (-n, i, t)) if n else best
        n, i, t = -best[0], best[1], best[2]
        if n < max(least, 1):
            return out
        used_a[i:i + n], used_b[t:t + n] = [True] * n, [True] * n
        out.append((i, t, n))


def katz_tokens(text: str | None) -> list:
    return ["<s>", *WORD.findall(ascii_lower(text or "")), None]


def katz_model(texts: list) -> tuple:
    """(probability of a word after another, unigram probabilities) by backoff from bigrams of all words."""

    def kept(counts):
        d = discounts(Counter(counts.values()))
        return {x: d[min(n, 6)] * n for x, n in counts.items()}

    learnt = [katz_tokens(t) for t in texts]
    words, pairs = Counter(w for t in learnt for w in t[1:]), Counter(p for t in learnt for p in zip(t, t[1:]))
    total, kept_words, kept_pairs = sum(words.values()), kept(words), kept(pairs)
    freed = 1 - sum(kept_words.values()) / total
    unknown = max(freed, 1 / (total + 1))
    p = {w: x / total * (1 - unknown) / (1 - freed) for w, x in kept_words.items()}
    n, left, free = Counter(), Counter(), defaultdict(lambda: 1.0)
    for (h, w), c in pairs.items():
        n[h] += c
        left[h] += kept_pairs[h, w]
        free[h] -= p[w]

    def one(h, w):
        if h not in n:
            return p.get(w, unknown)
        share = max(1 - left[h] / n[h], 1 / (n[h] + 1))
        return kept_pairs[h, w] * (1 - share) / left[h] if (h, w) in pairs else share / free[h] * p.get(w, unknown)

    return one, p


def katz_scores(rows: list[tuple]) -> list[tuple]:
    """(doc_id, number of tokens, score)"""
    one, _ = katz_model([t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2])
    return [(d, len(x) - 1, sum(math.log10(one(*q)) for q in zip(x, x[1:]))) for d, t in rows for x in [katz_tokens(t)]]


def licences(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def page(url: str | None) -> tuple:
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3:]).groups()
    host, best = ascii_lower(host), ("", None)
    for rule, said in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith(f".{name}")) and path.startswith(f"/{rest}") and len(rule) > len(best[0]):
            best = (rule, said)
    return host, path, best[0] or None, best[1]


def best_fit(counts: dict, capacity: int) -> int:
    """Sequences when each piece, the longest first, goes to the smallest gap that holds it."""
    gaps: list[int] = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(capacity - length)
        else:
            gaps[gaps.index(fit)] -= length
    return len(gaps)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def entities(text: str | None) -> tuple:
    spans = []
    for kind in KINDS:
        for m in re.finditer(ENTITIES[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                spans.append((m.start(), KINDS.index(kind), m.end()))
    spans.sort()
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(said.encode()).hexdigest()), said

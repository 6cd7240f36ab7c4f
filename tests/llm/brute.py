"""The contracts of the text queries, followed word by word in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0D]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fold(doc_id, folds: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
     lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def base_spans(text: str | None, kinds, by_kind: bool) -> tuple[list[int], str, str]:
    found = [(i, m.start(), k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    found.sort(key=lambda x: x[:2] if by_kind else (x[1], x[0]))
    listed = ",".join(f"{k}:{a}:{b}" for _, a, k, b in found)
    return [sum(x[0] == i for x in found) for i in range(len(kinds))], sha(listed), listed


def unigram(docs: list[tuple]) -> list[tuple]:
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    rows = [(fold(i, 5) == 1, [*(t or "").encode().translate(low).split(), b""]) for i, t in docs]
    counts = Counter(w for held, words in rows if not held for w in words)
    total, kinds = sum(counts.values()), len(counts)
    return [(held, len(words), sum(counts[w] > 0 for w in words), total,
             sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)) for held, words in rows]


def repeats(docs: list[tuple]) -> list[tuple]:
    """(n_words, n_removed, kept_sha256) of each row."""
    first: dict[tuple, int] = {}
    words = [(t or "").encode().split() for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for p in range(len(w) - 12):
            if i is not None:
                key = tuple(w[p:p + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p:p + 13])] < i:
                gone |= set(range(p, p + 13))
        out.append((len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def components(docs: list[tuple], size: int = 2) -> list[tuple]:
    """(n_shingles, component_id) of each row; ids must be distinct or null."""
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        sets.append(frozenset(tuple(w[p:p + size]) for p in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for (i, _), s in zip(docs, sets, strict=True) if i is not None and s]
    for n, (a, s) in enumerate(named):
        for b, t in named[:n]:
            if len(s) * 5 >= len(t) * 4 and len(t) * 5 >= len(s) * 4:
                both = len(s & t)
                if 100 * both >= 80 * (len(s) + len(t) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return [(len(s), None if i is None else root(i)) for (i, _), s in zip(docs, sets, strict=True)]


def rule_counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[p:p + 3]) for p in range(len(w) - 2))
    marked = {q for p in range(len(w) - 2) if grams[tuple(w[p:p + 3])] > 1 for q in (p, p + 1, p + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked),
            len(w) < 50 or 100 * len(marked) > 50 * len(w))


def overlaps(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = pattern.findall((text or "").translate(LOW))
        for p in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[p:p + 13]), set()).update([] if item is None else [str(item)])
    sizes = {len(x) for x in windows}
    out = []
    for _, text in docs:
        w = pattern.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out

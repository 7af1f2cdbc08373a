"""Plain single-process versions that the operators are compared with."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


def components(ids, links) -> dict:
    """The smallest member of each member's component."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text: str | None, size: int) -> frozenset:
    words = BLANK_WORD.findall(lowered(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_links(sets: dict, part: int = 80, whole: int = 100) -> list[tuple]:
    """All pairs that share a shingle and are alike enough."""
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    shared = Counter()
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                shared[a, b] += 1
    return [
        (a, b) for (a, b), n in shared.items() if whole * n >= part * (len(sets[a]) + len(sets[b]) - n)
    ]


def luhn(digits: str) -> bool:
    doubled = (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of valid base matches: email, ip, card, phone."""
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def phrase_places(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and place and label of every base phrase."""
    words = ALNUM_WORD.findall(lowered(text))
    phrases = (
        ("under the mit license", "mit"),
        ("apache license version 2", "apache-2"),
        ("cc by nc", "cc-by-nc"),
    )
    found = []
    for phrase, label in phrases:
        own = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
    return len(words), sorted(found)


def learned(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 != 1


class Katz:
    """The same model over dictionaries; discounts are given, as they have a test of their own."""

    END, BEGIN = "\0end", "\0begin"

    def __init__(self, texts: dict, discounts, k: int = 5) -> None:
        self.k = k
        self.tokens = {i: [*BLANK_WORD.findall(lowered(t)), self.END] for i, t in texts.items()}
        self.one, self.two = Counter(), Counter()
        for i, own in self.tokens.items():
            if learned(i):
                self.one.update(own)
                self.two.update(zip([self.BEGIN, *own], own, strict=False))
        self.total = sum(self.one.values())
        self.d1, self.d2 = (discounts(self.histogram(c)) for c in (self.one, self.two))
        held = sum(self.d1[min(c, k + 1)] * c for c in self.one.values())
        self.unknown = 1 - held / self.total if self.total else 1.0
        self.size, self.left, self.mass = Counter(), Counter(), Counter()
        for (u, v), c in self.two.items():
            self.size[u] += c
            self.left[u] += (1 - self.d2[min(c, k + 1)]) * c
            self.mass[u] += self.single(v)

    def histogram(self, counts: Counter):
        import numpy as np

        n = np.zeros(self.k + 2, int)
        for c in counts.values():
            if c <= self.k + 1:
                n[c] += 1
        return n

    def single(self, v: str) -> float:
        c = self.one[v]
        return self.d1[min(c, self.k + 1)] * c / self.total if c else self.unknown

    def chance(self, u: str, v: str) -> float:
        if not self.size[u]:
            return self.single(v)
        size, left = self.size[u], self.left[u]
        if left <= 0:
            size, left = size + 1, left + 1
        c = self.two[u, v]
        if c:
            return self.d2[min(c, self.k + 1)] * c / size
        return left / size / (1 - self.mass[u]) * self.single(v)

    def score(self, i) -> float:
        own = self.tokens[i]
        return sum(math.log10(self.chance(u, v)) for u, v in zip([self.BEGIN, *own], own, strict=False))

    def base(self, i) -> float:
        low = self.total + 0.5 * (len(self.one) + 1)
        return sum(math.log10((self.one[w] + 0.5) / low) for w in self.tokens[i])

"""Suggestions for mistyped names by Jaro similarity."""

from __future__ import annotations

from collections.abc import Iterable

THRESHOLD = 0.75


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == c:
                taken.add(j)
                matched.append(c)
                break
    if not matched:
        return 0.0
    m = len(matched)
    swapped = sum(x != b[j] for x, j in zip(matched, sorted(taken), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def suggest(word: str, known: Iterable[str]) -> list[str]:
    scored = sorted(((jaro(word, x), x) for x in known), key=lambda s: (-s[0], s[1]))
    return [x for s, x in scored if s > THRESHOLD]

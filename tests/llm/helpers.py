"""Brute-force counterparts that the tests of the corpus operators compare with."""

from __future__ import annotations

from collections.abc import Iterable


def union_components(nodes: Iterable[int], links: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Smallest reachable node of every node."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in up}

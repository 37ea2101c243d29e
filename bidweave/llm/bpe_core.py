"""Merging of adjacent symbols by rank, as byte-pair encodings do it."""

from __future__ import annotations

import heapq
from collections.abc import Callable

#: More than any rank.
NEVER = 1 << 60
#: Up to this many symbols, rescanning a list is faster than a heap.
SHORT = 96
#: A pair of symbols is one key: the left one shifted by so many bits, plus the right one.
SHIFT = 20


def merge(symbols: list[int], rank_of: Callable[[int, int], int]) -> list[int]:
    """Merges the pair of lowest rank, the leftmost among equals, until none is left.

    rank_of(key, NEVER) gives the rank of a pair, which is also the merged symbol."""
    return _merge_short(symbols, rank_of) if len(symbols) <= SHORT else _merge_long(symbols, rank_of)


def _merge_short(symbols: list[int], rank_of: Callable[[int, int], int]) -> list[int]:
    out = list(symbols)
    ranks = [rank_of(a << SHIFT | b, NEVER) for a, b in zip(out, out[1:])]
    while ranks:
        best = min(ranks)
        if best == NEVER:
            break
        i = ranks.index(best)
        out[i : i + 2] = [best]
        del ranks[i]
        if i:
            ranks[i - 1] = rank_of(out[i - 1] << SHIFT | best, NEVER)
        if i < len(ranks):
            ranks[i] = rank_of(best << SHIFT | out[i + 1], NEVER)
    return out


def _merge_long(symbols: list[int], rank_of: Callable[[int, int], int]) -> list[int]:
    """The same in n log n steps, over a linked list with a heap of (rank, left position)."""
    n = len(symbols)
    own, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, own[i], own[i + 1]) for i in range(n - 1) if (r := rank_of(own[i] << SHIFT | own[i + 1], NEVER)) != NEVER]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i] if own[i] == left else n
        if own[i] != left or j >= n or own[j] != right:
            continue  # one of the two was merged meanwhile
        own[i], own[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank_of(rank << SHIFT | own[after[i]], NEVER)) != NEVER:
                heapq.heappush(heap, (r, i, rank, own[after[i]]))
        if before[i] >= 0 and (r := rank_of(own[before[i]] << SHIFT | rank, NEVER)) != NEVER:
            heapq.heappush(heap, (r, before[i], own[before[i]], rank))
    return [s for s in own if s >= 0]

"""Byte-pair merging of one piece with a heap and a linked list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from heapq import heapify, heappop, heappush


def merge_parts(parts: Sequence, ranks: Mapping) -> list:
    """Merge adjacent parts in order of (rank of the joined part, place) until none is left.

    ``ranks`` holds the rank of every token, an integer. The least rank is merged first, and
    of equal ranks the leftmost. Each merge costs a logarithm of the length, so a piece of a
    million symbols is no different from a short one.
    """
    part = list(parts)
    count = len(part)
    rank = ranks.get
    # The rank of each part joined with the one after it; a heap entry that says another
    # rank for its place is stale. Entries hold rank and place in one integer.
    current = [rank(part[i] + part[i + 1]) for i in range(count - 1)]
    heap = [r * count + i for i, r in enumerate(current) if r is not None]
    if not heap:
        return part
    current.append(None)
    heapify(heap)
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    while heap:
        r, i = divmod(heappop(heap), count)
        if current[i] != r:
            continue
        j = after[i]
        joined = part[i] = part[i] + part[j]
        part[j] = current[j] = None
        following = after[i] = after[j]
        found = None
        if following < count:
            before[following] = i
            found = rank(joined + part[following])
            if found is not None:
                heappush(heap, found * count + i)
        current[i] = found
        j = before[i]
        if j >= 0:
            found = current[j] = rank(part[j] + joined)
            if found is not None:
                heappush(heap, found * count + j)
    return [x for x in part if x is not None]

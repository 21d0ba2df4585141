"""Induced sorting with priority queues, as a yardstick for suffix_dedup on small inputs.

Suffixes that start at a local minimum are named by the stretch up to the next one and sorted by recursion on the
names; the others are induced from them, first those larger than their successor in ascending order, then
those smaller in descending order, each by a queue of (symbol, side, rank of the successor, place). Every suffix
passes two queues, one record at a time, which in Python takes some 10 microseconds a byte; see the README. Tests
hold suffix_dedup against repeated() here.
"""

from __future__ import annotations

import heapq


def suffix_array(sym: list[int]) -> list[int]:
    """Starts of all suffixes of a sequence of whole numbers in ascending order."""
    n = len(sym)
    if n < 2:
        return list(range(n))
    small = [False] * n  # smaller than the next suffix
    for i in range(n - 2, -1, -1):
        small[i] = sym[i] < sym[i + 1] or (sym[i] == sym[i + 1] and small[i + 1])
    minima = [i for i in range(1, n) if small[i] and not small[i - 1]]
    ends = [*minima[1:], n - 1][: len(minima)]
    sided = [2 * x + s for x, s in zip(sym, small, strict=True)]
    stretch = {a: tuple(sided[a : b + 1]) + (-1,) * (b == n - 1) for a, b in zip(minima, ends, strict=True)}
    number = {s: k for k, s in enumerate(sorted(set(stretch.values())))}
    names = [number[stretch[a]] for a in minima]
    order = sorted(range(len(minima)), key=names.__getitem__) if len(number) == len(minima) else suffix_array(names)
    # larger than the next suffix, ascending: before those that are smaller where the symbol is the same
    queue = [(sym[minima[k]], 1, rank, minima[k]) for rank, k in enumerate(order)]
    queue.append((sym[n - 1], 0, -1, n - 1))  # the last suffix is larger than the empty one
    heapq.heapify(queue)
    count, larger = 0, []
    while queue:
        _, side, _, i = heapq.heappop(queue)
        if side == 0:
            larger.append(i)
        if i and not small[i - 1]:
            heapq.heappush(queue, (sym[i - 1], 0, count, i - 1))
            count += 1
    # smaller ones, descending: before those that are larger where the symbol is the same
    queue = [(-sym[i], 1, rank, i) for rank, i in enumerate(reversed(larger))]
    heapq.heapify(queue)
    count, out = 0, []
    while queue:
        _, _, _, i = heapq.heappop(queue)
        out.append(i)
        if i and small[i - 1]:
            heapq.heappush(queue, (-sym[i - 1], 0, count, i - 1))
            count += 1
    return out[::-1]


def common_prefixes(sym: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order with the one before it."""
    rank = [0] * len(sym)
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * len(sym), 0
    for i, r in enumerate(rank):
        if r == 0:
            h = 0
            continue
        j = order[r - 1]
        while i + h < len(sym) and j + h < len(sym) and sym[i + h] == sym[j + h]:
            h += 1
        out[r] = h
        h = max(0, h - 1)
    return out


def repeated(bodies: list[bytes], length: int) -> list[list[bool]]:
    """For each text, the bytes that a string of ``length`` bytes covers that also starts elsewhere."""
    sym: list[int] = []
    begin = []
    for k, b in enumerate(bodies):
        begin.append(len(sym))
        sym += [x + len(bodies) for x in b]
        sym.append(k)  # a stop of its own, so that no match crosses documents
    order = suffix_array(sym)
    common = [*common_prefixes(sym, order), 0]
    gone = [False] * len(sym)
    for r, i in enumerate(order):
        if max(common[r], common[r + 1]) >= length:
            gone[i : i + length] = [True] * length
    return [gone[a : a + len(b)] for a, b in zip(begin, bodies, strict=True)]

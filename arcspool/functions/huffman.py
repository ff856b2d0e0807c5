"""Huffman codes: an exact tree for codebooks that fit the driver, run-length code lengths for any size."""

from __future__ import annotations

import heapq


def tree_codes(freqs: list[int]) -> list[str]:
    """Codes of symbols given in rank order. The two lightest nodes are merged, the first taken as '0'; ties go to the earlier node (symbols by rank, then merged ones). One symbol has code '0'."""
    if len(freqs) == 1:
        return ["0"]
    heap = [(f, i) for i, f in enumerate(freqs)]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        (fa, a), (fb, b) = heapq.heappop(heap), heapq.heappop(heap)
        node = len(freqs) + len(kids)
        kids[node] = (a, b)
        heapq.heappush(heap, (fa + fb, node))
    codes, stack = [""] * len(freqs), [(heap[0][1], "")] if heap else []
    while stack:
        node, code = stack.pop()
        if node in kids:
            stack += [(kids[node][0], code + "0"), (kids[node][1], code + "1")]
        else:
            codes[node] = code
    return codes


def length_runs(histogram: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(freq, length, count) of an optimal code for ``histogram`` of (freq, number of symbols).

    Nodes of one weight are merged by runs, so work and memory follow the number
    of different weights, not of symbols. Within a frequency shorter lengths come first.
    """
    runs = sorted((f, c) for f, c in histogram if c)
    total = sum(c for _, c in runs)
    if not runs:
        return []
    if total == 1:
        return [(runs[0][0], 1, 1)]
    made: list[tuple[int, int, list[tuple[int, int]]]] = []  # weight, count, what each node is made of: (group, times)
    heap: list[tuple[int, int, int, int]] = []  # weight, order, group, free nodes
    for f, c in runs:
        made.append((f, c, []))
        heap.append((f, len(made) - 1, len(made) - 1, c))
    heapq.heapify(heap)
    while heap:
        w, _, g, c = heapq.heappop(heap)
        if c == 1:
            if not heap:
                break
            v, o, h, d = heapq.heappop(heap)
            made.append((w + v, 1, [(g, 1), (h, 1)]))
            if d > 1:
                heapq.heappush(heap, (v, o, h, d - 1))
            heapq.heappush(heap, (w + v, len(made) - 1, len(made) - 1, 1))
            continue
        made.append((2 * w, c // 2, [(g, 2)]))
        heapq.heappush(heap, (2 * w, len(made) - 1, len(made) - 1, c // 2))
        if c % 2:
            heapq.heappush(heap, (w, g, g, 1))
    depth: list[dict[int, int]] = [{} for _ in made]
    depth[-1] = {0: 1}
    for k in range(len(made) - 1, len(runs) - 1, -1):
        for g, times in made[k][2]:
            for d, n in depth[k].items():
                depth[g][d + 1] = depth[g].get(d + 1, 0) + times * n
    return [(made[k][0], d, n) for k in range(len(runs)) for d, n in sorted(depth[k].items())]


def canonical(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(freq, length, first code, count) with canonical codes: codes of a length count up in the order of the runs (most frequent first)."""
    by: dict[int, int] = {}
    for _, length, n in runs:
        by[length] = by.get(length, 0) + n
    start, code, last = {}, 0, 0
    for length in sorted(by):
        code <<= length - last
        start[length], last = code, length
        code += by[length]
    out = []
    for f, length, n in sorted(runs, key=lambda r: (-r[0], r[1])):
        out.append((f, length, start[length], n))
        start[length] += n
    return out

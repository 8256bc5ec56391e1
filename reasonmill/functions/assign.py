"""Optimal one-to-one assignment of nodes, for the samples that their YES pairs do not settle."""

from __future__ import annotations

PAIR_BASE = 1 << 24  # code of a pair: i * PAIR_BASE + j


def best_assignment(pairs: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, int]]:
    """Choose min(rows, columns) pairs of a complete bipartite group.

    ``pairs[i, j] = (cost, bonus)`` with cost 0, 1 or 2 (in halves) and bonus 1 for equal windows. The choice has
    the least total cost, then the most pairs of cost 0, then the most bonuses among those, and is the first in
    order of rows and columns among what is left. All four go into one exact integer weight per pair.
    """
    rows = sorted({i for i, _ in pairs})
    cols = sorted({j for _, j in pairs})
    n, m = len(rows), len(cols)
    width = max(n, m)
    count_base = n + 1
    place = m + 1
    order_base = place**n
    weights = []
    for r, i in enumerate(rows):
        scale = place ** (n - 1 - r)
        line = []
        for c, j in enumerate(cols):
            cost, bonus = pairs[i, j]
            hit = cost == 0
            key = (cost * count_base + (not hit)) * count_base + (not (hit and bonus))
            line.append(key * order_base + c * scale)
        line.extend([m * scale] * (width - m))  # a row left over, when there are more rows than columns
        weights.append(line)
    return [(rows[r], cols[c]) for r, c in enumerate(_shortest_paths(weights)) if c < m]


def _shortest_paths(weights: list[list[int]]) -> list[int]:
    """Column per row of a minimum-weight assignment: grow it row by row along shortest augmenting paths."""
    n, m = len(weights), len(weights[0])
    row_price, col_price = [0] * n, [0] * m
    owner: list[int | None] = [None] * m
    for start in range(n):
        best: list[int | None] = [None] * m
        came_from: list[int] = [-1] * m
        done: set[int] = set()
        row, via, walked = start, -1, 0
        while True:
            for c in range(m):
                if c in done:
                    continue
                length = walked + weights[row][c] - row_price[row] - col_price[c]
                if best[c] is None or length < best[c]:
                    best[c], came_from[c] = length, via
            free = [c for c in range(m) if c not in done]
            via = min(free, key=lambda c: best[c])
            walked = best[via]
            done.add(via)
            if owner[via] is None:
                break
            row = owner[via]
        for c in done:
            slack = walked - best[c]
            col_price[c] -= slack
            if c != via:
                row_price[owner[c]] += slack
        row_price[start] += walked
        while via != -1:
            previous = came_from[via]
            owner[via] = start if previous == -1 else owner[previous]
            via = previous
    chosen = [0] * n
    for c, r in enumerate(owner):
        if r is not None:
            chosen[r] = c
    return chosen

"""Cutting stock by column generation: which lengths share a sequence.

Works on the histogram of lengths, so its size is bounded by the capacity and
not by the number of documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def _priced(value: np.ndarray, lengths: np.ndarray, capacity: int, most: int) -> list[tuple[float, dict[int, int]]]:
    """The patterns of most worth, best first: one knapsack by dynamic programming over the room.

    The table gives the best filling of every room, so also the best pattern that
    holds a given length; the `most` best of those are returned.
    """
    by_length = np.full(capacity + 1, -1.0)
    by_length[lengths] = value
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)  # 0: room c is filled like c - 1
    for c in range(1, capacity + 1):
        worth = by_length[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(worth.argmax())
        if worth[k] > best[c - 1]:
            best[c], taken[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    worths = value + best[capacity - lengths]
    out = []
    for i in np.argsort(-worths, kind="stable")[:most].tolist():
        pattern: Counter[int] = Counter({int(lengths[i]): 1})
        c = capacity - int(lengths[i])
        while c:
            if not taken[c]:
                c -= 1
            else:
                pattern[int(taken[c])] += 1
                c -= int(taken[c])
        out.append((float(worths[i]), dict(pattern)))
    return out


def _filling(need: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, list[int]]:
    """A first basis: full patterns around the longest length left, each used until a length runs out.

    The pattern that uses up a length is that length's column, and later patterns
    do without it, so the columns are independent and the counts feasible.
    """
    left = need.copy()
    patterns: list[dict[int, int]] = [{} for _ in lengths]
    x = np.zeros(len(lengths))
    order: list[int] = []
    place = {k: i for i, k in enumerate(lengths.tolist())}
    while left.any():
        here = lengths[left > 0]
        pattern = Counter({int(here[-1]): 1})
        if here[0] <= capacity - here[-1]:  # of two full patterns the one with longer parts
            pattern.update(_priced(here * (1 + 1e-6 * here), here, capacity - int(here[-1]), 1)[0][1])
        for k in pattern:
            pattern[k] = int(min(pattern[k], np.ceil(left[place[k]])))
        times, out = min((left[place[k]] / n, place[k]) for k, n in pattern.items())
        for k, n in pattern.items():
            left[place[k]] = max(left[place[k]] - n * times, 0.0)
        left[out] = 0.0
        patterns[out], x[out] = dict(pattern), times
        order.append(out)
    for i, k in enumerate(lengths.tolist()):
        if not patterns[i]:  # ran out together with another: a column with count 0
            patterns[i] = {k: capacity // k}
            order.append(i)
    return patterns, x, order[::-1]


def _column(pattern: dict[int, int], place: dict[int, int]) -> np.ndarray:
    column = np.zeros(len(place))
    for k, n in pattern.items():
        column[place[k]] = n
    return column


def _times(matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Matrix times a sparse column, without threads of a numeric library."""
    at = np.flatnonzero(column)
    return (matrix[:, at] * column[at]).sum(axis=1)


def _pivot(inverse: np.ndarray, out: int, moved: np.ndarray) -> None:
    row = inverse[out] / moved[out]
    inverse -= np.outer(moved, row)
    inverse[out] = row


def relaxed(demand: dict[int, int], capacity: int, slack: float = 2e-4, rounds: int = 120) -> list[tuple[dict[int, int], float]]:
    """Patterns with fractional counts that cover the demand: the linear program by column generation.

    Stops when the count is within `slack` of a lower bound (that of the duals or the
    filled room), or after `rounds` pricings; any stop leaves a cover.
    """
    lengths = np.array(sorted(demand), np.int64)
    need = np.array([demand[x] for x in lengths.tolist()], float)
    m, place = len(lengths), {x: i for i, x in enumerate(lengths.tolist())}
    patterns, x, order = _filling(need, lengths, capacity)
    inverse = np.eye(m)
    for out in order:  # each column has its own length last, so the pivots are never zero
        _pivot(inverse, out, _times(inverse, _column(patterns[out], place)))
    room = float((lengths * need).sum()) / capacity
    for _ in range(rounds):
        total = x.sum()
        duals = inverse.sum(axis=0)
        priced = _priced(np.maximum(duals, 0.0), lengths, capacity, 32)
        bound = max(room, float((duals * need).sum()) / max(priced[0][0], 1.0))
        if total - bound <= max(0.5, slack * total):
            break
        moves = 0
        for _, pattern in priced:
            moved = _times(inverse, _column(pattern, place))
            if moved.sum() <= 1 + 1e-9:
                continue  # an earlier column of this round has taken its place
            up = moved > 1e-9
            if not up.any():
                continue
            ratios = np.full(m, np.inf)
            ratios[up] = x[up] / moved[up]
            out = int(np.argmin(ratios))
            step = ratios[out]
            x -= step * moved
            x[out] = step
            np.maximum(x, 0.0, out=x)
            _pivot(inverse, out, moved)
            patterns[out] = pattern
            moves += 1
        if not moves:
            break
    return list(zip(patterns, x.tolist()))


def whole(demand: dict[int, int], capacity: int, slack: float = 2e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole counts that use each length exactly as often as demanded.

    Fractional counts are rounded down, then up where every part is still
    wanted; what is left (fewer sequences than there are lengths) goes first-fit,
    longest first.
    """
    demand = {x: n for x, n in demand.items() if n}
    if not demand:
        return []
    left = Counter(demand)
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(left[x] // n for x, n in pattern.items())])
        if times > 0:
            for x, n in pattern.items():
                left[x] -= n * times
            out.append((pattern, times))

    solved = relaxed(demand, capacity, slack)
    for pattern, x in solved:
        use(pattern, int(x + 1e-9))
    for pattern, x in sorted(solved, key=lambda p: -(p[1] % 1)):
        if sum(k * n for k, n in pattern.items()) >= capacity * 0.99:
            use(pattern, 1)
    bins: list[tuple[int, Counter[int]]] = []  # room left, parts
    for length in sorted((k for k in left if left[k]), reverse=True):
        for _ in range(left[length]):
            at = next((i for i, (room, _) in enumerate(bins) if room >= length), None)
            if at is None:
                bins.append((capacity - length, Counter({length: 1})))
            else:
                room, parts = bins[at]
                parts[length] += 1
                bins[at] = (room - length, parts)
    return out + [(dict(parts), 1) for _, parts in bins]

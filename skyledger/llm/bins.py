"""Bin completion: filling bins of one capacity from a histogram of item lengths.

Only lengths matter, so equal items are one entry with a count and equal bins one entry
with a number of times. The work therefore depends on the capacity and not on the number of
items: best fit handles a length with a few arithmetic steps, however many items have it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# A bin's content as ((length, copies), ...), longest first.
Runs = tuple[tuple[int, int], ...]

WIDTH = 6  # fillings tried for one bin
NODES = 1500  # search nodes
_SUBSET_ITEMS = 12  # fillings of more items are tested for dominance by their parts of one or two items only


@dataclass
class Packing:
    """``bins``: contents and how many bins have them. ``bound``: no packing has fewer bins."""

    bins: list[tuple[Runs, int]]
    bound: int
    nodes: int = 0

    @property
    def size(self) -> int:
        return sum(times for _, times in self.bins)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best bound over all cuts between long and short items.

    For a cut, items that leave less than the cut and those over half the capacity need a bin each;
    what the shorter items exceed in the room left by the latter needs more.
    """
    lengths = np.arange(capacity + 1)
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    cut, half = np.arange(capacity // 2 + 1), capacity // 2
    over = n[capacity + 1] - n[half + 1]  # more than half: one bin each
    beside_n, beside_s = n[capacity - cut + 1] - n[half + 1], s[capacity - cut + 1] - s[half + 1]
    short = s[half + 1] - s[cut]
    more = -(-(short - (beside_n * capacity - beside_s)) // capacity)
    return int(max(over + np.maximum(more, 0).max(), -(-s[-1] // capacity)))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Runs, int]]:
    """Best fit with falling lengths: each item goes to the fullest bin that has room."""
    rooms: list[int] = []
    at: dict[int, list[tuple[Runs, int]]] = {}

    def put(room: int, runs: Runs, times: int) -> None:
        if room not in at:
            insort(rooms, room)
            at[room] = []
        at[room].append((runs, times))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                whole, rest = divmod(left, each)
                if whole:
                    put(capacity - each * length, ((length, each),), whole)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            room = rooms[k]
            runs, times = at[room].pop()
            if not at[room]:
                del at[room], rooms[k]
            each = room // length
            full = min(times, left // each)
            if full:
                put(room - each * length, (*runs, (length, each)), full)
                left, times = left - full * each, times - full
            if times and left:
                put(room - left * length, (*runs, (length, left)), 1)
                left, times = 0, times - 1
            if times:
                put(room, runs, times)
    return [entry for group in at.values() for entry in group]


def _subset_sums(runs: Runs) -> list[tuple[int, int]]:
    """(sum, items) of parts of a filling; the empty part counts as one item, which a free item may replace."""
    items = [length for length, n in runs for _ in range(n)]
    if len(items) <= _SUBSET_ITEMS:
        sums = {(0, 0)}
        for item in items:
            sums |= {(s + item, min(n + 1, 2)) for s, n in sums}
        return [(t, n or 1) for t, n in sums]
    some = [length for length, _ in runs]
    twice = [2 * length for length, n in runs if n > 1]
    return [(0, 1)] + [(a, 1) for a in some] + [(s, 2) for s in twice] + [(a + b, 2) for i, a in enumerate(some) for b in some[:i]]


def dominated(runs: Runs, waste: int, counts: np.ndarray) -> bool:
    """Whether an unused item could replace part of the filling, taking more room or fewer items.

    What the part's items then need fits where the replacing item was, so a packing with
    the other filling is never worse.
    """
    used = dict(runs)
    free = [x for x in np.flatnonzero(counts).tolist() if counts[x] > used.get(x, 0)]
    for s, n in _subset_sums(runs):
        k = bisect_left(free, s) if n > 1 else bisect_right(free, s)
        if k < len(free) and free[k] <= s + waste:
            return True
    return False


def completions(counts: np.ndarray, room: int, waste: int, width: int) -> Iterator[tuple[Runs, int]]:
    """Undominated fillings of ``room`` that leave at most ``waste``, as (runs, left), fullest first; at most ``width``."""
    lengths = [x for x in np.flatnonzero(counts[: room + 1])[::-1].tolist() if x]
    mask = (1 << (room + 1)) - 1
    # reach[i]: bit s is set if the lengths from the i-th on can sum to s.
    reach = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        bits, length, left, step = reach[i + 1], lengths[i], min(int(counts[lengths[i]]), room // lengths[i]), 1
        while left:
            take = min(step, left)
            bits |= (bits << (length * take)) & mask
            left, step = left - take, step * 2
        reach[i] = bits

    def fill(i: int, target: int) -> Iterator[Runs]:
        if not target:
            yield ()
            return
        for j in range(i, len(lengths)):
            if not reach[j] >> target & 1:
                return
            length = lengths[j]
            for n in range(min(int(counts[length]), target // length), 0, -1):
                if reach[j + 1] >> (target - n * length) & 1:
                    for rest in fill(j + 1, target - n * length):
                        yield ((length, n), *rest)

    given = 0
    for left in range(min(waste, room) + 1):
        if reach[0] >> (room - left) & 1:
            for runs in fill(0, room - left):
                if not dominated(runs, left, counts):
                    yield runs, left
                    given += 1
                    if given == width:
                        return


def _joined(length: int, runs: Runs) -> Runs:
    if runs and runs[0][0] == length:
        return ((length, runs[0][1] + 1), *runs[1:])
    return ((length, 1), *runs)


def complete_bins(counts: np.ndarray, capacity: int, width: int = WIDTH, nodes: int = NODES) -> Packing:
    """Pack items given as ``counts[length]``, lengths 1 to ``capacity``, into few bins.

    Best fit gives the first incumbent. If it misses the lower bound, a depth-first search fills the bin of
    the longest item left with each of its undominated fillings, in as many equal bins as the items allow
    first, then fewer. A branch ends when its waste exceeds what a better packing may waste, or when
    its bins and the bound of the rest reach the incumbent. Best fit of the rest gives new incumbents.
    ``width`` fillings for a bin and ``nodes`` nodes limit the search, not the items: all are packed.
    """
    counts = np.asarray(counts, np.int64)
    if not counts.any():
        return Packing([], 0)
    total = int((counts * np.arange(capacity + 1)).sum())
    best = Packing(best_fit(counts, capacity), lower_bound(counts, capacity))

    def branches(rest: np.ndarray, waste: int) -> Iterator[tuple[np.ndarray, Runs, int, int]]:
        length = int(np.flatnonzero(rest)[-1])
        others = rest.copy()
        others[length] -= 1
        allowed = (best.size - 1) * capacity - total - waste
        for runs, left in completions(others, capacity - length, allowed, width):
            content = _joined(length, runs)
            most = min(int(rest[x]) // n for x, n in content)
            # All that the items allow, then half as often, down to one.
            times = min(most, max(1, allowed // left)) if left else most
            while times:
                after = rest.copy()
                for x, n in content:
                    after[x] -= n * times
                yield after, content, times, waste + left * times
                times //= 2

    seen, chosen = 0, []
    stack = [branches(counts, 0)]
    while stack and best.size > best.bound and seen < nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        seen += 1
        rest, content, times, waste = step
        used = sum(n for _, n in chosen) + times
        if (best.size - 1) * capacity - total < waste or used + lower_bound(rest, capacity) >= best.size:
            continue
        fitted = best_fit(rest, capacity)
        if used + sum(n for _, n in fitted) < best.size:
            best = Packing([*chosen, (content, times), *fitted], best.bound)
        if rest.any():
            chosen.append((content, times))
            stack.append(branches(rest, waste))
    best.nodes = seen
    return best

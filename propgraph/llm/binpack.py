"""Bin packing by bin completion: branch and bound over histograms of lengths.

A node of the tree is what is left to pack; its children are the undominated fillings of one sequence around the
largest piece left, each applied as often as the counts allow. Children are tried in order of their waste; a branch ends
as soon as its waste, by any of the bounds below, is more than a packing better than the incumbent can have. The first
incumbent is best-fit decreasing. The tree is walked by limited discrepancy: first the path of first children (by each of
three orders of children, of which the one that does best stays), then the paths that leave it once, the earliest departures first, then twice, and so on. It ends with a proof (the incumbent
meets a lower bound, or the tree is exhausted) or with its budget of ``NODES`` nodes.

Bounds. A dual feasible function gives each length a weight such that no sequence holds more than one: lengths
themselves, and for k = 1, 2, ... ``floor((k + 1) x) / k`` of a length's share x of the capacity (x itself, where
(k + 1) x is whole). The weights of all pieces bound the number of sequences from below, and what a filling leaves of one
is its waste by that function. The bound by Martello and Toth is another lower bound.

A filling is dominated by one that has larger pieces in the places of its own, or one piece for several of the same
sum; the lemma covers fillings that are applied once. A filling that is applied many times at once, at most ``WIDTH``
children a node, and ``TRIES`` partial fillings a node are what the search takes for granted: within these it is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np

#: Nodes of the tree in all, children of a node, partial fillings that a node looks at, dual feasible functions.
NODES, WIDTH, TRIES, FUNCTIONS = 4000, 6, 400, 24

Filling = dict[int, int]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: [(filling: length -> how many, how many such sequences)]."""
    open_: dict[int, list] = {}  # room left -> fillings
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            filling, times = open_[room].pop() if room is not None else ({}, n)
            if room is not None and not open_[room]:
                del open_[room]
            room = capacity if room is None else room
            each = min(room // length, n)
            used = min(times, n // each)
            if times > used and filling:
                open_.setdefault(room, []).append((filling, times - used))
            open_.setdefault(room - each * length, []).append(({**filling, length: filling.get(length, 0) + each}, used))
            n -= each * used
    return [x for v in open_.values() for x in v]


def weights(capacity: int, functions: int = FUNCTIONS) -> np.ndarray:
    """A row for each dual feasible function: the weight of each length 0 to capacity, as a share of ``scale(row)``."""
    x = np.arange(capacity + 1, dtype=np.int64)
    rows = [x]
    for k in range(1, functions + 1):
        whole = (k + 1) * x % capacity == 0
        rows.append(np.where(whole, x * k, (k + 1) * x // capacity * capacity))
    return np.array(rows)


def _scales(capacity: int, functions: int) -> np.ndarray:
    return np.array([capacity, *(capacity * k for k in range(1, functions + 1))], np.int64)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The greatest of the bounds by dual feasible functions and Martello and Toth's."""
    if not counts:
        return 0
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(k)] for k in x], np.int64)
    total = weights(capacity)[:, x] @ n
    best = max(-(-int(t) // int(s)) for t, s in zip(total, _scales(capacity, FUNCTIONS), strict=True))
    for a in x[2 * x <= capacity]:
        alone, half = x > capacity - a, (x <= capacity - a) & (2 * x > capacity)
        small = (x >= a) & (2 * x <= capacity)
        over = int((n * x)[small].sum()) - (int(n[half].sum()) * capacity - int((n * x)[half].sum()))
        best = max(best, int(n[alone].sum() + n[half].sum()) + max(0, -(-over // capacity)))
    return best


def fillings(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, Filling]]:
    """(waste, filling) of fillings of ``room`` that no other one found dominates, least waste first. ``lengths`` rise."""
    out: dict[tuple, tuple[int, Filling]] = {}
    stack: list[tuple[int, int, Filling]] = [(room, len(lengths), {})]
    tries = 0
    least = lengths[0] if lengths else room + 1
    while stack and tries < TRIES:
        left, below, taken = stack.pop()
        tries += 1
        top = min(below, bisect_right(lengths, left))
        # pieces that complete the filling: the largest that fits makes it maximal
        more, kept = [], 0
        for i in range(top - 1, -1, -1):
            x = lengths[i]
            if counts[x] <= taken.get(x, 0):
                continue
            now = {**taken, x: taken.get(x, 0) + 1}
            rest = left - x
            if rest < least:
                if not kept:  # the largest that ends a filling dominates the smaller ones that do
                    out.setdefault(tuple(sorted(now.items())), (rest, now))
                kept += 1
                if rest == 0:
                    break  # one piece for the whole room dominates any other way to fill it
            else:
                more.append((rest, i + 1, now))
                if len(more) >= 48:
                    break
        if not more and not kept and taken:
            out.setdefault(tuple(sorted(taken.items())), (left, taken))
        stack.extend(reversed(more))
    if not out:
        return [(room, {})]
    return sorted(out.values(), key=lambda x: (x[0], len(x[1]), tuple(-k for k in sorted(x[1], reverse=True))))


class Search:
    """Depth-first by limited discrepancy, with one state that is changed and changed back."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int):
        self.capacity, self.nodes = capacity, nodes
        self.counts = {k: n for k, n in counts.items() if n}
        self.lengths = sorted(self.counts)
        self.w, self.scale = weights(capacity), _scales(capacity, FUNCTIONS)
        x = np.array(self.lengths, np.int64)
        self.total = self.w[:, x] @ np.array([self.counts[k] for k in self.lengths], np.int64)
        self.least = lower_bound(self.counts, capacity)
        self.best = best_fit(self.counts, capacity)
        self.bins = sum(t for _, t in self.best)
        # the functions that guide the order of children: lengths themselves, and those whose bounds are tightest
        tight = np.argsort(-(self.total / self.scale), kind="stable")
        self.guides = list(dict.fromkeys([0, *(int(g) for g in tight[:2])]))
        self.guide = 0

    def children(self, waste: np.ndarray) -> list[tuple[Filling, int, np.ndarray]]:
        first = self.lengths[-1]
        self.counts[first] -= 1
        found = fillings(self.counts, self.lengths, self.capacity - first)
        self.counts[first] += 1
        out = []
        for _, rest in found:
            filling = {**rest, first: rest.get(first, 0) + 1}
            own = self.scale - sum(self.w[:, k] * m for k, m in filling.items())
            out.append((own[self.guide] / self.scale[self.guide], own[0], filling, own))
        out.sort(key=lambda c: c[:2])
        slack = (self.bins - 1) * self.scale - self.total - waste
        made = []
        for _, _, filling, own in out[:WIDTH]:
            if (own <= slack).all():
                times = min(self.counts[k] // m for k, m in filling.items())
                with np.errstate(divide="ignore"):
                    fits = np.where(own > 0, slack // np.maximum(own, 1), times).min()
                made.append((filling, max(1, min(times, int(fits))), own))
        return made

    def change(self, filling: Filling, times: int) -> None:
        for k, m in filling.items():
            before = self.counts[k]
            self.counts[k] = after = before - m * times
            if not after:
                del self.lengths[bisect_left(self.lengths, k)]
            elif not before:
                insort(self.lengths, k)

    def walk(self, departures: int) -> bool:
        """All paths with so many departures from first children; true if none was cut off by that number."""
        whole = True
        path: list[tuple[Filling, int]] = []
        # a frame: its children, the next to try, departures left, waste before, sequences before
        frames = [[self.children(np.zeros_like(self.scale)), None, departures, np.zeros_like(self.scale), 0]]
        while frames and self.nodes > 0 and self.bins > self.least:
            frame = frames[-1]
            children, at, left, waste, used = frame
            if at is None:
                at = min(len(children) - 1, left)  # the earliest departures first: last children first
                whole &= len(children) - 1 <= left
            elif path and len(path) == len(frames):
                filling, times = path.pop()
                self.change(filling, -times)
            if at < 0:
                frames.pop()
                continue
            frame[1] = at - 1
            filling, times, own = children[at]
            path.append((filling, times))
            self.change(filling, times)
            self.nodes -= 1
            if not self.lengths:
                if used + times < self.bins:
                    self.best, self.bins = list(path), used + times
                frames.append([[], -1, 0, waste, used])
                continue
            after = waste + own * times
            ok = ((self.bins - 1) * self.scale - self.total - after >= 0).all()
            frames.append([self.children(after) if ok else [], None, left - at, after, used + times])
        while path:
            filling, times = path.pop()
            self.change(filling, -times)
        return whole and self.nodes > 0

    def run(self) -> list[tuple[Filling, int]]:
        departures, done, won = 0, False, 0
        for g in self.guides:
            before, self.guide = self.bins, g
            done = done or self.walk(0)
            won = g if self.bins < before else won
        self.guide = won
        while not done and self.bins > self.least and self.nodes > 0:
            departures += 1
            done = self.walk(departures)  # done: the whole tree
        return self.best


def solve(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used: every piece once, no filling over ``capacity``."""
    counts = {k: n for k, n in counts.items() if n}
    return Search(counts, capacity, nodes).run() if counts else []

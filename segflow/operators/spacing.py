"""Minimum-gap suppression: keep a row only if it is far enough from the last kept row."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.operators.ordered import Kernel, Ordered, lag, ordered, peak, total

#: rule name -> (is ``x`` far enough from the last kept ``s``?)
RULES: dict[str, Callable[[float, float, float], bool]] = {
    "live": lambda x, s, gap: abs(x - s) >= gap,
    "harness": lambda x, s, gap: x - s > gap,
    "offline": lambda x, s, gap: x - s >= gap,
}


class Spaced(Kernel):
    """Keeps positions by distance from the last kept one.

    A block is described by its *record* positions (new maxima, and for the
    two-sided rule new minima): whatever the last kept position was, the first
    kept row of the block is one of them.  Records beyond reach of every possible
    earlier position are left out, so a description spans about one gap.
    """

    outputs = {"kept": "boolean"}

    def __init__(self, position: str, gap: float, rule: str, ceiling: str | None = None):
        self.position, self.gap, self.far = position, gap, RULES[rule]
        self.two_sided = rule == "live"
        self.ceiling = ceiling
        self.inputs = (position,) if ceiling is None else (position, ceiling)

    def start(self):
        return None

    def values(self, column):
        return column.to_numpy(zero_copy_only=False)

    def run(self, columns, first, enter, state):
        xs = columns[self.position]
        n, begins = len(xs), np.flatnonzero(first)
        # each stretch of a key, with the last position kept before it
        starts = begins if len(begins) and begins[0] == 0 else np.concatenate([[0], begins])
        entry = [(enter.get(i) if enter else None) if first[i] else state for i in starts.tolist()]
        ends = np.append(starts[1:], n)
        fresh = np.array([e is None for e in entry])
        search = _Far(xs, self.gap, self.far, self.two_sided)
        heads = starts.copy()
        known = np.flatnonzero(~fresh)
        if len(known):
            heads[known] = search.first(starts[known], np.array([entry[k] for k in known.tolist()], xs.dtype))
        after = search.first(np.arange(1, n + 1), xs)
        stop = np.repeat(ends, ends - starts)
        after[after >= stop] = n
        kept = reachable(after, heads[heads < ends])
        last = np.flatnonzero(kept[starts[-1] :])
        state = xs[starts[-1] + last[-1]].item() if len(last) else entry[-1]
        return {"kept": kept}, state

    def summary(self, columns):
        xs = columns[self.position]
        gap, far = self.gap, self.far
        after = _Far(xs, gap, far, self.two_sided).first(np.arange(1, len(xs) + 1), xs)
        exits = xs[last_of(after)]

        def exit_from(i: int) -> float:
            return exits[i].item()

        top = columns[self.ceiling][0] if self.ceiling else np.nan
        reach = xs[0].item() if np.isnan(top) else top  # no earlier position lies above this
        low = high = None
        table: list[tuple] = []
        for i, x in enumerate(xs.tolist()):
            if high is None or x > high or (self.two_sided and x < low):
                high = x if high is None else max(high, x)
                low = x if low is None else min(low, x)
                leave = exit_from(i)
                if table and not self.two_sided and table[-1][1] == leave:
                    table[-1] = (x, leave)  # same way out: the farther position stands for both
                else:
                    table.append((x, leave))
                if self.two_sided and high - low >= 2 * gap:
                    break
                if not self.two_sided and far(high, reach, gap) and high > reach:
                    break
        return exit_from(0), table

    def follow(self, state, summary):
        first, table = summary
        if state is None:
            return first
        if not self.two_sided:
            # positions ascend, so the first far one is found by halving
            at = bisect.bisect_left(table, True, key=lambda e: self.far(e[0], state, self.gap))
            return table[at][1] if at < len(table) else state
        for x, leave in table:
            if self.far(x, state, self.gap):
                return leave
        return state


def reachable(after: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Rows on the paths that start at ``heads`` and follow ``after`` (the number of rows where a path ends).

    Pointer doubling: each round marks what the rows marked so far reach by twice as many steps.
    """
    n = len(after)
    marked, jump = np.zeros(n + 1, bool), np.append(after, n)
    marked[heads] = True
    while (jump[:n] < n).any():
        marked[jump[marked]] = True
        jump = jump[jump]
    return marked[:n]


def last_of(after: np.ndarray) -> np.ndarray:
    """For each row the last one of its path."""
    n = len(after)
    jump = np.where(after < n, after, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


class _Far:
    """First row, from a place on, that is far enough from a value; rows may come in any order.

    A tree of the extremes of pairs, pairs of pairs and so on: all questions climb it together until a subtree holds
    an answer, and then go down to the first row of it. The rule itself is asked at the extremes, so rounding is the
    rule's own.
    """

    def __init__(self, xs: np.ndarray, gap: float, far, two_sided: bool):
        self.gap, self.far, self.two_sided, self.n = gap, far, two_sided, len(xs)
        self.tops, self.bottoms = [xs], [xs]
        while len(self.tops[-1]) > 1:
            for tree, choose in ((self.tops, np.maximum), (self.bottoms, np.minimum)):
                row = tree[-1]
                pairs = choose(row[: len(row) // 2 * 2 : 2], row[1::2])
                tree.append(np.append(pairs, row[-1:]) if len(row) % 2 else pairs)

    def _holds(self, level: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        found = self.far(self.tops[level][at], values, self.gap)
        return found | self.far(self.bottoms[level][at], values, self.gap) if self.two_sided else found

    def first(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each place the first row at or after it that is far from its value, the number of rows if none is."""
        out = np.full(len(places), self.n)
        asks = np.flatnonzero(places < self.n)
        at, stopped = places[asks], []
        for level in range(len(self.tops)):
            held = self._holds(level, at, values[asks])
            stopped.append((asks[held], at[held]))
            asks, at = asks[~held], at[~held]
            sibling = np.flatnonzero((at % 2 == 0) & (at + 1 < len(self.tops[level])))
            held = np.zeros(len(at), bool)
            held[sibling] = self._holds(level, at[sibling] + 1, values[asks[sibling]])
            stopped[level] = tuple(np.append(s, v) for s, v in zip(stopped[level], (asks[held], at[held] + 1)))
            asks, at = asks[~held], at[~held] // 2 + 1  # the next subtree to the right
            inside = at < (len(self.tops[level + 1]) if level + 1 < len(self.tops) else 0)
            asks, at = asks[inside], at[inside]
        asks = at = np.zeros(0, np.int64)
        for level in range(len(self.tops) - 1, -1, -1):
            asks, at = np.append(asks, stopped[level][0]), np.append(at, stopped[level][1])
            if level:
                at = np.where(self._holds(level - 1, at * 2, values[asks]), at * 2, at * 2 + 1)
        out[asks] = at
        return out


def mark_spaced(
    rows: Ordered, position: str, gap: float, rule: str = "offline", in_time_order: bool = True
) -> Ordered:
    """Add boolean ``kept``.

    ``rows`` must be in the order in which the rule sees them.  When that is not
    the order of ``position`` (overlapping windows), pass ``in_time_order=False``.
    """
    if in_time_order:
        return rows.fold(Spaced(position, gap, rule))
    rows = rows.scan(__top=peak(position)).scan(__ceiling=lag("__top"))
    folded = rows.fold(Spaced(position, gap, rule, "__ceiling"))
    return folded.with_df(folded.df.drop("__top", "__ceiling"))


def spaced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, gap: float, rule: str = "offline"
) -> DataFrame:
    """Rows of ``df`` that survive suppression; ``order`` starts with ``position`` for time order."""
    rows = ordered(df, keys, order)
    return mark_spaced(rows, position, gap, rule, order[0] == position).where(F.col("kept")).rows().drop("kept")


class Throttled(Kernel):
    """Keep a row when its text differs from the last kept text and enough time has passed."""

    outputs = {"kept": "boolean"}

    def __init__(self, position: str, text: str, interval: float):
        self.position, self.text, self.interval = position, text, interval
        self.inputs = (position, text)

    def start(self):
        return None

    def _passes(self, t, text, state):
        # nothing shown yet: any non-empty text passes at once
        shown_at, shown = (None, "") if state is None else state
        return text != shown and (shown_at is None or t - shown_at >= self.interval)

    def run(self, columns, first, enter, state):
        kept = []
        for i, (t, text, new) in enumerate(zip(columns[self.position], columns[self.text], first)):
            if new:
                state = enter.get(i) if enter else None
            keep = self._passes(t, text, state)
            if keep:
                state = (t, text)
            kept.append(keep)
        return {"kept": kept}, state

    def summary(self, columns):
        # rows any state may start from: all within one interval of the block
        # start, then the first row of each run of equal text until two texts
        # different from each other (and not empty) were seen
        ts, texts = columns[self.position], columns[self.text]
        entries, seen, previous = [], set(), None
        for i, (t, text) in enumerate(zip(ts, texts)):
            inside = t - ts[0] < self.interval
            if inside or text != previous:
                entries.append(i)
            previous = text
            if not inside:
                seen.add(text)
                if len(seen - {""}) >= 2:
                    break
        memo: dict[int, tuple] = {}
        # end of the run of equal texts that a row belongs to
        ends = [len(ts)] * len(ts)
        for i in range(len(ts) - 2, -1, -1):
            ends[i] = ends[i + 1] if texts[i] == texts[i + 1] else i + 1

        def after(i: int) -> int:
            at = bisect.bisect_left(ts, True, lo=i + 1, key=lambda t: t - ts[i] >= self.interval)
            return ends[at] if at < len(ts) and texts[at] == texts[i] else at

        def leave(i: int) -> tuple:
            path, at = [], i
            while at not in memo:
                path.append(at)
                nxt = after(at)
                if nxt == len(ts):
                    memo[at] = (ts[at], texts[at])
                    break
                at = nxt
            for p in path:
                memo[p] = memo[at]
            return memo[i]

        return [(ts[i], texts[i], leave(i)) for i in entries]

    def follow(self, state, summary):
        for t, text, leave in summary:
            if self._passes(t, text, state):
                return leave
        return state


def throttle(rows: Ordered, position: str, text: str, interval: float = 0.25) -> Ordered:
    """Add ``kept``: the partial-caption redraw rule, on event time."""
    return rows.fold(Throttled(position, text, interval))


def gap_islands(rows: Ordered, position: str, gap: Column | float, name: str = "island") -> Ordered:
    """Number runs of rows whose distance from the previous row is below ``gap``."""
    cut = F.col(position) - F.col("__before") >= gap
    rows = rows.scan(__before=lag(position)).columns(__cut=F.coalesce(cut, F.lit(True)).cast("long"))
    rows = rows.scan(**{name: total("__cut")})
    return rows.with_df(rows.df.drop("__before", "__cut"))

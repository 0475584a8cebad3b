"""Matching-block similarity of two texts, which SQL functions cannot express.

The blocks are those of the standard library's matcher: the longest common run first (of equally
long ones the first in the left, then in the right text), grown over frequent items, then the same in the
gaps before and after it. They are found by falling length for all gaps at once: a gap that has no longer
run gives its runs of a length from left to right, each by one search in a sorted list of places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from pairkit.functions import text as tx

NAMES = ("seq_char_ratio", "seq_word_ratio", "edit_dist_approx", "edit_dist_norm",
         "lcs_len_chars", "lcs_len_words")
# From so many items on, those of more than a hundredth of the right text start no run, if asked for.
JUNK_FROM = 200
# Runs up to this length are found length by length; the length of longer ones is searched in each gap.
SHORT = 8

# Where a text has runs of some length that the other one has, too, and numbers of these runs.
Side = tuple[np.ndarray, np.ndarray]
# Bounds in the left, then in the right text.
Gap = tuple[int, int, int, int]


def _numbers(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """The items of both texts as numbers."""
    if isinstance(a, str):
        return tuple(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b))
    ids = defaultdict(count().__next__)
    return tuple(np.fromiter(map(ids.__getitem__, items), np.int64, len(items)) for items in (a, b))


def _shared(left: Side, right: Side) -> tuple[Side, Side]:
    """The runs that both have, with new numbers below the right text's length; the right side by number, then place."""
    (ia, ka), (ib, kb) = left, right
    if not len(ka) or not len(kb):
        return (ia[:0], ka[:0]), (ib[:0], kb[:0])
    order = np.lexsort((ib, kb))
    kb = kb[order]
    first = np.searchsorted(kb, ka)
    first[first == len(kb)] = 0
    found = kb[first] == ka
    ia, ka = ia[found], first[found]
    used = np.zeros(len(kb), bool)
    used[ka] = True
    number = np.searchsorted(kb, kb)
    kept = used[number]
    return (ia, ka), (ib[order[kept]], number[kept])


def _spread(sides: tuple[Side, Side], sizes: tuple[int, int]) -> list[np.ndarray]:
    """The number of the run at each place of both texts, or -1."""
    out = []
    for (at, numbers), size in zip(sides, sizes):
        out.append(np.full(size, -1, np.int64))
        out[-1][at] = numbers
    return out


def _joined(sides: tuple[Side, Side], step: int, nexts: list[np.ndarray], base: int) -> tuple[Side, Side]:
    """The runs of `sides` that one of `nexts` follows `step` places on."""
    out = []
    for (at, numbers), follow in zip(sides, nexts):
        inside = at + step < len(follow)
        at, numbers = at[inside], numbers[inside]
        after = follow[at + step]
        on = after >= 0
        out.append((at[on], numbers[on] * base + after[on]))
    return _shared(*out)


class Places:
    """Shared runs of one length: where they start in the left text, and where in the right one."""

    def __init__(self, size: int, sides: tuple[Side, Side], base: int) -> None:
        (ia, ka), (ib, kb) = sides
        self.size, self.starts, self.keys = size, ia.tolist(), (ka * base).tolist()
        self.right = (kb * base + ib).tolist()

    def next(self, gap: Gap) -> tuple[int, int] | None:
        """The first run within a gap."""
        alo, ahi, blo, bhi = gap
        if bhi - blo < self.size:
            return None
        low = bisect_left(self.starts, alo)
        for at in range(low, bisect_left(self.starts, ahi - self.size + 1, low)):
            key = self.keys[at]
            spot = bisect_left(self.right, key + blo)
            if spot < len(self.right) and self.right[spot] <= key + bhi - self.size:
                return self.starts[at], self.right[spot] - key
        return None

    def take(self, a: Sequence, b: Sequence, gaps: list[Gap]) -> tuple[int, list[Gap]]:
        """Items in the blocks of this length, for gaps without longer runs, and the gaps that are left."""
        total, out = 0, []
        for alo, ahi, blo, bhi in gaps:
            while found := self.next((alo, ahi, blo, bhi)):
                (i, j), (to, on) = found, (found[0] + self.size, found[1] + self.size)
                while i > alo and j > blo and a[i - 1] == b[j - 1]:
                    i, j = i - 1, j - 1
                while to < ahi and on < bhi and a[to] == b[on]:
                    to, on = to + 1, on + 1
                total += to - i
                if i > alo and j > blo:
                    out.append((alo, i, blo, j))
                alo, blo = to, on
            if alo < ahi and blo < bhi:
                out.append((alo, ahi, blo, bhi))
        return total, out


class Long:
    """Runs longer than `SHORT` items, each made of two runs that double in length from `SHORT` on."""

    def __init__(self, sides: tuple[Side, Side], sizes: tuple[int, int], base: int) -> None:
        self.sides, self.sizes, self.base, self.spread = [sides], sizes, base, [_spread(sides, sizes)]

    def within(self, gap: Gap, size: int) -> tuple[Side, Side]:
        """The runs of a length in a gap."""
        power = (size // SHORT).bit_length() - 1
        while len(self.sides) <= power:
            self.sides.append(_joined(self.sides[-1], SHORT << (len(self.sides) - 1), self.spread[-1], self.base))
            self.spread.append(_spread(self.sides[-1], self.sizes))
        step, out = SHORT << power, []
        for numbers, low, high in zip(self.spread[power], gap[::2], gap[1::2]):
            head, tail = numbers[low:high - size + 1], numbers[low + size - step:high - step + 1]
            on = np.flatnonzero((head >= 0) & (tail >= 0))
            out.append((on + low, head[on] * self.base + tail[on]))
        return _shared(*out)

    def longest(self, gap: Gap) -> Places:
        """The longest runs in a gap that has some of `SHORT` + 1."""
        low, high = SHORT + 1, min(gap[1] - gap[0], gap[3] - gap[2]) + 1
        best, doubling = self.within(gap, low), True
        while high - low > 1:
            size = min(2 * low, high - 1) if doubling else (low + high) // 2
            found = self.within(gap, size)
            if len(found[0][0]):
                low, best = size, found
            else:
                high, doubling = size, False
        return Places(low, best, self.base)


def _by_length(sides: tuple[Side, Side], sizes: tuple[int, int], base: int) -> Iterator[tuple[Places, tuple[Side, Side]]]:
    """Shared runs of 1, 2, ... `SHORT` + 1 items, as far as there are any."""
    items = _spread(sides, sizes)
    for size in range(1, SHORT + 2):
        if not len(sides[0][0]):
            return
        yield Places(size, sides, base), sides
        sides = _joined(sides, size, items, base)


def _matched(a: Sequence, b: Sequence, autojunk: bool) -> int:
    """Items in the matching blocks of two texts."""
    if a == b:
        return len(a)
    if not a or not b:
        return 0
    numbers, sizes, base = _numbers(a, b), (len(a), len(b)), len(b) + 1
    times = np.bincount(numbers[1], minlength=int(numbers[0].max()) + 1)
    if autojunk and len(b) >= JUNK_FROM:
        times[times > len(b) // 100 + 1] = 0
    first = [(at := np.flatnonzero(times[n]), n[at]) for n in numbers]
    lengths = list(_by_length(_shared(*first), sizes, base))
    total, gaps = 0, [(0, len(a), 0, len(b))]
    if len(lengths) > SHORT:
        above, runs = lengths.pop()[0], Long(lengths[-1][1], sizes, base)
        open_gaps, gaps = gaps, []
        while open_gaps:
            gap = open_gaps.pop()
            if above.next(gap) is None:
                gaps.append(gap)
            else:
                found, rest = runs.longest(gap).take(a, b, [gap])
                total += found
                open_gaps += rest
    for places, _ in reversed(lengths):
        found, gaps = places.take(a, b, gaps)
        total += found
    # Frequent items match only at the start of what is left.
    for alo, ahi, blo, bhi in gaps:
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            alo, blo, total = alo + 1, blo + 1, total + 1
    return total


def _ratio(matched: int, total: int) -> float:
    return 2.0 * matched / total if total else 1.0


def pair_sequence_values(q1: str, q2: str, autojunk: bool = True) -> tuple[float, ...]:
    """The values of `NAMES` for one pair; texts are compared whole and in order."""
    w1, w2 = q1.lower().split(), q2.lower().split()
    chars, words = _matched(q1, q2, autojunk), _matched(w1, w2, autojunk)
    char_ratio = _ratio(chars, len(q1) + len(q2))
    word_ratio = _ratio(words, len(w1) + len(w2))
    longest = max(len(q1), len(q2), 1)
    return (char_ratio, word_ratio, (1.0 - char_ratio) * longest, 1.0 - char_ratio,
            float(chars), float(words))


def sequence_struct(q1, q2, autojunk: bool = True) -> Column:
    """One Arrow UDF call that returns all matching-block values as a struct."""
    @F.arrow_udf(", ".join(f"{n} double" for n in NAMES))
    def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [pair_sequence_values(x or "", y or "", autojunk)
                for x, y in zip(a.to_pylist(), b.to_pylist())]
        columns = zip(*rows) if rows else [[] for _ in NAMES]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], list(NAMES))

    return kernel(tx._col(q1), tx._col(q2))

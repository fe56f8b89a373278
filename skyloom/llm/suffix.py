"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy.

A pass of induced sorting walks the array from one side.  All entries up to the
first place that is still to be filled are turned into their predecessors at
once; their places lie beyond it, so a stretch is as long as the order allows
and the Python steps are few (about the square root of the length on plain
text).  Alphabets of any size are sorted, and the reduced string, whose symbols
are the ranks of the leftmost-smaller substrings, by the same routine.
"""

from __future__ import annotations

import numpy as np

from .textops import ranges

#: Places looked at together when the next one that is to be filled is sought.
LOOK = 1024
#: Stretches of at most so many places are walked one by one: repeats of a phrase make long chains of single places.
FEW = 16
#: Pairs of neighbouring substrings compared together.
PAIRS = 1 << 14


def _suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the sentinel is."""
    change = np.flatnonzero(t[:-1] != t[1:])
    out = np.ones(len(t), bool)
    out[:-1] = np.repeat(t[change] < t[change + 1], np.diff(change, prepend=-1))
    return out


def _next_open(waiting: np.ndarray, at: int) -> int:
    """First place from ``at`` on that waits for its suffix, or the array's end."""
    if at + 1 < len(waiting) and waiting[at + 1] and not waiting[at]:
        return at + 1
    while at < len(waiting):
        seen = waiting[at : at + LOOK]
        k = int(seen.argmax())
        if seen[k]:
            return at + k
        at += LOOK
    return len(waiting)


def _walk(t: np.ndarray, sa: np.ndarray, free: np.ndarray, waiting: np.ndarray, wanted: np.ndarray) -> None:
    """Fill the ``waiting`` places of ``sa`` from the left.

    ``free`` is each symbol's next free place and ``wanted`` says which suffixes
    this walk places.  A symbol's suffixes arrive in the order of their successors.
    """
    n, low = len(sa), 0
    wanted = np.append(wanted, [False, False])  # for the predecessors -1 of the first suffix and -2 of an empty place
    count = np.arange(n, dtype=np.int32)
    suffixes, open_, wants, symbol, places = map(memoryview, (sa, waiting, wanted, t, free))
    while low < n:
        high = _next_open(waiting, low)
        if high == low:
            raise AssertionError("a place waits for no suffix")
        if high - low <= FEW:
            for k in range(low, high):
                before = suffixes[k] - 1
                if wants[before]:
                    own = symbol[before]
                    at = places[own]
                    suffixes[at], open_[at], places[own] = before, False, at + 1
            low = high
            continue
        before = sa[low:high].astype(np.intp)
        before -= 1
        before = before.compress(wanted.take(before))
        if len(before):
            symbols = t.take(before)
            order = symbols.argsort(kind="stable")
            symbols = symbols.take(order)
            at = free.take(symbols)
            at += count[: len(symbols)]
            at -= symbols.searchsorted(symbols)
            sa[at] = before.take(order)
            waiting[at] = False
            at += 1
            free[symbols] = at  # of equal symbols the last, and largest, place counts
        low = high


def alternating(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each symbol in turn so many times True, then so many times False."""
    return np.repeat(np.tile([True, False], len(first)), np.stack([first, second], 1).ravel())


def _induce(t: np.ndarray, sigma: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes, induced from the leftmost-smaller ones in the order given."""
    n = len(t)
    counts = np.bincount(t, minlength=sigma)
    tail = np.cumsum(counts)
    # L-type suffixes come first within their symbol, the leftmost-smaller ones start at its end
    large = np.bincount(t[~small], minlength=sigma)
    is_large = alternating(large, counts - large)

    sa = np.full(n, -1, np.int32)
    symbols = t[lms]
    own = np.bincount(symbols, minlength=sigma)
    sa[~alternating(counts - own, own)] = lms[np.argsort(symbols, kind="stable")]
    _walk(t, sa, tail - counts, is_large.copy(), ~small)

    # the S-type suffixes, from the right: the same walk over the mirrored array with mirrored symbols
    sa[~is_large] = -1
    sa[0] = n - 1
    waiting = ~is_large
    waiting[0] = False
    mirrored = sa[::-1].copy()
    _walk(t, mirrored, n - tail, waiting[::-1].copy(), small)
    return mirrored[::-1]


def _names(t: np.ndarray, ordered: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """Ranks of leftmost-smaller substrings in their order; equal ones, compared symbol by symbol, share one."""
    size = end_of[ordered] - ordered
    differs = size[1:] != size[:-1]
    alike = np.flatnonzero(~differs)
    for begin in range(0, len(alike), PAIRS):
        pair = alike[begin : begin + PAIRS]
        length = size[pair]
        step = ranges(length)
        unlike = t[np.repeat(ordered[pair], length) + step] != t[np.repeat(ordered[pair + 1], length) + step]
        differs[pair] = np.logical_or.reduceat(unlike, np.cumsum(length) - length)
    return np.cumsum(np.concatenate([[0], differs]), dtype=np.int32)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t``, whose symbols are below ``sigma`` and whose last is 0 and occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _suffix_types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        sa = _induce(t, sigma, small, lms)
        ordered = sa[is_lms[sa]]
        end_of = np.empty(n, np.int32)
        end_of[lms] = np.append(lms[1:] + 1, n)
        ranks = _names(t, ordered, end_of)
        place = np.empty(n, np.int32)
        place[ordered] = ranks
        names = place[lms].astype(np.uint16 if ranks[-1] < 1 << 16 else np.int32)
        if ranks[-1] + 1 == len(lms):  # all differ: the ranks are the order
            lms = ordered
        else:
            lms = lms[suffix_array(names, int(ranks[-1]) + 1)]
    return _induce(t, sigma, small, lms)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each position its common prefix (at most ``cap`` symbols) with the suffix before it in
    the array, and that suffix's position.

    ``t`` holds bytes or 32-bit symbols.  A position's value is at least its left
    neighbour's less one; blocks of positions advance side by side and carry their
    values along.
    """
    n, wide = len(t), t.itemsize
    each = 8 // wide  # symbols compared at once
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t, np.zeros(cap + 16, t.dtype)])
    words = np.ndarray(len(padded) - each + 1, "<u8", padded, strides=(wide,))
    out = np.zeros(n, np.int32)
    value = np.zeros(-(-n // block), np.int64)
    for k in range(block):
        at = np.arange(k, n, block)
        value = np.maximum(value[: len(at)] - 1, 0)
        other = before[at]
        live = np.flatnonzero((other >= 0) & (value < cap))
        value[other < 0] = 0
        while len(live):
            x = words[at[live] + value[live]] ^ words[other[live] + value[live]]
            same = (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3) // wide
            value[live] += same
            live = live[(same == each) & (value[live] < cap)]
        value = np.minimum(value, cap)
        out[at] = value
    return out, before


def nearest_smaller(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one to the left with a smaller value (-1: none), and what they have in common.

    ``common[i]`` is what place ``i`` shares with place ``i - 1``; what two places
    share is the least of the steps between them.  All places jump along their
    left neighbours' findings until none is too large.
    """
    n = len(values)
    left = np.arange(-1, n - 1)
    shared = common.astype(np.int64)
    if n:
        shared[0] = 0
    live = np.arange(1, n)
    live = live[values[left[live]] >= values[live]]
    while len(live):
        via = left[live]
        shared[live] = np.minimum(shared[live], shared[via])
        left[live] = left[via]
        live = live[left[live] >= 0]
        live = live[values[left[live]] >= values[live]]
    return left, shared


def repeated_starts(texts: np.ndarray, width: int) -> np.ndarray:
    """Positions whose next ``width`` symbols occur at another position too.

    ``texts`` holds byte values raised by one and a final 0.  Separators between
    texts are symbols like any other; starts near one are the caller's to discard.
    """
    sa = suffix_array(texts, 256)
    common, before = permuted_common_prefixes(texts, sa, width)
    marked = np.zeros(len(texts), bool)
    hit = np.flatnonzero(common >= width)
    marked[hit] = True
    marked[before[hit]] = True
    return marked

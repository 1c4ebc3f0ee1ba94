"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classed as S (smaller than the next) or L. The leftmost S of each run (LMS) start
substrings that are sorted by one round of induction and named; if names repeat, the string of
names, at most half as long, is sorted first, recursively. From the sorted LMS suffixes the L
suffixes are induced bucket by bucket, left to right, and from these the S suffixes, right to
left. All steps are linear in the string.

With few symbols, as bytes are, what one bucket induces is moved at once as an array; a bucket
is visited again only for runs of its own symbol. With many, as names are, buckets are too small
for that, and suffixes are moved one by one.
"""

from __future__ import annotations

import numpy as np

_FEW_SYMBOLS = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True for S. The last suffix counts as S (it holds the unique least symbol)."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        change = np.flatnonzero(t[1:] != t[:-1])  # ends of runs of one symbol
        ends = np.append(change, n - 1)
        rising = np.append(t[change + 1] > t[change], True)
        s = np.repeat(rising, np.diff(np.append(-1, ends)))
    return s


def _by_symbol(p: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """p stably grouped by symbol; the groups' symbols, counts, and each one's place in its group."""
    order = np.argsort(symbols, kind="stable")
    grouped = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]]))
    counts = np.diff(np.append(first, len(grouped)))
    return p[order], grouped, np.arange(len(grouped)) - np.repeat(first, counts), counts


def _induce_buckets(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes from LMS suffixes given in order (sorted, or just grouped by their first symbol)."""
    n = len(t)
    size = np.bincount(t, minlength=k)
    tail = np.cumsum(size)
    head = tail - size
    sa = np.full(n, -1, np.int64)
    moved, symbols, place, _ = _by_symbol(lms, t[lms])
    lms_count = np.bincount(symbols, minlength=k)
    sa[(tail - lms_count)[symbols] + place] = moved
    filled = head.copy()
    present = np.flatnonzero(size)

    def push_left(p: np.ndarray) -> None:
        p = p[p > 0] - 1
        p = p[~s[p]]
        if len(p):
            moved, symbols, place, _ = _by_symbol(p, t[p])
            sa[filled[symbols] + place] = moved
            np.add.at(filled, symbols[place == 0], np.bincount(symbols, minlength=k)[symbols[place == 0]])

    for c in present:
        at = head[c]
        while at < filled[c]:
            at, until = filled[c], at
            push_left(sa[until:at])
        if lms_count[c]:
            push_left(sa[tail[c] - lms_count[c] : tail[c]])

    free = tail.copy()

    def push_right(p: np.ndarray) -> None:
        p = p[p > 0] - 1
        p = p[s[p]]
        if len(p):
            moved, symbols, place, _ = _by_symbol(p, t[p])
            sa[free[symbols] - 1 - place] = moved
            firsts = symbols[place == 0]
            free[firsts] -= np.bincount(symbols, minlength=k)[firsts]

    free[t[n - 1]] -= 1
    sa[free[t[n - 1]]] = n - 1
    for c in present[::-1]:
        at = tail[c]
        while at > free[c]:
            at, until = free[c], at
            push_right(sa[at:until][::-1])
        push_right(sa[head[c] : filled[c]][::-1])
    return sa


def _induce_each(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same, suffix by suffix."""
    n = len(t)
    size = np.bincount(t, minlength=k)
    tails = np.cumsum(size)
    symbol, before = t.tolist(), np.concatenate([[-1], t[:-1]])
    # of each place the symbol before it, if the suffix there is of the kind to be moved; none stands before place 0
    falling = np.append(False, ~s[:-1])
    sa = [0] * n
    free = tails.tolist()
    for p in lms[::-1].tolist():
        free[symbol[p]] -= 1
        sa[free[symbol[p]]] = p
    free = (tails - size).tolist()
    of = np.where(falling, before, -1).tolist()
    for p in sa:
        c = of[p]
        if c >= 0:
            to = free[c]
            sa[to] = p - 1
            free[c] = to + 1
    free = tails.tolist()
    of = np.where(falling, -1, before).tolist()
    for p in reversed(sa):
        c = of[p]
        if c >= 0:
            free[c] = to = free[c] - 1
            sa[to] = p - 1
    return np.array(sa, np.int64)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    return (_induce_buckets if k <= _FEW_SYMBOLS else _induce_each)(t, s, lms, k)


def _names(t: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, equal ones alike, for the sorted LMS places."""
    n = len(t)
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    a, b = in_order[:-1], in_order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    offset = 0
    while len(live):
        live = live[length[a[live]] > offset]
        differ = t[a[live] + offset] != t[b[live] + offset]
        same[live[differ]] = False
        live = live[~differ]
        offset += 1
    return np.cumsum(np.concatenate([[0], ~same]))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix order of a string of small non-negative integers whose last is its unique least."""
    t = np.asarray(t)
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    k = int(t.max()) + 1
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    sa = _induce(t, s, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    in_order = sa[is_lms[sa]]
    names = _names(t, lms, in_order)
    if names[-1] + 1 < len(lms):
        of = np.empty(n, np.int64)
        of[in_order] = names
        in_order = lms[suffix_array(of[lms])]
    return _induce(t, s, in_order, k)


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """PLCP up to cap: for each place, the common prefix with the suffix before it in order.

    Eight bytes at a time, only for places that agreed so far; t holds bytes.
    """
    n = len(t)
    padded = np.concatenate([t.astype(np.uint8), np.zeros(cap + 16, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = np.ascontiguousarray(word).view("<u8").ravel()
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    at = 0
    while len(live) and at < cap:
        x = word[live + at] ^ word[np.minimum(before[live] + at, n)]
        equal = x == 0
        part = live[~equal]
        low = x[~equal] & (~x[~equal] + np.uint64(1))
        plcp[part] = at + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        live = live[equal]
        at += 8
        plcp[live] = at
    return np.minimum(plcp, np.minimum(cap, n - np.maximum(np.arange(n), before)))

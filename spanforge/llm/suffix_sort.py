"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A suffix is *smaller* (S) when it sorts before the one that follows it, else *larger*
(L).  The leftmost smaller suffixes of runs of S cut the text into substrings.  These
are sorted by inducing and named in order; the string of names is sorted by the same
procedure; the order of its suffixes induces that of all others in two linear passes.

Texts over a small alphabet are induced bucket by bucket: what a bucket induces is
dealt to other buckets in one stable step, and a run of one symbol at once.  Names form
a large alphabet; there the same order is found by doubling along the chains of L (then
of S) positions, which end at a known position.
"""

from __future__ import annotations

import numpy as np

#: alphabets up to this size are induced bucket by bucket
BUCKETS = 4096


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes of type S; an end that is smaller than all symbols follows the text."""
    n = len(t)
    at = np.arange(n)
    differs = np.ones(n, bool)
    np.not_equal(t[:-1], t[1:], out=differs[:-1])
    nxt = np.minimum.accumulate(np.where(differs, at, n)[::-1])[::-1]
    rising = np.zeros(n, bool)
    np.less(t[:-1], t[1:], out=rising[:-1])
    return rising[nxt]


def leftmost(small: np.ndarray) -> np.ndarray:
    """Positions of S suffixes that follow an L suffix."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _deal(queues: list, entries: np.ndarray, symbols: np.ndarray) -> None:
    order = np.argsort(symbols, kind="stable")
    symbols, entries = symbols[order], entries[order]
    edges = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(entries)], strict=True):
        queues[symbols[lo]].append(entries[lo:hi])


def _with_runs(entries: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each entry, then in rounds the positions before it that hold the same symbol."""
    r = before[entries]
    if not r.any():
        return entries
    steps = r + 1
    own = np.repeat(np.arange(len(entries)), steps)
    k = np.arange(len(own)) - np.repeat(np.cumsum(steps) - steps, steps)
    return (entries[own] - k)[np.argsort(k, kind="stable")]


def _induce_buckets(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes, given the leftmost smaller ones in an order that holds within each bucket."""
    n = len(t)
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    at = np.arange(n)
    before = at - np.repeat(starts, np.diff(np.r_[starts, n]))
    larger: list = [[] for _ in range(k)]
    given: list = [[] for _ in range(k)]
    if len(lms):
        _deal(given, lms, t[lms])
    larger[t[n - 1]].append(np.array([n - 1]))
    none = np.zeros(0, np.int64)
    done: list = [none] * k
    for c in range(k):
        own = _with_runs(np.concatenate(larger[c]), before) if larger[c] else none
        done[c] = own
        for part in (own, *given[c]):
            prev = part[part > 0] - 1
            sym = t[prev]
            go = sym > c
            if go.any():
                _deal(larger, prev[go], sym[go])
    smaller: list = [[] for _ in range(k)]
    out: list = []
    for c in range(k - 1, -1, -1):
        own = none
        if smaller[c]:
            own = _with_runs(np.concatenate(smaller[c]), before)
        for part in (own, done[c][::-1]):
            if len(part):
                out.append(part)
                prev = part[part > 0] - 1
                sym = t[prev]
                go = sym < c
                if go.any():
                    _deal(smaller, prev[go], sym[go])
    return np.concatenate(out)[::-1]


def _heads(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order of a key and, in that order, where each element's group of equals begins and whether it has several."""
    order = np.argsort(key)
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    starts = np.flatnonzero(first)
    size = np.diff(np.r_[starts, len(key)])
    return order, np.repeat(starts, size), np.repeat(size > 1, size)


def _dense(key: np.ndarray) -> np.ndarray:
    order, head, _ = _heads(key)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[0, head[1:] != head[:-1]])
    return out


def _along(key: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank positions by their keys and those that follow, up to and with the first position in ``ends``.

    Equals share the rank of their first; only groups that are still undecided are sorted again.
    """
    n = len(ends)
    rank = np.empty(n, np.int64)
    order, head, many = _heads(key)
    rank[order] = head
    live = order[many]
    live = live[~ends[live]]
    jump = np.where(ends, np.arange(n), np.arange(n) + 1)
    while len(live):
        over = ends[jump[live]]
        key = rank[live] * n + rank[jump[live]]
        order, head, many = _heads(key)
        live, over, old = live[order], over[order], rank[live[order]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(old)), 0))
        rank[live] = old + head - group
        live = live[many & ~over]
        jump = jump[jump]
    return rank


def _induce_chains(t: np.ndarray, small: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ranks of all positions from ``known``, the ranks of the leftmost smaller ones (-1 elsewhere), equal ranks allowed.

    A larger suffix is decided by its symbols up to the next leftmost smaller one, a
    smaller suffix by its symbols up to the next larger one.  The text ends in a sentinel.
    """
    symbol = t * 2 + small
    n = len(t) + 1
    rank = _along(symbol * n + np.where(known >= 0, known, 0), small)
    ends = ~small
    ends[-1] = True
    return _along(symbol * n + np.where(small, 0, rank + 1), ends)


def _names(t: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in text order, of the substrings between leftmost smaller positions; ``lms`` in sorted order."""
    at = np.sort(lms)
    size = np.diff(np.r_[at, len(t) - 1]) + 1
    length = np.zeros(len(t), np.int64)
    length[at] = size
    a, b = lms[:-1], lms[1:]
    new = length[a] != length[b]
    live = np.flatnonzero(~new)
    k = 0
    while len(live):
        differs = t[a[live] + k] != t[b[live] + k]
        new[live[differs]] = True
        k += 1
        live = live[~differs]
        live = live[length[a[live]] > k]
    # the last substring runs into the end and is like no other
    new |= (a == at[-1]) | (b == at[-1])
    name = np.zeros(len(t), np.int64)
    name[lms] = np.r_[0, np.cumsum(new)]
    return name[at], int(new.sum()) + 1


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """Start positions of all suffixes of ``t`` (non-negative integers) in sorted order; a prefix sorts before the longer text."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t if t.dtype == np.uint16 else t.astype(np.int64)
    k = int(t.max()) + 1 if k is None else k
    small = classify(t)
    lms = leftmost(small)
    if k <= BUCKETS:
        if len(lms):
            order = _induce_buckets(t, small, lms, k)
            is_lms = np.zeros(n, bool)
            is_lms[lms] = True
            names, count = _names(t, order[is_lms[order]])
            lms = lms[np.argsort(names, kind="stable") if count == len(lms) else suffix_array(names, count)]
        return _induce_buckets(t, small, lms, k)
    t, small = np.r_[t + 1, 0], np.r_[small, True]
    lms = np.r_[lms, n]  # the sentinel is one too
    known = np.full(n + 1, -1, np.int64)
    known[lms] = 0
    names = _dense(_induce_chains(t, small, known)[lms])
    known[lms] = names
    if names.max() + 1 < len(names):
        known[lms[suffix_array(names)]] = np.arange(len(lms))
    return np.argsort(_induce_chains(t, small, known))[1:]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros beyond the end."""
    w = np.zeros(len(data) + 8, np.uint64)
    w[: len(data)] = data
    for shift in (1, 2, 4):
        w[:-shift] |= w[shift:] << np.uint64(8 * shift)
    return w


def common_prefixes(data: np.ndarray, order: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, the bytes its suffix shares with the one sorted before it.

    Suffixes end at ``end``.  Only positions whose neighbour is not that of the position
    before, moved by one, are compared; the others share one byte less than it.
    """
    n = len(data)
    at = np.arange(n)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] < 1) | (end[1:] != end[:-1]) | (data[:-1] != data[phi[1:] - 1]) | (end[phi[1:] - 1] != end[phi[1:]])
    p = at[fresh & (phi >= 0)]
    q = phi[p]
    most = np.minimum(end[p] - p, end[q] - q)
    got = np.zeros(len(p), np.int64)
    words, live = words_at(data), np.flatnonzero(most > 0)
    while len(live) > 16:
        a, b = p[live] + got[live], q[live] + got[live]
        x = words[a] ^ words[b]
        same = x == 0
        low = x & (~x + np.uint64(1))
        got[live] += np.where(same, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
        live = live[same]
        live = live[got[live] < most[live]]
    for k in live.tolist():  # few and long: block by block
        size = 64
        while got[k] < most[k]:
            a, b = p[k] + got[k], q[k] + got[k]
            size = min(2 * size, 1 << 20, most[k] - got[k])
            x = data[a : a + size] != data[b : b + size]
            if x.any():
                got[k] += int(x.argmax())
                break
            got[k] += size
    reach = np.zeros(n, np.int64)
    reach[p] = p + np.minimum(got, most)
    return np.maximum(np.maximum.accumulate(reach) - at, 0)


def repeated_starts(data: np.ndarray, parts: np.ndarray, length: int) -> np.ndarray:
    """True where a string of ``length`` bytes starts that also starts at another position.

    ``parts`` are the sizes of the texts that lie one after the other in ``data``; strings stay inside one.
    """
    n, ends = len(data), np.cumsum(parts)
    mark = np.zeros(n, bool)
    if not n:
        return mark
    end = np.repeat(ends, parts)
    # each text is closed by a symbol below all others
    text = np.zeros(n + len(parts), np.uint16)
    place = np.arange(n) + np.repeat(np.arange(len(parts)), parts)
    text[place] = data.astype(np.uint16) + 1
    order = suffix_array(text, 257)
    back = np.full(len(text), -1, np.int64)
    back[place] = np.arange(n)
    order = back[order]
    order = order[order >= 0]
    again = np.flatnonzero(common_prefixes(data, order, end)[order[1:]] >= length)
    mark[order[1:][again]] = True
    mark[order[:-1][again]] = True
    return mark

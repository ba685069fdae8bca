"""Suffix arrays by induced sorting, and permuted common prefixes, of a run of bytes.

Suffixes are classed as smaller (S) or larger (L) than their right neighbour.  Substrings from one leftmost S place to
the next are sorted by induction and named; if names repeat, the string of names, a third as long, is sorted by ranks of
doubled length.  From the sorted leftmost S suffixes all others are induced: a bucket is filled from all entries of
another at once.  Both work by array operations, never entry by entry.
"""

from __future__ import annotations

import numpy as np


def classes(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next; the empty suffix after the end is the smallest."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    if n < 2:
        return s
    # A run of equal values has the class of its last place.
    differs = np.flatnonzero(t[1:] != t[:-1])
    up = t[differs] < t[differs + 1]
    lengths = np.diff(np.concatenate([[-1], differs, [n - 1]]))
    return np.repeat(np.concatenate([up, [False]]), lengths)


def leftmost(s: np.ndarray) -> np.ndarray:
    """Places of S suffixes whose left neighbour is L."""
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _induce_bytes(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order from leftmost S suffixes in order (bucket by bucket), with array operations."""
    n = len(t)
    large = np.bincount(t[~s], minlength=k)
    small = np.bincount(t[s], minlength=k)
    seed_value = t[seeds]
    seed_end = np.cumsum(np.bincount(seed_value, minlength=k))
    seed_from = seed_end - np.bincount(seed_value, minlength=k)
    l_runs: list[list[np.ndarray]] = [[] for _ in range(k)]
    # L suffixes: buckets upward; the suffix before each entry goes behind those already in its bucket.
    last = n - 1
    l_runs[t[last]].append(np.array([last], dtype=np.int64))
    l_sorted: list[np.ndarray] = [None] * k
    for c in range(k):
        if not large[c] and seed_from[c] == seed_end[c]:
            l_sorted[c] = np.zeros(0, np.int64)
            continue
        got = []
        queue = l_runs[c]
        at = 0
        while at < len(queue):
            run = queue[at]
            at += 1
            got.append(run)
            _send(t, s, run, c, l_runs, want_small=False)
        l_sorted[c] = np.concatenate(got) if got else np.zeros(0, np.int64)
        own = seeds[seed_from[c] : seed_end[c]]
        if len(own):
            _send(t, s, own, c, l_runs, want_small=False)
    # S suffixes: buckets downward, filled from the back; runs hold entries from the largest on.
    s_runs: list[list[np.ndarray]] = [[] for _ in range(k)]
    s_sorted: list[np.ndarray] = [None] * k
    for c in range(k - 1, -1, -1):
        if not small[c] and not large[c]:
            s_sorted[c] = np.zeros(0, np.int64)
            continue
        got = []
        queue = s_runs[c]
        at = 0
        while at < len(queue):
            run = queue[at]
            at += 1
            got.append(run)
            _send(t, s, run, c, s_runs, want_small=True)
        s_sorted[c] = np.concatenate(got)[::-1] if got else np.zeros(0, np.int64)
        if len(l_sorted[c]):
            _send(t, s, l_sorted[c][::-1], c, s_runs, want_small=True)
    return np.concatenate([x for c in range(k) for x in (l_sorted[c], s_sorted[c])])


def _send(t: np.ndarray, s: np.ndarray, run: np.ndarray, c: int, runs: list, want_small: bool) -> None:
    """Append the left neighbours of a run, in its order, to the runs of their buckets."""
    before = run[run > 0] - 1
    before = before[s[before] == want_small]
    if not len(before):
        return
    value = t[before]
    if len(before) == 1:
        runs[value[0]].append(before)
        return
    by = np.argsort(value, kind="stable")
    value, before = value[by], before[by]
    edges = np.flatnonzero(value[1:] != value[:-1]) + 1
    starts = [0, *edges.tolist(), len(value)]
    for a, b in zip(starts[:-1], starts[1:]):
        runs[value[a]].append(before[a:b])


def _double(t: np.ndarray) -> np.ndarray:
    """All suffixes in order for a string of names: ranks of twice the length from two ranks, where still equal."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    at, key, step = np.arange(n), t[order], 0
    while True:
        # A rank is the first place of its group in the order, so a settled suffix keeps its own.
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[at]] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = at[tied]
        if not len(at):
            return order
        step = 2 * step or 1
        own = order[at]
        inside = own + step < n
        key = rank[own] * (n + 1)
        key[inside] += rank[own[inside] + step] + 1
        by = np.argsort(key)
        order[at], key = own[by], key[by]


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Places of all suffixes of ``t`` (values below k) in order."""
    t = np.asarray(t)
    n = len(t)
    if n < 2:
        return np.arange(n)
    if k > 512:
        return _double(t)
    s = classes(t)
    marks = leftmost(s)
    if len(marks) == 0:
        return _induce_bytes(t, s, marks, k)
    rough = marks[np.argsort(t[marks], kind="stable")]
    order = _induce_bytes(t, s, rough, k)
    is_mark = np.zeros(n, dtype=bool)
    is_mark[marks] = True
    ordered = order[is_mark[order]]
    if len(marks) > 1:
        names, count = _name(t, marks, ordered)
        if count < len(marks):
            ordered = marks[suffix_array(names, count)]
    return _induce_bytes(t, s, ordered, k)


def _name(t: np.ndarray, marks: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each leftmost-S substring in order of place; equal substrings share one."""
    n = len(t)
    length = np.append(np.diff(marks), n - marks[-1])
    where = np.zeros(n, dtype=np.int64)
    where[marks] = np.arange(len(marks))
    ids = where[ordered]
    a, b = ordered[:-1], ordered[1:]
    # The substring reaches into the first place of the next mark; the last one ends with the text and equals none.
    same = (length[ids[:-1]] == length[ids[1:]]) & (ids[:-1] != len(marks) - 1) & (ids[1:] != len(marks) - 1)
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        inside = step <= length[ids[left]]
        left_in = left[inside]
        equal = t[a[left_in] + step] == t[b[left_in] + step]
        same[left_in[~equal]] = False
        left = left_in[equal]
        step += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.zeros(len(marks), dtype=np.int64)
    names[ids] = rank
    return names, int(rank[-1]) + 1


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix, by place in the text, with the one before it in order; counted up to ``most``.

    Where the suffix at the next place follows the next place of the same partner, the prefix is longer by one than
    there, so bytes are compared only at the last place of each such run.
    """
    n = len(t)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -n
    text = np.concatenate([t.astype(np.uint8), np.zeros(most + 8, np.uint8)])
    words = np.ndarray(len(text) - 7, dtype="<u8", buffer=text, strides=(1,))
    run_on = np.zeros(n, dtype=bool)
    run_on[:-1] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    # Suffixes that start with different bytes share nothing, whatever their neighbours share.
    run_on[:-1] &= t[:-1] == t[before[:-1]]
    last = np.flatnonzero(~run_on)
    live = last[before[last] >= 0]
    # No suffix shares bytes behind the end of the text, where zeros stand.
    room = n - np.maximum(live, before[live])
    near, known = live, np.zeros(len(live), dtype=np.int64)
    left = np.arange(len(live))
    for step in range(0, most, 8):
        differs = words[near + step] ^ words[before[near] + step]
        equal = differs == 0
        ends = differs[~equal]
        # The lowest bit that differs tells the byte.
        bit = ends & (~ends + np.uint64(1))
        known[left[~equal]] = step + np.log2(bit.astype(np.float64)).astype(np.int64) // 8
        left, near = left[equal], near[equal]
        known[left] = step + 8
        if not len(left):
            break
    out[live] = np.minimum(np.minimum(known, room), most)
    until = last[np.cumsum(~run_on) - ~run_on]
    return np.where(run_on, np.minimum(out[until] + until - np.arange(n), most), out)

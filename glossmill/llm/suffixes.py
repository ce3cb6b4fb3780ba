"""Suffix arrays by induced sorting, a batch of buckets at a time, and permuted common prefixes.

Everything here is numpy inside one task, on one shard of bounded size.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one right of it (S-type); the last symbol counts as S."""
    n = text.size
    change = np.flatnonzero(text[:-1] != text[1:])
    s_type = np.empty(n, bool)
    s_type[-1] = True
    if change.size:
        begins = np.concatenate(([0], change[:-1] + 1))
        s_type[: change[-1] + 1] = np.repeat(text[change] < text[change + 1], change + 1 - begins)
        s_type[change[-1] + 1 : -1] = False
    return s_type


def _deal(order: np.ndarray, positions: np.ndarray, symbols: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put positions into the buckets of their symbols, in order, at ``edge``, which moves by ``step``."""
    if not positions.size:
        return
    by = np.argsort(symbols, kind="stable")
    grouped = symbols[by]
    first = np.flatnonzero(np.concatenate(([True], grouped[1:] != grouped[:-1])))
    count = np.diff(np.concatenate((first, [grouped.size])))
    within = np.arange(grouped.size) - np.repeat(first, count)
    base = edge[grouped]
    order[base + within if step > 0 else base - 1 - within] = positions[by]
    edge[grouped[first]] += step * count


def _induce(order: np.ndarray, text: np.ndarray, wanted: np.ndarray, starts: np.ndarray, ends: np.ndarray,
            edge: np.ndarray, step: int) -> None:
    """One induced pass: left to right for L-type (step 1), right to left for S-type (step -1).

    A batch of buckets is handled at once as long as nothing is induced into the batch itself. Where a suffix is
    induced into its own bucket (a symbol that repeats), that bucket is filled wave by wave first.
    """
    sigma, n = starts.size, order.size
    bucket = 0 if step > 0 else sigma - 1
    width = max(64, 2 * int(n**0.5))
    size = width
    while 0 <= bucket < sigma:
        if step > 0:
            last = max(bucket, int(np.searchsorted(ends, starts[bucket] + size, "right")) - 1)
            block = order[starts[bucket] : ends[last]]
        else:
            last = min(bucket, int(np.searchsorted(starts, ends[bucket] - size, "left")))
            block = order[starts[last] : ends[bucket]][::-1]
        left = block[block > 0] - 1
        left = left[wanted[left]]
        symbols = text[left]
        inside = symbols[(symbols - last) * step <= 0]
        if inside.size:
            clash = int(inside.min() if step > 0 else inside.max())
            size = max(64, size // 2)
            if clash == bucket:
                last = bucket
                lo, hi = (starts[bucket], edge[bucket]) if step > 0 else (edge[bucket], ends[bucket])
                wave = order[lo:hi] if step > 0 else order[lo:hi][::-1]
                while wave.size:
                    wave = wave[wave > 0] - 1
                    wave = wave[wanted[wave]]
                    wave = wave[text[wave] == bucket]
                    if step > 0:
                        order[edge[bucket] : edge[bucket] + wave.size] = wave
                    else:
                        order[edge[bucket] - wave.size : edge[bucket]] = wave[::-1]
                    edge[bucket] += step * wave.size
                block = order[starts[bucket] : ends[bucket]][::step]
            else:
                last = clash - step
                block = order[starts[bucket] : ends[last]] if step > 0 else order[starts[last] : ends[bucket]][::-1]
            left = block[block > 0] - 1
            left = left[wanted[left]]
            symbols = text[left]
            if clash == bucket:
                left, symbols = left[symbols != bucket], symbols[symbols != bucket]
        else:
            size = min(4 * width, size + size // 2)
        _deal(order, left, symbols, edge, step)
        bucket = last + step


def _sorted_from(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost S-type (LMS) ones in the given order."""
    n = text.size
    order = np.full(n, -1, np.int64)
    tail = ends.copy()
    _deal(order, lms[::-1], text[lms[::-1]], tail, -1)
    head = starts.copy()
    _induce(order, text, ~s_type, starts, ends, head, 1)
    # Only L-type entries stay; the S-type ones are induced anew.
    at = np.flatnonzero(order >= 0)
    order[at[s_type[order[at]]]] = -1
    order[0] = n - 1
    tail = ends.copy()
    tail[text[n - 1]] -= 1
    _induce(order, text, s_type, starts, ends, tail, -1)
    return order


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of symbols in [0, sigma). The last symbol has to be 0 and occur nowhere else."""
    text = text.astype(np.int64, copy=False)
    n = text.size
    if n == 1:
        return np.zeros(1, np.int64)
    ends = np.cumsum(np.bincount(text, minlength=sigma))
    starts = ends - np.bincount(text, minlength=sigma)
    s_type = smaller_than_next(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    if lms.size > 1:
        order = _sorted_from(text, s_type, lms, starts, ends)
        ranked = order[is_lms[order]]
        names = _names(text, lms, ranked)
        by_place = np.empty(n, np.int64)
        by_place[ranked] = names
        reduced = by_place[lms]
        if names[-1] + 1 == lms.size:
            lms = ranked
        else:
            lms = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return _sorted_from(text, s_type, lms, starts, ends)


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Dense names of the sorted LMS substrings: equal substrings, equal name."""
    length = np.ones(text.size, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = ranked[:-1], ranked[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    step = 0
    while live.size:
        equal = text[a[live] + step] == text[b[live] + step]
        same[live[~equal]] = False
        step += 1
        live = live[equal]
        live = live[length[a[live]] > step]
    return np.concatenate(([0], np.cumsum(~same)))


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the length of the common prefix with the suffix before it in order.

    Only irreducible positions, where the symbols to the left differ, are compared; the others follow from their
    left neighbour, being one shorter.
    """
    n = text.size
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    position = np.arange(n)
    reducible = (position > 0) & (before > 0)
    reducible[reducible] = text[position[reducible] - 1] == text[before[reducible] - 1]
    start = np.flatnonzero(~reducible)
    common = np.zeros(start.size, np.int64)
    live = np.flatnonzero(before[start] >= 0)
    # Compare eight symbols at a time, then one at a time within the eight that differ.
    padded = np.concatenate((text, np.full(8, -1)))
    words = np.zeros(n, np.uint64)
    mixed = (padded + 1).astype(np.uint64)
    for k in range(8):
        words = words * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + n]
    while live.size:
        i, j = start[live] + common[live], before[start[live]] + common[live]
        fits = np.maximum(i, j) + 8 <= n
        equal = np.zeros(live.size, bool)
        equal[fits] = words[i[fits]] == words[j[fits]]
        for k in range(8):  # the hash only proposes
            equal[equal] = text[i[equal] + k] == text[j[equal] + k]
        rest, ri, rj = live[~equal], i[~equal], j[~equal]
        for _ in range(8):
            fit = np.maximum(ri, rj) < n
            rest, ri, rj = rest[fit], ri[fit], rj[fit]
            fit = text[ri] == text[rj]
            rest, ri, rj = rest[fit], ri[fit] + 1, rj[fit] + 1
            common[rest] += 1
        live = live[equal]
        common[live] += 8
    source = np.zeros(n, np.int64)
    source[start] = start
    source = np.maximum.accumulate(source)
    value = np.zeros(n, np.int64)
    value[start] = common
    return np.maximum(value[source] - (position - source), 0)


def doubled_suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling, for large alphabets: each round sorts only the suffixes that still tie."""
    n = text.size
    order = np.argsort(text, kind="stable")
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    group = text[order]
    step = 0
    live = order
    while True:
        first = np.concatenate(([True], group[1:] != group[:-1]))
        rank[live] = slots[np.maximum.accumulate(np.where(first, np.arange(live.size), 0))]
        tied = ~first | ~np.concatenate((first[1:], [True]))
        live, slots = live[tied], slots[tied]
        if not live.size:
            return order
        step = max(1, step * 2)
        behind = np.minimum(live + step, n - 1)
        key = rank[live] * n + np.where(live + step < n, rank[behind], 0)
        by = np.argsort(key, kind="stable")
        live, group = live[by], key[by]
        order[slots] = live

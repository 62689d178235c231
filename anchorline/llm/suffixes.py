"""Suffix arrays by induced sorting, one bucket of first bytes at a time, in numpy.

The text is a list of strings. Each is closed by a separator that is smaller than every byte; separators are ordered
by place, so no two suffixes are equal. Within a bucket the induced suffixes come in rounds: a round is the list of
suffixes that the previous round induces into the same bucket, so the number of rounds is the longest run of a byte.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def smaller_types(codes: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last, a separator, counts as smaller than its end."""
    n = len(codes)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(codes[1:].astype(np.int64) - codes[:-1])
    step[-1] = 1
    place = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(place[::-1])[::-1]
    return step[decides] > 0


def rank_in_bucket(dest: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each item, the number of earlier items of its bucket."""
    order = np.argsort(dest, kind="stable")
    first = np.cumsum(counts) - counts
    rank = np.empty(len(dest), np.int64)
    rank[order] = np.arange(len(dest)) - np.repeat(first, counts)
    return rank


class Inducer:
    """Induces the order of all suffixes from that of the leftmost-smaller ones."""

    def __init__(self, bucket: np.ndarray, smaller: np.ndarray):
        self.bucket, self.smaller = bucket, smaller
        self.sizes = np.bincount(bucket, minlength=257)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes

    def _push(self, out: np.ndarray, at: np.ndarray, items: np.ndarray, sign: int) -> None:
        dest = self.bucket[items]
        counts = np.bincount(dest, minlength=257)
        rank = rank_in_bucket(dest, counts)
        out[at[dest] + sign * rank] = items
        at += sign * counts

    def run(self, leftmost: np.ndarray) -> np.ndarray:
        """``leftmost``: leftmost-smaller suffixes, within each bucket in their order."""
        n = len(self.bucket)
        larger_part = np.full(n, -1, np.int64)
        at = self.begins.copy()
        by_bucket = leftmost[np.argsort(self.bucket[leftmost], kind="stable")]
        left_ends = np.cumsum(np.bincount(self.bucket[leftmost], minlength=257))
        for c in np.flatnonzero(self.sizes):
            rounds = []
            begin = self.begins[c]
            fresh = larger_part[begin : at[c]]
            while len(fresh):
                rounds.append(fresh)
                before = fresh[fresh > 0] - 1
                same = before[(self.bucket[before] == c) & ~self.smaller[before]]
                larger_part[at[c] : at[c] + len(same)] = same
                at[c] += len(same)
                fresh = same
            rounds.append(by_bucket[left_ends[c - 1] if c else 0 : left_ends[c]])
            before = np.concatenate(rounds)
            before = before[before > 0] - 1
            beyond = before[self.bucket[before] > c]
            if len(beyond):
                self._push(larger_part, at, beyond, 1)
        out = larger_part
        larger_end = at
        # separators keep the order of their places
        back = self.ends - 1
        out[self.begins[0] : self.ends[0]] = np.flatnonzero(self.bucket == 0)
        for c in np.flatnonzero(self.sizes)[::-1]:
            if c == 0:
                break
            rounds = []
            fresh = out[back[c] + 1 : self.ends[c]][::-1]
            while len(fresh):
                rounds.append(fresh)
                before = fresh[fresh > 0] - 1
                same = before[(self.bucket[before] == c) & self.smaller[before]]
                out[back[c] - len(same) + 1 : back[c] + 1] = same[::-1]
                back[c] -= len(same)
                fresh = same
            rounds.append(out[self.begins[c] : larger_end[c]][::-1])
            before = np.concatenate(rounds)
            before = before[before > 0] - 1
            beyond = before[(self.bucket[before] < c) & (self.bucket[before] > 0) & self.smaller[before]]
            if len(beyond):
                self._push(out, back, beyond, -1)
        return out


def order_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: each level of the recursion names pairs of neighbours, which
    doubles the length that is compared, and goes on only where names are still shared."""
    n, reach = len(names), 1
    rank = names.astype(np.int64)
    while True:
        counts = np.bincount(rank)
        tied = np.flatnonzero(counts[rank] > 1)
        if not len(tied):
            return np.argsort(rank, kind="stable")
        follow = np.zeros(len(tied), np.int64)
        inside = tied + reach < n
        follow[inside] = rank[tied[inside] + reach] + 1
        order = np.lexsort((follow, rank[tied]))
        tied, follow = tied[order], follow[order]
        # a rank is the number of smaller suffixes, so groups keep their place while they are split
        rank = (np.cumsum(counts) - counts)[rank]
        group = rank[tied]
        place = np.arange(len(tied))
        first = np.ones(len(tied), bool)
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= follow[1:] != follow[:-1]
        rank[tied] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        reach *= 2


def suffix_array(data: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``data`` (bytes); ``separator`` marks the closing places, the last one included."""
    bucket = np.where(separator, 0, data.astype(np.int16) + 1).astype(np.int16)
    closed = np.cumsum(separator)
    codes = np.where(separator, closed, data.astype(np.int64) + closed[-1] + 1)
    smaller = smaller_types(codes)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    inducer = Inducer(bucket, smaller)
    if not len(leftmost):
        return inducer.run(leftmost)
    found = inducer.run(leftmost[np.argsort(codes[leftmost], kind="stable")])
    is_leftmost = np.zeros(len(data), bool)
    is_leftmost[leftmost] = True
    found = found[is_leftmost[found]]
    # name the substrings between neighbours: equal ones share a name
    after = np.append(leftmost[1:], len(data) - 1)
    size = np.zeros(len(data), np.int64)
    size[leftmost] = after - leftmost + 1
    a, b = found[:-1], found[1:]
    same = size[a] == size[b]
    live = np.flatnonzero(same)
    t = 0
    while len(live):
        equal = codes[a[live] + t] == codes[b[live] + t]
        same[live[~equal]] = False
        t += 1
        live = live[equal & (t < size[a[live]])]
    names_at = np.zeros(len(data), np.int64)
    names_at[found] = np.concatenate([[0], np.cumsum(~same)])
    return inducer.run(leftmost[order_names(names_at[leftmost])])


def common_prefixes(data: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray, cap: int) -> np.ndarray:
    """Permuted common prefixes, at most ``cap``: for the places first, first + 1, .. of each string, the length that
    the suffix shares with its predecessor in the suffix array.

    A prefix is at most one shorter than that of the place before, so the comparison goes on where it stood; all
    strings advance together, eight bytes at a time. ``data`` must be followed by ``cap + 8`` spare bytes. Returns one
    value per place, string after string.
    """
    previous = np.full(len(data), -1, np.int64)
    previous[order[1:]] = order[:-1]
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    starts = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    length = np.zeros(len(first), np.int64)
    alive = np.arange(len(first))
    for step in range(int(count.max()) if len(count) else 0):
        alive = alive[count[alive] > step]
        place = first[alive] + step
        other = previous[place]
        size = np.maximum(length[alive] - 1, 0)
        size[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (size < cap))
        while len(live):
            unequal = windows[place[live] + size[live]] != windows[other[live] + size[live]]
            shared = np.where(unequal.any(axis=1), unequal.argmax(axis=1), 8)
            size[live] += shared
            live = live[(shared == 8) & (size[live] < cap)]
        length[alive] = np.minimum(size, cap)
        out[starts[alive] + step] = length[alive]
    return out

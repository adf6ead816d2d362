"""Deep-shallow suffix sorting to a given depth, on arrays.

Shallow part: multikey quicksort with characters of eight bytes; each level sorts the runs that were equal so far and
hands on those that still are.  Deep part: the suffixes of a run share a long prefix, so they are put into a blind trie.
Its spine is the run's first suffix; a suffix needs one comparison with it, which gives the branching depth and byte, and
those alone give the order.  Suffixes that branch off at the same place by the same byte form a subtrie with its own spine.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number in byte order; ``raw`` must end with seven bytes of padding."""
    return np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))


def leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        empty = x >> np.uint64(64 - shift) == 0
        out += np.where(empty, shift // 8, 0)
        x = np.where(empty, x << np.uint64(shift), x)
    return out


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each row belongs to, from 0."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def deep_shallow(raw: np.ndarray, starts: np.ndarray, bucket: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (bucket, first ``depth`` bytes), and which of them have an equal one in their bucket.

    All suffixes must have ``depth`` bytes within ``raw``, which must end with seven more; depth is a multiple of 8.
    """
    at = eight_bytes(raw)
    n = len(starts)
    shallow = min(shallow, depth)
    order = np.argsort(bucket, kind="stable")
    equal = np.zeros(n, bool)
    slots = np.arange(n)  # places in the order that are not settled
    run = runs_of(bucket[order]) if n else np.zeros(0, np.int64)

    def hand_on(slots, run):
        size = np.bincount(run, minlength=int(run[-1]) + 1 if len(run) else 0)
        more = size[run] > 1
        return slots[more], run[more]

    slots, run = hand_on(slots, run)
    for d in range(0, shallow, 8):
        if not len(slots):
            return order, equal
        mine = order[slots]
        key = at[starts[mine] + d].astype(np.uint64)
        rank = np.lexsort((key, run))
        order[slots] = mine[rank]
        slots, run = hand_on(slots, runs_of(run[rank], key[rank]))
    if shallow == depth:
        equal[order[slots]] = True
        return order, equal
    from_depth = np.full(len(slots), shallow)
    while len(slots):
        mine = order[slots]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        spine = starts[mine[first]][runs_of(run)]
        own = starts[mine]
        common = np.full(len(slots), depth)
        side, byte = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        reach = (from_depth // 8) * 8
        open_ = np.flatnonzero(reach < depth)
        while len(open_):
            a, b = at[own[open_] + reach[open_]].astype(np.uint64), at[spine[open_] + reach[open_]].astype(np.uint64)
            other = a != b
            off = open_[other]
            zero = leading_zero_bytes(a[other] ^ b[other])
            common[off] = reach[off] + zero
            side[off] = np.where(a[other] < b[other], -1, 1)
            byte[off] = (a[other] >> (np.uint64(56) - zero.astype(np.uint64) * np.uint64(8))) & np.uint64(255)
            open_ = open_[~other]
            reach[open_] += 8
            open_ = open_[reach[open_] < depth]
        # Smaller suffixes: early branches first.  Larger ones: late branches first.
        along = np.where(side < 0, common, -common)
        rank = np.lexsort((byte, along, side, run))
        order[slots] = mine[rank]
        side, common = side[rank], common[rank]
        new = runs_of(run[rank], side, along[rank], byte[rank])
        size = np.bincount(new)
        equal[order[slots[(side == 0) & (size[new] > 1)]]] = True
        more = (side != 0) & (size[new] > 1)
        slots, run, from_depth = slots[more], new[more], common[more] + 1
    return order, equal

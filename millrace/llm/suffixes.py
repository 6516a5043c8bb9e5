"""Suffix arrays by Larsson-Sadakane refinement, and Kasai's common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

from .rolling import ranges

U = np.uint64
BITS = 21
#: A place, a rank and the rank of a later place share one 64-bit word.
LARGEST = (1 << BITS) - 2
MASK = U((1 << BITS) - 1)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of data (at most LARGEST bytes) in the order of their first ``depth`` bytes.

    The first sort takes as many symbols as fit a word. Each refinement then sorts
    only places that still share a rank, by the rank of the place that is as far
    ahead as ranks are already known, and so doubles the known length.
    """
    n = len(data)
    present = np.bincount(data, minlength=256) > 0
    code = np.cumsum(present).astype(U)  # order-preserving, 0 is left for the end
    bits = max(1, int(code[-1]).bit_length())
    known = min((63 - BITS) // bits, depth)
    symbols = np.zeros(n + known, U)
    symbols[:n] = code[data]
    key = np.zeros(n, U)
    for i in range(known):
        key = (key << U(bits)) | symbols[i : i + n]
    packed = np.sort((key << U(BITS)) | np.arange(n, dtype=U))
    order = (packed & MASK).astype(np.int64)
    group = packed >> U(BITS)
    head = np.concatenate(([True], group[1:] != group[:-1]))
    slot = np.arange(n)
    rank = np.zeros(n + depth + 1, U)  # 0: past the end
    tied_rank = np.maximum.accumulate(np.where(head, slot, 0))
    rank[order] = tied_rank.astype(U) + U(1)
    tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
    while known < depth and len(tied):
        ahead = min(known, depth - known)
        place = order[tied]
        packed = np.sort((rank[place] << U(2 * BITS)) | (rank[place + ahead] << U(BITS)) | place.astype(U))
        order[tied] = (packed & MASK).astype(np.int64)
        group = packed >> U(BITS)
        head = np.concatenate(([True], group[1:] != group[:-1]))
        first = np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))
        rank[order[tied]] = tied[first].astype(U) + U(1)
        tied = tied[~(head & np.concatenate((head[1:], [True])))]
        known += ahead
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of the places, up to depth, how much it shares with the one before it in order.

    The places are runs of counts from starts, answered in that order. Kasai's walk
    in text order, where the length falls by one at most from place to place, takes
    all runs side by side and compares eight bytes at a time. After a tie at full
    depth this holds only if the next places still stand in that order.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    slot = np.empty(n + 1, np.int64)
    slot[order], slot[n] = np.arange(n), -1
    padded = np.zeros(n + depth + 16, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + depth + 8,), "<u8", padded, strides=(1,))
    by_count = np.argsort(-counts, kind="stable")
    starts, lasting = starts[by_count], counts[by_count]
    answer_at = (np.cumsum(counts) - counts)[by_count]
    found = np.zeros(int(counts.sum()), np.int64)
    length = np.zeros(len(starts), np.int64)
    for step in range(int(lasting[0]) if len(lasting) else 0):
        lanes = np.searchsorted(-lasting, -step)  # those with more than step places
        place = starts[:lanes] + step
        length = np.maximum(length[:lanes] - 1, 0)
        if step:
            length[(length == depth - 1) & (slot[before[place - 1] + 1] > slot[place])] = 0
        other = before[place]
        length[other < 0] = 0
        active = np.flatnonzero((other >= 0) & (length < depth))
        while len(active):
            a, b, had = place[active], other[active], length[active]
            differ = eight[a + had] ^ eight[b + had]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + U(1))) - U(1)) >> 3)
            most = np.minimum(depth, n - np.maximum(a, b))
            length[active] = np.minimum(had + same, most)
            active = active[(same == 8) & (had + 8 < most)]
        found[answer_at[:lanes] + step] = length
    return found


def classes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the runs in suffix order, and numbers that equal stretches of depth bytes share.

    A run must be all places of a stretch of text from which depth bytes can be
    read before its separator; then nothing else stands between equal ones.
    """
    order = suffix_array(data, depth)
    shared = np.full(len(data), -1, np.int64)
    shared[ranges(starts, counts)] = common_prefixes(data, order, depth, starts, counts)
    places = order[shared[order] >= 0]
    return places, np.cumsum(shared[places] < depth)

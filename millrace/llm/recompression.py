"""Run-length grammars by recompression, and common extensions of places in a sequence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass
class Level:
    """One phase: symbols, and how they are grouped to the symbols of the next level.

    ``ahead`` and ``behind`` count the equal symbols from a place to the end and to
    the start of its block; they are None where the phase compressed pairs.
    """

    symbols: np.ndarray
    group: np.ndarray
    first: np.ndarray
    last: np.ndarray
    ahead: np.ndarray | None
    behind: np.ndarray | None


@dataclass
class Grammar:
    levels: list[Level]


def number(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal codes by equal numbers from 0, and how many there are."""
    names, distinct = pd.factorize(codes)
    return names, len(distinct)


def level(symbols: np.ndarray, first: np.ndarray, blocks: bool) -> Level:
    count = np.diff(np.append(first, len(symbols)))
    group = np.repeat(np.arange(len(first), dtype=np.int32), count)
    last = first + count - 1
    at = np.arange(len(symbols))
    ahead = (last[group] - at + 1).astype(np.int32) if blocks else None
    behind = (at - first[group] + 1).astype(np.int32) if blocks else None
    return Level(symbols.astype(np.int32), group, first.astype(np.int32), last.astype(np.int32), ahead, behind)


def compress(codes: np.ndarray) -> Grammar:
    """The grammar of a sequence whose first and last code occur once.

    Block compression gives every maximal run of one symbol a name for symbol and
    length. Pair compression parts the symbols into left and right ones and names
    each left symbol that a right one follows together with it. Equal stretches are
    so parsed alike but for their edges. The phases alternate until all symbols
    differ, and each pair of phases drops about a quarter of the sequence or more.
    """
    symbols, kinds = number(codes)
    levels, turn = [], 0
    while kinds < len(symbols):
        new = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        if not new.all():
            first = np.flatnonzero(new)
            made = level(symbols, first, True)
            count = made.last - made.first + 1
            symbols, kinds = number(symbols[first] * (int(count.max()) + 1) + count)
            levels.append(made)
        right = np.random.default_rng(turn).integers(0, 2, kinds).astype(bool)[symbols]
        turn += 1
        if np.count_nonzero(right[:-1] & ~right[1:]) > np.count_nonzero(~right[:-1] & right[1:]):
            right = ~right
        second = np.concatenate(([False], ~right[:-1] & right[1:]))
        if kinds < len(symbols) and second.any():
            first = np.flatnonzero(~second)
            paired = np.append(second[1:], False)[first]
            made = level(symbols, first, False)
            symbols, kinds = number(symbols[first] * (kinds + 1) + np.where(paired, symbols[made.last] + 1, 0))
            levels.append(made)
    return Grammar(levels)


def extend(grammar: Grammar, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from the different places x and y on are equal, forward (step 1) or back (step -1).

    All queries climb side by side. At each level they take the equal symbols up to
    the edge of their groups, at most one block or one half of a pair, and go on
    with the groups. Where symbols differ they go down again through the outermost
    parts, and each level again gives at most one block or symbol.
    """
    start, x, y = x, x.copy(), y.copy()
    parts = [(l, *((l.first, l.ahead) if step > 0 else (l.last, l.behind))) for l in grammar.levels]
    climbing, stopped = np.arange(len(x)), []
    for l, edge, rest in parts:
        a, b = x[climbing], y[climbing]
        same = l.symbols[a] == l.symbols[b]
        stopped.append(climbing[~same])
        climbing, a, b = climbing[same], a[same], b[same]
        inside = (edge[l.group[a]] != a) | (edge[l.group[b]] != b)
        taken = inside.astype(np.int64) if rest is None else np.where(inside, np.minimum(rest[a], rest[b]), 0)
        uneven = np.zeros(len(a), bool) if rest is None else inside & (rest[a] != rest[b])
        a, b = a + step * taken, b + step * taken
        x[climbing[uneven]], y[climbing[uneven]] = a[uneven], b[uneven]
        stopped[-1] = np.concatenate((stopped[-1], climbing[uneven]))
        climbing = climbing[~uneven]
        x[climbing], y[climbing] = l.group[a[~uneven]], l.group[b[~uneven]]
    descending = climbing
    for (l, edge, rest), joining in zip(parts[::-1], stopped[::-1]):
        a, b = edge[x[descending]].astype(np.int64), edge[y[descending]].astype(np.int64)
        same = l.symbols[a] == l.symbols[b]
        taken = same.astype(np.int64) if rest is None else np.where(same, np.minimum(rest[a], rest[b]), 0)
        x[descending], y[descending] = a + step * taken, b + step * taken
        descending = np.concatenate((descending, joining))
    return (x - start) * step

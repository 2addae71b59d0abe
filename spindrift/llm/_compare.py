"""Sets of 64-bit tokens compared with each other inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._text import U64

#: A token of at most so many sets is counted where it stands; others by products of 0/1 matrices.
RARE = 24
#: Columns of such a matrix; cells of the result that are held at once.
COLUMNS, CELLS = 512, 1 << 20


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    return np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sizes of the intersections of the sets numbered ``left`` with those numbered ``right``: some of left at
    a time, with a matrix of numbers.

    Sets are sorted. The work grows with the tokens that sets share, not with all tokens of all pairs.
    """
    if len(left) * len(right) <= 16:
        yield left, np.array([[overlap(sets[x], sets[y]) for y in right] for x in left], np.int64).reshape(len(left), len(right))
        return
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    first = np.r_[0, np.cumsum(size)]
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    holders = np.diff(np.r_[begin, len(tokens)])
    names = np.empty(len(tokens), np.int64)
    names[order] = np.cumsum(new) - 1
    # The column in the result of the set that each token, in order, belongs to; -1 for those of left only.
    column = np.full(n, -1)
    column[right] = np.arange(len(right))
    column = column[np.repeat(np.arange(n), size)[order]]
    common = np.cumsum(holders > RARE) - 1
    step = max(1, CELLS // max(1, len(right)))
    for k in range(0, len(left), step):
        part = left[k : k + step]
        own = names[_ranges(first[part], size[part])]
        row = np.repeat(np.arange(len(part)), size[part])
        rare = holders[own] <= RARE
        there = column[_ranges(begin[own[rare]], holders[own[rare]])]
        code = np.repeat(row[rare], holders[own[rare]]) * len(right) + there
        out = np.bincount(code[there >= 0], minlength=len(part) * len(right)).astype(float).reshape(len(part), len(right))
        own, row = common[own[~rare]], row[~rare]
        often = np.flatnonzero(holders > RARE)
        for c in range(0, len(often), COLUMNS):
            some = often[c : c + COLUMNS]
            here = (own >= c) & (own < c + len(some))
            a, b = np.zeros((len(part), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
            a[row[here], own[here] - c] = 1
            to, of = column[_ranges(begin[some], holders[some])], np.repeat(np.arange(len(some)), holders[some])
            b[to[to >= 0], of[to >= 0]] = 1
            # Products of so few columns of 0 and 1 add up exactly.
            out += a @ b.T
        yield part, np.rint(out).astype(np.int64)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similar: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which of ``left`` link with which of ``right``: some of left at a time, with a matrix of truth values."""
    sizes = np.array([len(x) for x in sets], np.int64)
    for part, both in intersections(sets, left, right):
        union = sizes[part][:, None] + sizes[right][None, :] - both
        yield part, (both > 0) & (similar[1] * both >= similar[0] * union)


def spanning(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, root: np.ndarray, similar: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Links between sets, fewer than there are sets, that join all that the links of left with right join.
    root: sets with one value are joined already."""
    root = root.copy()
    a, b = [], []
    for part, links in linked(sets, left, right, similar):
        for x, to in zip(part.tolist(), links, strict=True):
            there = right[to]
            new = root[there] != root[x]
            if new.any():
                roots, first = np.unique(root[there[new]], return_index=True)
                a += [x] * len(roots)
                b += there[new][first].tolist()
                root[np.isin(root, roots)] = root[x]
    return a, b

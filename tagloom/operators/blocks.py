"""Two blocks of rows against each other, as matrix products: no list of all pairs. NumPy only; `similarity` deals the blocks out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Cosines count in millionths; one that is not a number is above all others, as Spark and DuckDB sort it.
NAN = 2_000_000
#: Cells of a product that are held at once.
CELLS = 1 << 19


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (of length 0 stay), and the squared lengths, summed in order."""
    with np.errstate(all="ignore"):
        n2 = np.cumsum(v * v, axis=1)[:, -1] if v.shape[1] else np.zeros(len(v))
        n = np.sqrt(n2)
        return np.where((n == 0)[:, None], v, v / n[:, None]), n2


def millionths(va: np.ndarray, vb: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, cosines of rows of va from there with all of vb in whole millionths), a few rows at a time. Where the product
    is too near a half to tell, dot product and lengths are summed in order, as the plain formula does."""
    ua, na = _unit(va)
    ub, nb = _unit(vb)
    columns_a, columns_b = np.ascontiguousarray(va.T), np.ascontiguousarray(vb.T)
    safe, step = 0.5 - (va.shape[1] + 16) * 1e-9, max(1, CELLS // max(1, len(vb)))
    for first in range(0, len(va), step):
        with np.errstate(all="ignore"):
            x = ua[first : first + step] @ ub.T
            x *= 1e6
        r = np.rint(x)
        i, j = np.nonzero(np.abs(x - r) > safe)
        if len(i):
            dot = np.zeros(len(i))
            for a, b in zip(columns_a, columns_b, strict=True):
                dot += a[first + i] * b[j]
            y = dot / np.sqrt(na[first + i] * nb[j]) * 1e6
            whole = np.trunc(y)
            r[i, j] = whole + np.sign(y) * (np.abs(y - whole) >= 0.5)
        np.clip(r, -1e6, 1e6, out=r)
        if np.isnan(r).any():
            r[np.isnan(r)] = NAN
        yield first, r


def most_similar(va: np.ndarray, vb: np.ndarray, rank: np.ndarray, top: int, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of va, row of vb and millionths: for each row of va its `top` most similar rows of vb, ties by the least rank (below
    len(vb), each once). With `same`, a code for each row of either, rows of the same code are no partners."""
    rows, others, values = [], [], []
    wide = 1 << len(vb).bit_length()
    by_rank = np.argsort(rank)
    for first, r in millionths(va, vb[by_rank]):
        r *= wide
        r -= np.arange(len(vb))
        if same is not None:
            r[same[0][first : first + len(r), None] == same[1][by_rank]] = -np.inf
        each = np.arange(len(r))
        for _ in range(min(top, len(vb))):
            j = r.argmax(axis=1)
            best = r[each, j]
            hit = best > -np.inf
            rows.append(first + each[hit])
            others.append(by_rank[j[hit]])
            values.append(np.ceil(best[hit] / wide).astype(np.int64))
            r[each, j] = -np.inf
    return tuple(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (rows, others, values))


def _least(least: float) -> int:
    """The fewest millionths that are `least` or more."""
    t = math.ceil(least * 1e6) - 1
    while t / 1e6 < least:
        t += 1
    return t


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label: of each row the first row of its group; groups that a link (i, j) joins become one."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def spanning_links(va: np.ndarray, vb: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same rows as all pairs of at least this cosine: between rows of va and vb (numbered on after va), or
    within va where vb is None. Fewer than rows, none at more than 17 links, so that copies do not make all pairs."""
    own = vb is None
    label, fewest = np.arange(len(va) + (0 if own else len(vb))), _least(least)
    for first, r in millionths(va, va if own else vb):
        i, j = np.nonzero(r >= fewest)
        label = _join(label, first + i, j + (0 if own else len(va)))
    order = np.argsort(label, kind="stable")
    start = np.searchsorted(label[order], label[order])
    place = np.arange(len(order)) - start
    child = place > 0
    return order[(start + (place - 1) // 16)[child]], order[child]


#: What one listed pair costs against one cell of a dense column.
LISTED = 512


def shared_counts(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], shape: tuple[int, int], patterns: int, largest: int) -> np.ndarray:
    """For rows of two blocks, the sum over patterns of the lesser count. a, b: row, pattern and count of each entry, each row and
    pattern once; largest: the largest sum of a row. Sums are whole numbers that the float type holds exactly.

    The lesser of two counts is the number of levels that both reach, so a pattern that many rows have is a few columns of a
    matrix product; a pattern with few rows, or with too many levels for that, has its pairs listed."""
    kind = np.float32 if largest < 1 << 24 else np.float64
    out = np.zeros(shape, kind)
    a, b = (tuple(c[np.argsort(x[1], kind="stable")] for c in x) for x in (a, b))
    na, nb = np.bincount(a[1], minlength=patterns), np.bincount(b[1], minlength=patterns)
    top_a, top_b = np.zeros(patterns, np.int64), np.zeros(patterns, np.int64)
    np.maximum.at(top_a, a[1], a[2])
    np.maximum.at(top_b, b[1], b[2])
    levels = np.unique(np.stack([np.concatenate([a[1], b[1]]).astype(np.int64), np.concatenate([a[2], b[2]]).astype(np.int64)]), axis=1)
    levels = levels[:, levels[1] <= np.minimum(top_a, top_b)[levels[0]]]
    # the least of the two largest counts is a level of its own, so no part of a lesser count is lost
    dense = na * nb * LISTED > np.bincount(levels[0], minlength=patterns) * (shape[0] * shape[1])
    levels = levels[:, dense[levels[0]]]
    first = np.r_[True, levels[0][1:] != levels[0][:-1]][: levels.shape[1]]
    gap = np.where(first, levels[1], np.diff(levels[1], prepend=0)).astype(kind)
    for s in range(0, levels.shape[1], 2048):
        p, least = levels[:, s : s + 2048]
        fa, fb = _reached(a, p, least, shape[0], kind), _reached(b, p, least, shape[1], kind)
        fa *= gap[s : s + 2048]
        for r in range(0, shape[0], 512):
            out[r : r + 512] += fa[r : r + 512] @ fb.T
    _list(a, b, na, nb, dense, out)
    return out


def _reached(x: tuple[np.ndarray, np.ndarray, np.ndarray], p: np.ndarray, least: np.ndarray, rows: int, kind: type) -> np.ndarray:
    """rows x levels: 1 where the row's count of the level's pattern reaches it. p is sorted, and x by pattern."""
    f = np.zeros((rows, len(p)), kind)
    start, end = np.searchsorted(x[1], p), np.searchsorted(x[1], p, side="right")
    for k, (s, e) in enumerate(zip(start, end, strict=True)):
        f[x[0][s:e][x[2][s:e] >= least[k]], k] = 1
    return f


def _list(a: tuple, b: tuple, na: np.ndarray, nb: np.ndarray, dense: np.ndarray, out: np.ndarray) -> None:
    """Adds the lesser counts of patterns that are not dense, pair by pair, a million pairs at a time."""
    keep = ~dense[a[1]] & (nb[a[1]] > 0)
    row, pattern, count = (c[keep] for c in a)
    times, start = nb[pattern], (np.cumsum(nb) - nb)[pattern]
    ends, s = np.cumsum(times), 0
    while s < len(row):
        e = max(s + 1, int(np.searchsorted(ends, ends[s] - times[s] + (1 << 20), side="right")))
        t = times[s:e]
        at = np.repeat(start[s:e] - (np.cumsum(t) - t), t) + np.arange(t.sum())
        np.add.at(out.reshape(-1), np.repeat(row[s:e].astype(np.int64) * out.shape[1], t) + b[0][at], np.minimum(np.repeat(count[s:e], t), b[2][at]).astype(out.dtype))
        s = e


def distances(shared: np.ndarray, most: np.ndarray) -> np.ndarray:
    """1 - shared / most to six places, halves up, in the steps of the SQL."""
    y = (1 - shared.astype(np.float64) / most) * 1e6
    whole = np.trunc(y)
    return (whole + (y - whole >= 0.5)) / 1e6

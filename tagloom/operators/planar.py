"""Searches among the points of one tile in numpy: results as by comparing all pairs, work near-linear for points that are spread."""

from __future__ import annotations

import numpy as np


def _expand(start: np.ndarray, stop: np.ndarray, most: int = 4_000_000):
    """Chunks (i, j) of all j from start[i] to stop[i]."""
    n = np.maximum(stop - start, 0)
    at = np.flatnonzero(n)
    total = np.cumsum(n[at])
    first = 0
    while first < len(at):
        base = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, base + most, "right")))
        part = at[first:last]
        i = np.repeat(part, n[part])
        yield i, np.arange(len(i)) - np.repeat(total[first:last] - n[part] - base, n[part]) + start[i]
        first = last


def _first(lo: np.ndarray, hi: np.ndarray, test) -> np.ndarray:
    """The first place from lo to hi (itself left out) where a monotone test holds, else hi."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        ok = test(open_, mid)
        hi[open_[ok]] = mid[ok]
        lo[open_[~ok]] = mid[~ok] + 1
    return lo


def nearest_in_window(lx, ly, rx, ry, rank, reach):
    """(index or -1, dy) of the point nearest in y with |dx| and |dy| under reach, ties by rank: rows of equal y from near to
    far, in each the least rank of a range of x."""
    best, dy = np.full(len(lx), -1), np.zeros(len(lx))
    if not len(lx) or not len(rx):
        return best, dy
    o = np.lexsort((rx, ry))
    x, y, rk = rx[o], ry[o], rank[o]
    back = np.empty(len(o), np.int64)
    back[rank] = np.arange(len(o))
    rows, start = np.unique(y, return_index=True)
    stop = np.append(start[1:], len(y))
    least = [rk]
    while 2 ** len(least) <= int((stop - start).max()):
        half, step = least[-1], 2 ** (len(least) - 1)
        least.append(np.minimum(half, np.append(half[step:], np.full(min(step, len(half)), len(rk)))))
    least = np.stack(least)
    up = np.searchsorted(rows, ly)
    down, active = up - 1, np.arange(len(lx))
    while active.size:
        u, d = up[active], down[active]
        du = np.where(u < len(rows), np.abs(ly[active] - rows[np.minimum(u, len(rows) - 1)]), np.inf)
        dd = np.where(d >= 0, np.abs(ly[active] - rows[np.maximum(d, 0)]), np.inf)
        gap = np.minimum(du, dd)
        keep = gap < reach[1]
        active, u, d, du, dd, gap = active[keep], u[keep], d[keep], du[keep], dd[keep], gap[keep]
        found = np.full(len(active), len(rk))
        for row, mine in ((u, du == gap), (d, dd == gap)):
            m = np.flatnonzero(mine)
            at, s, e = lx[active[m]], start[row[m]], stop[row[m]]
            i = _first(s, e, lambda k, mid, at=at: at[k] - x[mid] < reach[0])
            j = _first(i, e, lambda k, mid, at=at: x[mid] - at[k] >= reach[0])
            h = np.flatnonzero(j > i)
            level = np.frexp((j - i)[h].astype(float))[1] - 1
            found[m[h]] = np.minimum(found[m[h]], np.minimum(least[level, i[h]], least[level, j[h] - 2**level]))
        up[active[du == gap]] += 1
        down[active[dd == gap]] -= 1
        hit = found < len(rk)
        best[active[hit]], dy[active[hit]] = back[found[hit]], gap[hit]
        active = active[~hit]
    return best, dy


def nearest_in_radius(lx, ly, rx, ry, rank, radius):
    """Index or -1 of the nearest point no further than radius, ties by rank: rings of cells around each, points that coincide once."""
    best, near = np.full(len(lx), -1), np.full(len(lx), np.inf)
    if not len(lx) or not len(rx):
        return best
    o = np.lexsort((rank, ry, rx))
    o = o[np.append(True, (np.diff(rx[o]) != 0) | (np.diff(ry[o]) != 0))]
    wide, high = np.ptp(rx[o]), np.ptp(ry[o])
    side = max(min(np.sqrt(2 * wide * high / len(o)) or 2 * max(wide, high) / len(o), radius), radius / 16) or 1.0
    cell = lambda x, y: (np.floor((x - rx[o].min()) / side).astype(np.int64), np.floor((y - ry[o].min()) / side).astype(np.int64))
    cx, cy = cell(rx[o], ry[o])
    tall = cy.max() + 1
    by_cell = np.argsort(cx * tall + cy, kind="stable")
    o = o[by_cell]
    cells, start = np.unique((cx * tall + cy)[by_cell], return_index=True)
    stop = np.append(start[1:], len(o))
    px, py = cell(lx, ly)
    active = np.arange(len(lx))
    for k in range(int(np.ceil(radius / side)) + 2):
        for a in range(-k, k + 1):
            for b in range(-k, k + 1) if abs(a) == k else sorted({-k, k}):
                row = py[active] + b
                want = (px[active] + a) * tall + row
                at = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
                ok = (cells[at] == want) & (row >= 0) & (row < tall)
                for i, j in _expand(np.where(ok, start[at], 0), np.where(ok, stop[at], 0)):
                    i, j = active[i], o[j]
                    d2 = (lx[i] - rx[j]) * (lx[i] - rx[j]) + (ly[i] - ry[j]) * (ly[i] - ry[j])
                    m = (d2 <= radius * radius) & (d2 <= near[i])
                    i, j, d2 = i[m], j[m], d2[m]
                    s = np.lexsort((rank[j], d2, i))
                    i, j, d2 = i[s], j[s], d2[s]
                    one = np.append(True, np.diff(i) != 0)[: len(i)]
                    i, j, d2 = i[one], j[one], d2[one]
                    m = (d2 < near[i]) | (rank[j] < rank[best[i]])
                    best[i[m]], near[i[m]] = j[m], d2[m]
        # what is nearer than k sides has been seen
        active = active[~(near[active] < (k * side * (1 - 1e-6)) ** 2)]
        if not active.size:
            break
    return best


def count_in_radius(lx, ly, rx, ry, radius):
    """How many points lie within the radius of each: in narrow bands of y, what is surely inside by its place in x, and only the
    rim of the circle point by point."""
    n = np.zeros(len(lx), np.int64)
    if not len(lx) or not len(rx):
        return n
    slack = radius * 1e-9 + 1e-14 * max(np.abs(v).max() for v in (lx, ly, rx, ry))
    thick = radius / 32 or 1.0
    base = ry.min()
    band = np.floor((ry - base) / thick)
    o = np.lexsort((rx, band))
    x, y = rx[o], ry[o]
    bands, start = np.unique(band[o], return_index=True)
    stop = np.append(start[1:], len(o))
    low, top = np.minimum.reduceat(y, start), np.maximum.reduceat(y, start)
    mine = np.floor((ly - base) / thick)
    order = np.argsort(mine, kind="stable")
    own, own_start = np.unique(mine[order], return_index=True)
    for g, s, e in zip(own, own_start, np.append(own_start[1:], len(order))):
        p = order[s:e]
        ax, ay = lx[p], ly[p]
        for b in range(int(np.searchsorted(bands, g - 34)), int(np.searchsorted(bands, g + 34, "right"))):
            xs, off = x[start[b] : stop[b]], start[b]
            far = np.maximum(np.abs(ay - low[b]), np.abs(ay - top[b]))
            close = np.maximum(0, np.maximum(low[b] - ay, ay - top[b]))
            out = np.where(close <= radius + slack, np.sqrt(np.maximum(0, (radius + slack) ** 2 - close**2)) + slack, -np.inf)
            sure = np.where(far < radius - slack, np.sqrt(np.maximum(0, (radius - slack) ** 2 - far**2)) - slack, -1.0)
            i0, i1 = np.searchsorted(xs, ax - out), np.searchsorted(xs, ax + out, "right")
            j0, j1 = np.searchsorted(xs, ax - sure), np.searchsorted(xs, ax + sure, "right")
            j0, j1 = np.where(sure > 0, j0, i0), np.where(sure > 0, j1, i0)
            n[p] += j1 - j0
            for lo, hi in ((i0, j0), (j1, i1)):
                for i, j in _expand(lo, hi):
                    dx, dy = ax[i] - xs[j], ay[i] - y[off + j]
                    n[p] += np.bincount(i[dx * dx + dy * dy <= radius * radius], minlength=len(p))
    return n


def count_same(lx, ly, lk, rx, ry, rk, radius):
    """How many points of the same key lie within the radius of each; keys are numbers."""
    o = np.argsort(rk, kind="stable")
    n = np.zeros(len(lx), np.int64)
    for i, j in _expand(np.searchsorted(rk[o], lk), np.searchsorted(rk[o], lk, "right")):
        j = o[j]
        n += np.bincount(i[(lx[i] - rx[j]) * (lx[i] - rx[j]) + (ly[i] - ry[j]) * (ly[i] - ry[j]) <= radius * radius], minlength=len(lx))
    return n

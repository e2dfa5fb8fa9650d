"""Merged outlines of many small groups of polygons at once, for Arrow batches.

The steps are those of ``operators.arrangement``, with the same rules and tolerances: sides are split where they meet, points
within the snap distance become one, pieces are kept by cover, and rings are put in order by pointer doubling.  Here the
sides of many groups are columns of one numpy array; groups never meet, and the memory is that of about ``kernels.BLOCK``
pairs of sides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parcelgrid.functions.kernels import BLOCK, Lists, _inside, _next, _numbers, _segments

_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: Points nearer than this are one, in metres.
SNAP = 1e-6
PARTS = pa.list_(pa.struct([("ring", _RING), ("holes", pa.list_(_RING)), ("area_sqm", pa.float64())]))


class Rings:
    """Points of rings one after the other: ring ``k`` has ``x[at[k]:at[k + 1]]``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray):
        self.x, self.y, self.n = x, y, n
        self.at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def of(self, rings: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[rings][:, None] + np.arange(n)
        return self.x[at], self.y[at]

    def take(self, rings: np.ndarray) -> Rings:
        n = self.n[rings]
        at = np.repeat(self.at[rings] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Rings(self.x[at], self.y[at], n)

    def contain(self, rings: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Pairs of a ring and a point strictly in it."""
        out = np.zeros(len(rings), bool)
        for n in np.unique(self.n[rings]):
            mine = np.flatnonzero(self.n[rings] == n)
            step = max(1, BLOCK // max(1, int(n)))
            for i in range(0, len(mine), step):
                k = mine[i:i + step]
                out[k] = _inside(_segments(*self.of(rings[k], int(n))), px[k, None], py[k, None], boundary=False)[:, 0]
        return out


def _pairs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row ``k`` with each of the ``count[k]`` numbers from ``first[k]`` on."""
    row = np.repeat(np.arange(len(count)), count)
    start = np.cumsum(count) - count
    return row, np.arange(len(row)) - start[row] + first[row]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _split_points(x1, y1, x2, y2, i, j, tol):
    """``side, px, py``: ends of every side, and the points where the sides ``i < j`` cross or touch."""
    lx, ly, w, h = np.minimum(x1, x2), np.minimum(y1, y2), np.abs(x2 - x1), np.abs(y2 - y1)
    dx = np.maximum(0.0, np.maximum(lx[i] - lx[j] - w[j], lx[j] - lx[i] - w[i]))
    dy = np.maximum(0.0, np.maximum(ly[i] - ly[j] - h[j], ly[j] - ly[i] - h[i]))
    near = np.sqrt(dx * dx + dy * dy) <= tol
    i, j = i[near], j[near]
    ax, ay, bx, by = x2[i] - x1[i], y2[i] - y1[i], x2[j] - x1[j], y2[j] - y1[j]
    ox, oy = x1[j] - x1[i], y1[j] - y1[i]
    det = ax * by - ay * bx
    some = det != 0
    safe = np.where(some, det, 1.0)
    t, u = (ox * by - oy * bx) / safe, (ox * ay - oy * ax) / safe
    meets = some & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    cx, cy = x1[i] + t * ax, y1[i] + t * ay
    placed = np.zeros(len(i), bool)
    # an end within reach of the crossing stands for it
    for ex, ey in ((x1[i], y1[i]), (x2[i], y2[i]), (x1[j], y1[j]), (x2[j], y2[j])):
        here = ~placed & (np.hypot(ex - cx, ey - cy) <= tol)
        cx, cy, placed = np.where(here, ex, cx), np.where(here, ey, cy), placed | here
    found = [(i, cx, cy, meets), (j, cx, cy, meets)]
    for own, other in ((i, j), (j, i)):
        sx, sy = x2[own] - x1[own], y2[own] - y1[own]
        for ex, ey in ((x1[other], y1[other]), (x2[other], y2[other])):
            k = np.clip(((ex - x1[own]) * sx + (ey - y1[own]) * sy) / (sx * sx + sy * sy), 0.0, 1.0)
            found.append((own, ex, ey, np.hypot(ex - (x1[own] + k * sx), ey - (y1[own] + k * sy)) <= tol))
    side, px, py = [np.arange(len(x1))] * 2, [x1, x2], [y1, y2]
    for s, ex, ey, there in found:
        new = there & ~((ex == x1[s]) & (ey == y1[s])) & ~((ex == x2[s]) & (ey == y2[s]))
        side.append(s[new]), px.append(ex[new]), py.append(ey[new])
    return np.concatenate(side), np.concatenate(px), np.concatenate(py)


def _nodes(group: np.ndarray, px: np.ndarray, py: np.ndarray, tol: float):
    """Node of each point, and group and place of the nodes in the order of ``(group, x, y)``.

    Points within ``tol`` of each other, and of those in turn, are the first of them.
    """
    order = np.lexsort((py, px, group))
    g, x, y = group[order], px[order], py[order]
    new = _starts(g, x, y)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    g, x, y = g[new], x[new], y[new]
    to = np.arange(len(g))
    # points of a chain of small steps in x, and within it in y, may be one
    step = _starts(g)
    step[1:] |= x[1:] - x[:-1] > tol
    chain = np.cumsum(step)
    by_y = np.lexsort((y, chain))
    step = _starts(chain[by_y])
    step[1:] |= y[by_y][1:] - y[by_y][:-1] > tol
    cluster = np.cumsum(step) - 1
    first, size = np.flatnonzero(step), np.bincount(cluster)
    for k in np.flatnonzero(size > 1):
        mine = sorted(by_y[first[k]:first[k] + size[k]].tolist())
        for a_no, a in enumerate(mine):
            for b in mine[a_no + 1:]:
                if math.sqrt((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2) <= tol and to[a] != to[b]:
                    low, high = sorted((to[a], to[b]))
                    for c in mine:
                        if to[c] == high:
                            to[c] = low
    return to[node], g, x, y


def _following(u, v, x, y) -> np.ndarray:
    """Number of the edge after each one around the same land, -1 where none leaves its end."""
    by_start = np.argsort(u, kind="stable")
    starts = u[by_start]
    lo, hi = np.searchsorted(starts, v, "left"), np.searchsorted(starts, v, "right")
    edge, at = _pairs(lo, hi - lo)
    out = by_start[at]
    back = np.arctan2(y[u[edge]] - y[v[edge]], x[u[edge]] - x[v[edge]])
    turn = np.mod(back - np.arctan2(y[v[out]] - y[u[out]], x[v[out]] - x[u[out]]), 2 * math.pi)
    turn = np.where(turn <= 1e-12, 2 * math.pi, turn)
    order = np.lexsort((out, turn, edge))
    nxt = np.full(len(u), -1)
    best = order[_starts(edge[order])]
    nxt[edge[best]] = out[best]
    return nxt


def _ordered(u: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ring by ring, each from its lowest edge on, and the lengths of the rings."""
    n = len(nxt)
    live = nxt >= 0
    while True:  # an edge that leads to none is part of no ring
        on = live & live[np.where(live, nxt, 0)]
        if (on == live).all():
            break
        live = on
    jump, low, far, span = np.where(live, nxt, np.arange(n)), np.arange(n), np.zeros(n, np.int64), 1
    while True:
        lower = low[jump] < low
        if not lower.any():
            break
        far, low, jump, span = np.where(lower, far[jump] + span, far), np.where(lower, low[jump], low), jump[jump], span * 2
    rank = np.where(far == 0, np.iinfo(np.int64).min, -far)
    order = np.lexsort((rank, low))
    order = order[live[order]]
    return order, np.diff(np.append(np.flatnonzero(_starts(low[order])), len(order))) if len(order) else np.zeros(0, np.int64)


def _straightened(rings: Rings, tol: float) -> Rings:
    """``geometry.drop_collinear`` of every ring."""
    stays = np.ones(len(rings.x), bool)
    for n in np.unique(rings.n):
        mine = np.flatnonzero(rings.n == n)
        x, y = rings.of(mine, int(n))
        keep = np.ones(x.shape, bool)
        lx, ly = x[:, -1], y[:, -1]
        nx, ny = _next(x), _next(y)
        for k in range(int(n)):
            ex, ey = nx[:, k] - lx, ny[:, k] - ly
            far = np.hypot(ex, ey)
            off = np.abs(ex * (y[:, k] - ly) - ey * (x[:, k] - lx)) / np.where(far > 0, far, 1.0)
            keep[:, k] = (far == 0) | (off > tol)
            lx, ly = np.where(keep[:, k], x[:, k], lx), np.where(keep[:, k], y[:, k], ly)
        keep |= (keep.sum(axis=1) < 3)[:, None]
        stays[rings.at[mine][:, None] + np.arange(int(n))] = keep
    ring = np.repeat(np.arange(len(rings.n)), rings.n)
    return Rings(rings.x[stays], rings.y[stays], np.bincount(ring[stays], minlength=len(rings.n)))


def _edges_around(group, poly, x1, y1, x2, y2, rings: Rings, ring_group, ring_poly, tol):
    """Ends ``u, v`` of the pieces around the covered land, and the nodes ``(group, x, y)``."""
    size = np.bincount(group)
    end = np.cumsum(size)
    here = np.arange(len(group))
    i, j = _pairs(here + 1, end[group] - here - 1)
    side, px, py = _split_points(x1, y1, x2, y2, i, j, tol)
    dx, dy = x2 - x1, y2 - y1
    t = ((px - x1[side]) * dx[side] + (py - y1[side]) * dy[side]) / (dx * dx + dy * dy)[side]
    node, ng, nx, ny = _nodes(group[side], px, py, tol)
    order = np.lexsort((t, node, side))
    order = order[_starts(side[order], node[order])]
    order = order[np.lexsort((t[order], side[order]))]
    side, node = side[order], node[order]
    on = np.flatnonzero(side[1:] == side[:-1])
    p, q, mine = node[on], node[on + 1], poly[side[on]]
    a, b, way = np.minimum(p, q), np.maximum(p, q), np.where(p < q, 1, -1)
    order = np.lexsort((mine, b, a))
    a, b, mine, way = a[order], b[order], mine[order], way[order]
    new = _starts(a, b, mine)
    way = np.add.reduceat(way, np.flatnonzero(new)) if len(way) else way
    a, b, mine = a[new], b[new], mine[new]
    new = _starts(a, b)
    piece = np.cumsum(new) - 1  # of each row of ``way``
    a, b = a[new], b[new]
    # pieces within other polygons
    per = np.bincount(ring_group, minlength=len(size))
    start = np.cumsum(per) - per
    mx, my, pg = (nx[a] + nx[b]) / 2, (ny[a] + ny[b]) / 2, ng[a]
    e, r = _pairs(start[pg], per[pg])
    lo_x, hi_x, lo_y, hi_y = (f.reduceat(v, rings.at[:-1]) if len(rings.n) else v for v, f in (
        (rings.x, np.minimum), (rings.x, np.maximum), (rings.y, np.minimum), (rings.y, np.maximum)))
    boxed = (mx[e] >= lo_x[r]) & (mx[e] <= hi_x[r]) & (my[e] >= lo_y[r]) & (my[e] <= hi_y[r])
    e, r = e[boxed], r[boxed]
    codes = int(max(poly.max(initial=0), ring_poly.max(initial=0))) + 1
    other = ~np.isin(e * codes + ring_poly[r], piece * codes + mine)
    e, r = e[other], r[other]
    inside = np.bincount(e[rings.contain(r, mx[e], my[e])], minlength=len(a)) > 0
    left = inside | (np.bincount(piece[way > 0], minlength=len(a)) > 0)
    right = inside | (np.bincount(piece[way < 0], minlength=len(a)) > 0)
    edge = left != right
    return np.where(left, a, b)[edge], np.where(left, b, a)[edge], ng, nx, ny


def _parts(group, poly, x1, y1, x2, y2, rings: Rings, ring_group, ring_poly, tol):
    """``group, ring, holes, holes of each part, area`` of the merged parts, in the order of their numbers."""
    u, v, ng, nx, ny = _edges_around(group, poly, x1, y1, x2, y2, rings, ring_group, ring_poly, tol)
    order, n = _ordered(u, _following(u, v, nx, ny))
    whole = Rings(nx[u[order]], ny[u[order]], n)
    line = _straightened(whole, tol)
    nxt = np.arange(1, len(whole.x) + 1)
    nxt[whole.at[1:] - 1] = whole.at[:-1]
    ring = np.repeat(np.arange(len(n)), n)
    area = np.bincount(ring, whole.x * whole.y[nxt] - whole.x[nxt] * whole.y, len(n)) * 0.5
    rg = ng[u[order]][whole.at[:-1]] if len(n) else np.zeros(0, np.int64)
    outer, inner = np.flatnonzero(area > 0), np.flatnonzero(area < 0)
    by_group = outer[np.argsort(rg[outer], kind="stable")]
    lo, hi = np.searchsorted(rg[by_group], rg[inner], "left"), np.searchsorted(rg[by_group], rg[inner], "right")
    h, o = _pairs(lo, hi - lo)
    o = by_group[o]
    p = whole.at[inner]
    mx, my = (whole.x[p] + whole.x[nxt[p]]) / 2, (whole.y[p] + whole.y[nxt[p]]) / 2
    inside = line.contain(o, mx[h], my[h])
    h, o = h[inside], o[inside]
    # a hole lies in the smallest ring around it
    best = np.lexsort((o, area[o], h))
    best = best[_starts(h[best])]
    hole, around = inner[h[best]], o[best]
    low_x, low_y = (np.minimum.reduceat(c, line.at[:-1]) if len(n) else c for c in (line.x, line.y))
    left = area + np.bincount(around, area[hole], len(n))
    outer = outer[np.lexsort((left[outer], np.round(low_y[outer], 6), np.round(low_x[outer], 6), rg[outer]))]
    place = np.empty(len(n), np.int64)
    place[outer] = np.arange(len(outer))
    hole = hole[np.argsort(place[around], kind="stable")]
    holes = np.bincount(place[around], minlength=len(outer))
    return rg[outer], line.take(outer), line.take(hole), holes, left[outer]


def dissolve(polys: pa.Array) -> pa.Array:
    """Parts of each list of ``poly, ring``: outlines with holes and areas, overlaps counted once."""
    owner = np.repeat(np.arange(len(polys)), np.asarray(pc.fill_null(pc.list_value_length(polys), 0)))
    flat = polys.flatten()
    code = _numbers(pc.fill_null(pc.struct_field(flat, ["poly"]).dictionary_encode().indices.cast(pa.int64()), -1)).astype(np.int64) + 1
    lists = Lists(pc.struct_field(flat, ["ring"]), "x", "y")
    rings = Rings(*lists.fields, lists.n).take(np.flatnonzero(lists.ok & (lists.n >= 3)))
    ring_row, ring_poly = (k[lists.ok & (lists.n >= 3)] for k in (owner, code))
    nxt = np.arange(1, len(rings.x) + 1)
    nxt[rings.at[1:] - 1] = rings.at[:-1]
    ring = np.repeat(np.arange(len(rings.n)), rings.n)
    x, y, qx, qy = rings.x, rings.y, rings.x[nxt], rings.y[nxt]
    area = np.bincount(ring, x * qy - qx * y, len(rings.n))[ring]
    turned = area < 0
    x, y, qx, qy = np.where(turned, qx, x), np.where(turned, qy, y), np.where(turned, x, qx), np.where(turned, y, qy)
    side = np.flatnonzero((area != 0) & ((x != qx) | (y != qy)))
    row, poly, x, y, qx, qy = ring_row[ring[side]], ring_poly[ring[side]], x[side], y[side], qx[side], qy[side]
    # so many groups at once as fill the arrays of pairs
    per = np.bincount(row, minlength=len(polys))
    filled = np.cumsum(per.astype(np.int64) ** 2)
    side_at, ring_at = (np.concatenate([[0], np.cumsum(np.bincount(k, minlength=len(polys)))]) for k in (row, ring_row))
    found, lo = [], 0
    while lo < len(polys):
        hi = max(lo + 1, int(np.searchsorted(filled, (filled[lo - 1] if lo else 0) + BLOCK, "right")))
        s, r = slice(side_at[lo], side_at[hi]), np.arange(ring_at[lo], ring_at[hi])
        if side_at[hi] > side_at[lo]:
            mine = _parts(row[s] - lo, poly[s], x[s], y[s], qx[s], qy[s], rings.take(r), ring_row[r] - lo, ring_poly[r], SNAP)
            found.append((mine[0] + lo, *mine[1:]))
        lo = hi
    return _array(len(polys), found)


def _lists(n: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)


def _array(rows: int, found: list) -> pa.Array:
    def joined(parts: list[np.ndarray], kind=float) -> np.ndarray:
        return np.concatenate([*parts, np.zeros(0, kind)])

    def rings(k: int) -> pa.Array:
        points = pa.StructArray.from_arrays([pa.array(joined([getattr(f[k], c) for f in found])) for c in "xy"], names=["x", "y"])
        return _lists(joined([f[k].n for f in found], np.int64), points)

    row = joined([f[0] for f in found], np.int64)
    holes = _lists(joined([f[3] for f in found], np.int64), rings(2))
    part = pa.StructArray.from_arrays([rings(1), holes, pa.array(joined([f[4] for f in found]))], names=["ring", "holes", "area_sqm"])
    return _lists(np.bincount(row, minlength=rows), part).cast(PARTS)

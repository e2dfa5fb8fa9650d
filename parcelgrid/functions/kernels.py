"""Measures of many rings at once, for Arrow batches.

The expressions in ``geometry`` walk a ring point by point; where that is all the work of a query, rings of equal length of a
batch are measured together as numpy arrays, with the same rules and tolerances.  A row is a result of its own rings only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EPS = 1e-9
#: Numbers of one intermediate array; longer rings are worked through in parts.
BLOCK = 1 << 20
BOX = ("box_area", "angle_deg", "width", "length", "ux", "uy", "cx", "cy")

_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _numbers(a: pa.Array) -> np.ndarray:
    """Doubles of an Arrow array, null as NaN."""
    return np.asarray(a.to_numpy(zero_copy_only=False), dtype=float)


class Lists:
    """Fields of a list-of-structs array, or a list of numbers, row by row; ``ok`` is false for null rows and rows with a null or NaN inside."""

    def __init__(self, a: pa.Array, *fields: str):
        self.n = np.asarray(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        flat = a.flatten()
        self.fields = [_numbers(pc.struct_field(flat, [f])) for f in fields] or [_numbers(flat)]
        bad = np.concatenate([[0], np.cumsum(np.isnan(sum(self.fields)) if len(flat) else np.zeros(0, int))])
        self.ok = np.asarray(a.is_valid().to_numpy(zero_copy_only=False)) & (bad[self.at[1:]] == bad[self.at[:-1]])

    def of(self, rows: np.ndarray, n: int) -> list[np.ndarray]:
        """Arrays ``(rows, n)`` of rows with ``n`` elements."""
        at = self.at[rows][:, None] + np.arange(n)
        return [f[at] for f in self.fields]


def _groups(*lists: Lists) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Rows without a null that have equal lengths, few enough for one array of all pairs."""
    ok = np.logical_and.reduce([x.ok for x in lists])
    rows = np.flatnonzero(ok)
    if not len(rows):
        return
    kind = np.zeros(len(rows), np.int64)
    for x in lists:
        kind = kind << 31 | x.n[rows]
    for k in np.unique(kind):
        mine = rows[kind == k]
        lengths = [int(x.n[mine[0]]) for x in lists]
        pairs = max(1, max(lengths)) * max(1, min(lengths) if len(lengths) > 1 else lengths[0])
        step = max(1, BLOCK // pairs)
        for i in range(0, len(mine), step):
            yield mine[i:i + step], lengths


def _parts(n: int, pairs: int) -> Iterator[slice]:
    step = max(1, BLOCK // max(1, pairs))
    return (slice(i, i + step) for i in range(0, n, step))


def _next(a: np.ndarray) -> np.ndarray:
    return np.roll(a, -1, axis=1)


def _turn(ox, oy, ax, ay, bx, by):
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def _area(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    qx, qy = _next(x), _next(y)
    return (x * qy - qx * y).sum(axis=1) * 0.5 if x.shape[1] else np.zeros(len(x))


def _areas(x: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """Areas of rings, or of the first ``count`` points of each; sides are added one after the other, as the expression does."""
    if not x.shape[1]:
        return np.zeros(len(x))
    if count is None:
        terms = x * _next(y) - _next(x) * y
    else:
        at = np.arange(x.shape[1])
        nxt = np.where(at + 1 < count[:, None], at + 1, 0)
        nx, ny = np.take_along_axis(x, nxt, axis=1), np.take_along_axis(y, nxt, axis=1)
        terms = np.where(at < count[:, None], x * ny - nx * y, 0.0)
    return np.abs(np.cumsum(terms, axis=1)[:, -1] * 0.5)


def area(ring: pa.Array) -> pa.Array:
    r, out = Lists(ring, "x", "y"), np.zeros(len(ring))
    for rows, (n,) in _groups(r):
        out[rows] = _areas(*r.of(rows, n))
    return _flags(out, r.ok)


def _segments(x: np.ndarray, y: np.ndarray, closed: bool = True) -> tuple[np.ndarray, ...]:
    if closed:
        return x, y, _next(x), _next(y)
    return x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:]


def _crossing(e: tuple[np.ndarray, ...], f: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows in which a segment of ``e`` properly crosses one of ``f``."""
    out = np.zeros(len(e[0]), bool)
    fx, fy, gx, gy = (v[:, None, :] for v in f)
    for s in _parts(e[0].shape[1], len(e[0]) * max(1, f[0].shape[1])):
        px, py, qx, qy = (v[:, s, None] for v in e)
        a, b = _turn(px, py, qx, qy, fx, fy), _turn(px, py, qx, qy, gx, gy)
        c, d = _turn(fx, fy, gx, gy, px, py), _turn(fx, fy, gx, gy, qx, qy)
        hit = (((a > EPS) & (b < -EPS)) | ((a < -EPS) & (b > EPS))) & (((c > EPS) & (d < -EPS)) | ((c < -EPS) & (d > EPS)))
        out |= hit.any(axis=(1, 2))
    return out


def _gaps(px: np.ndarray, py: np.ndarray, e: tuple[np.ndarray, ...]) -> np.ndarray:
    """Distances ``(rows, points, segments)``."""
    ax, ay, bx, by = (v[:, None, :] for v in e)
    x, y = px[:, :, None], py[:, :, None]
    dx, dy = bx - ax, by - ay
    n2 = dx * dx + dy * dy
    t = np.where(n2 > 0, ((x - ax) * dx + (y - ay) * dy) / np.where(n2 > 0, n2, 1.0), 0.0)
    t = np.minimum(np.maximum(t, 0.0), 1.0)
    return np.hypot(x - (ax + t * dx), y - (ay + t * dy))


def _nearest(px: np.ndarray, py: np.ndarray, e: tuple[np.ndarray, ...]) -> np.ndarray:
    out = np.full(len(px), np.inf)
    if e[0].shape[1]:
        for s in _parts(px.shape[1], len(px) * e[0].shape[1]):
            out = np.minimum(out, _gaps(px[:, s], py[:, s], e).min(axis=(1, 2)))
    return out


def _inside(e: tuple[np.ndarray, ...], px: np.ndarray, py: np.ndarray, boundary: bool = True) -> np.ndarray:
    """``(rows, points)``: points in the ring with the sides ``e``."""
    out = np.zeros(px.shape, bool)
    if not e[0].shape[1]:
        return out
    ax, ay, bx, by = (v[:, None, :] for v in e)
    for s in _parts(px.shape[1], len(px) * e[0].shape[1]):
        x, y = px[:, s, None], py[:, s, None]
        crossed = ((ay > y) != (by > y)) & ((_turn(ax, ay, bx, by, x, y) > 0) == (by > ay))
        odd = crossed.sum(axis=2) % 2 == 1
        on = (_gaps(px[:, s], py[:, s], e) <= EPS).any(axis=2)
        out[:, s] = (odd | on) if boundary else (odd & ~on)
    return out


def _flags(values: np.ndarray, ok: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~ok)


# ---------------------------------------------------------------- oriented box


def _hull(x: list[float], y: list[float]) -> list[tuple[float, float]]:
    points = sorted(set(zip(x, y)))

    def half(ps):
        chain: list[tuple[float, float]] = []
        for p in ps:
            while len(chain) > 1 and _turn(*chain[-2], *chain[-1], *p) <= EPS:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return half(points) + half(points[::-1])


def _best_box(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``(8, rows)``: smallest box along a side of a convex ring, in the order of ``BOX``; rows are the last axis throughout."""
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    dx, dy = np.roll(x, -1, axis=0) - x, np.roll(y, -1, axis=0) - y
    found = []
    for s in _parts(len(x), x.size):
        length = np.hypot(dx[s], dy[s])
        some = np.where(length > EPS, length, np.nan)
        ux, uy = dx[s] / some, dy[s] / some
        a = x * ux[:, None, :] + y * uy[:, None, :]
        b = y * ux[:, None, :] - x * uy[:, None, :]
        s0, s1, t0, t1 = a.min(axis=1), a.max(axis=1), b.min(axis=1), b.max(axis=1)
        es, et = s1 - s0, t1 - t0
        along = es >= et - EPS
        lx, ly = np.where(along, ux, -uy), np.where(along, uy, ux)
        flip = np.where((ly < -EPS) | ((np.abs(ly) <= EPS) & (lx < 0)), -1.0, 1.0)
        sm, tm = (s0 + s1) * 0.5, (t0 + t1) * 0.5
        angle = np.degrees(np.arctan2(ly * flip, lx * flip)) % 180.0
        found.append([
            np.round(es * et, 6), np.round(angle, 9), np.minimum(es, et), np.maximum(es, et), lx * flip, ly * flip,
            sm * ux - tm * uy, sm * uy + tm * ux,
        ])
    keys = np.concatenate([np.stack(f) for f in found], axis=1)
    left = ~np.isnan(keys[0])
    for k in keys:
        v = np.where(left, k, np.inf)
        left &= v == v.min(axis=0)
    return np.take_along_axis(keys, left.argmax(axis=0)[None, None, :], axis=1)[:, 0, :]


def _strictly_convex(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows whose points all lie to the left of all sides, none along them."""
    n = x.shape[1]
    if n < 3 or n > 64:
        return np.zeros(len(x), bool)
    px, py = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    out = np.ones(len(x), bool)
    for k in range(n):
        j = (k + 1) % n
        rest = [i for i in range(n) if i not in (k, j)]
        out &= (_turn(px[k], py[k], px[j], py[j], px[rest], py[rest]) > EPS).all(axis=0)
    return out


def obb(ring: pa.Array) -> pa.Array:
    r = Lists(ring, "x", "y")
    out, ok = np.full((len(BOX), len(ring)), np.nan), np.zeros(len(ring), bool)
    for rows, (n,) in _groups(r):
        x, y = r.of(rows, n)
        back = _area(x, y) < 0
        x[back], y[back] = x[back, ::-1], y[back, ::-1]
        plain = _strictly_convex(x, y)
        if plain.any():
            out[:, rows[plain]], ok[rows[plain]] = _best_box(x[plain], y[plain]), True
        for i in np.flatnonzero(~plain):
            hull = np.array(_hull(x[i].tolist(), y[i].tolist()))
            if len(hull):
                out[:, rows[i]], ok[rows[i]] = _best_box(hull[None, :, 0], hull[None, :, 1])[:, 0], True
    return pa.StructArray.from_arrays([pa.array(c) for c in out], names=list(BOX), mask=pa.array(~ok))


# ---------------------------------------------------------------- clipping


def _clip(x: np.ndarray, y: np.ndarray, planes: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings ``(x, y, count)`` cut by half-planes ``(a, b, c)``, one after the other."""
    count = np.full(len(x), x.shape[1])
    for a, b, c in planes:
        at = np.arange(x.shape[1])
        nxt = np.where(at + 1 < count[:, None], at + 1, 0)
        d = a[:, None] * x + b[:, None] * y - c[:, None]
        if not x.shape[1]:
            break
        nx, ny, nd = (np.take_along_axis(v, nxt, axis=1) for v in (x, y, d))
        here = at < count[:, None]
        keep = here & (d <= EPS)
        hit = here & (((d < -EPS) & (nd > EPS)) | ((d > EPS) & (nd < -EPS)))
        t = np.where(hit, d / np.where(hit, d - nd, 1.0), 0.0)
        emit = keep.astype(int) + hit
        to = np.cumsum(emit, axis=1) - emit
        count = emit.sum(axis=1)
        ox, oy = (np.zeros((len(x), int(count.max(initial=0)))) for _ in "xy")
        row = np.broadcast_to(np.arange(len(x))[:, None], x.shape)
        ox[row[keep], to[keep]], oy[row[keep], to[keep]] = x[keep], y[keep]
        after = (to + keep)[hit]
        ox[row[hit], after] = (x + t * (nx - x))[hit]
        oy[row[hit], after] = (y + t * (ny - y))[hit]
        x, y = ox, oy
    return x, y, count


def _sides_as_planes(x: np.ndarray, y: np.ndarray, inset: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    px, py, qx, qy = _segments(x, y)
    for k in range(x.shape[1]):
        n = np.hypot(qx[:, k] - px[:, k], qy[:, k] - py[:, k])
        some = np.where(n > EPS, n, np.inf)  # a side without a length cuts nothing
        a, b = (qy[:, k] - py[:, k]) / some, (px[:, k] - qx[:, k]) / some
        yield a, b, np.where(n > EPS, a * px[:, k] + b * py[:, k] - inset, np.inf)


class _Rings:
    """Result rings of all rows, filled in any order."""

    def __init__(self, size: int):
        self.rows: list[np.ndarray] = []
        self.data: list[tuple[np.ndarray, np.ndarray]] = []
        self.n, self.ok = np.zeros(size, np.int64), np.zeros(size, bool)

    def put(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray, count: np.ndarray) -> None:
        here = np.arange(x.shape[1]) < count[:, None]
        self.n[rows], self.ok[rows] = count, True
        self.rows.append(np.repeat(rows, count))
        self.data.append((x[here], y[here]))

    def array(self) -> pa.Array:
        rows = np.concatenate([*self.rows, np.zeros(0, np.int64)])
        order = np.argsort(rows, kind="stable")
        x, y = (np.concatenate([*[d[k] for d in self.data], np.zeros(0)])[order] for k in (0, 1))
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.n)]).astype(np.int32))
        points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
        return pa.ListArray.from_arrays(offsets, points, mask=pa.array(~self.ok)).cast(_POINTS)


def clip_convex(ring: pa.Array, planes: pa.Array) -> pa.Array:
    r, p = Lists(ring, "x", "y"), Lists(planes, "a", "b", "c")
    out = _Rings(len(ring))
    for rows, (n, m) in _groups(r, p):
        x, y = r.of(rows, n)
        a, b, c = p.of(rows, m)
        out.put(rows, *_clip(x, y, ((a[:, k], b[:, k], c[:, k]) for k in range(m))))
    return out.array()


def slices(ring: pa.Array, ux: pa.Array, uy: pa.Array, widths: pa.Array) -> pa.Array:
    """One ``ring, sqm`` for each width: the ring cut across the direction ``ux, uy``, widths rescaled to its extent."""
    r, w, u, v = Lists(ring, "x", "y"), Lists(widths), _numbers(ux), _numbers(uy)
    ok = r.ok & w.ok & ~np.isnan(u + v)
    at = np.concatenate([[0], np.cumsum(np.where(ok, w.n, 0))])
    out, sqm = _Rings(int(at[-1])), np.zeros(int(at[-1]))
    for rows, (n, m) in _groups(r, w):
        rows = rows[ok[rows]]
        if not n or not m or not len(rows):
            continue
        (x, y), (ws,) = r.of(rows, n), w.of(rows, m)
        a, b = u[rows, None], v[rows, None]
        along = x * a + y * b
        lo, hi = along.min(axis=1)[:, None], along.max(axis=1)[:, None]
        upto = np.cumsum(ws, axis=1)
        k = (hi - lo) / upto[:, -1:]
        start = lo + np.concatenate([np.zeros((len(rows), 1)), upto[:, :-1]], axis=1) * k
        planes = ((a, b, lo + upto * k), (-a, -b, -start))
        flat = (tuple(np.broadcast_to(p, ws.shape).ravel() for p in plane) for plane in planes)
        cut = _clip(np.repeat(x, m, axis=0), np.repeat(y, m, axis=0), flat)
        to = (at[rows][:, None] + np.arange(m)).ravel()
        out.put(to, *cut)
        sqm[to] = _areas(*cut)
    lots = pa.StructArray.from_arrays([out.array(), pa.array(sqm)], names=["ring", "sqm"])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), lots, mask=pa.array(~ok))


def _convex(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    px, py, qx, qy = _segments(x, y)
    turn = _turn(px, py, qx, qy, _next(qx), _next(qy))
    return (turn >= -EPS).all(axis=1) | (turn <= EPS).all(axis=1)


def is_convex(ring: pa.Array) -> pa.Array:
    r, out = Lists(ring, "x", "y"), np.zeros(len(ring), bool)
    for rows, (n,) in _groups(r):
        out[rows] = _convex(*r.of(rows, n))
    return _flags(out, r.ok)


def inset(ring: pa.Array, distance: pa.Array) -> pa.Array:
    r, d, out = Lists(ring, "x", "y"), _numbers(distance), _Rings(len(ring))
    for rows, (n,) in _groups(r):
        x, y = r.of(rows, n)
        fine = _convex(x, y) & ~np.isnan(d[rows])
        if fine.any():
            x, y, rows = x[fine], y[fine], rows[fine]
            out.put(rows, *_clip(x, y, _sides_as_planes(x, y, d[rows])))
    return out.array()


def intersection_area(a: pa.Array, b: pa.Array) -> pa.Array:
    r, q = Lists(a, "x", "y"), Lists(b, "x", "y")
    out = np.zeros(len(a))
    for rows, (n, m) in _groups(r, q):
        (x, y), (u, v) = r.of(rows, n), q.of(rows, m)
        for k in range(1, m - 1):
            tx, ty = u[:, [0, k, k + 1]], v[:, [0, k, k + 1]]
            s = _area(tx, ty)
            back = s < 0
            tx[back], ty[back] = tx[back, ::-1], ty[back, ::-1]
            cx, cy, count = _clip(x, y, _sides_as_planes(tx, ty, np.zeros(len(rows))))
            at = np.arange(cx.shape[1])
            if not len(at):
                continue
            nxt = np.where(at + 1 < count[:, None], at + 1, 0)
            nx, ny = np.take_along_axis(cx, nxt, axis=1), np.take_along_axis(cy, nxt, axis=1)
            part = np.abs(np.where(at < count[:, None], cx * ny - nx * cy, 0.0).sum(axis=1) * 0.5)
            out[rows] += np.where(np.abs(s) < EPS, 0.0, np.sign(s) * part)
    return _flags(out, r.ok & q.ok)


# ---------------------------------------------------------------- containment, distance, validity


def is_simple(ring: pa.Array) -> pa.Array:
    r, out = Lists(ring, "x", "y"), np.zeros(len(ring), bool)
    for rows, (n,) in _groups(r):
        x, y = r.of(rows, n)
        if n >= 3:
            e = _segments(x, y)
            out[rows] = (np.abs(_area(x, y)) > EPS) & ~_crossing(e, e)
    return _flags(out, r.ok)


def ring_contains(ring: pa.Array, other: pa.Array) -> pa.Array:
    r, q = Lists(ring, "x", "y"), Lists(other, "x", "y")
    out = np.zeros(len(ring), bool)
    for rows, (n, m) in _groups(r, q):
        (x, y), (u, v) = r.of(rows, n), q.of(rows, m)
        e, f = _segments(x, y), _segments(u, v)
        px, py = np.concatenate([u, (f[0] + f[2]) / 2], axis=1), np.concatenate([v, (f[1] + f[3]) / 2], axis=1)
        out[rows] = _inside(e, px, py).all(axis=1) & ~_crossing(e, f) & ~_inside(f, x, y, boundary=False).any(axis=1)
    return _flags(out, r.ok & q.ok)


def _point_in(ring: pa.Array, x: pa.Array, y: pa.Array, boundary: bool) -> pa.Array:
    r, px, py = Lists(ring, "x", "y"), _numbers(x), _numbers(y)
    placed = r.ok & ~np.isnan(px + py)
    out = np.zeros(len(ring), bool)
    for rows, (n,) in _groups(r):
        out[rows] = _inside(_segments(*r.of(rows, n)), px[rows, None], py[rows, None], boundary)[:, 0]
    return _flags(out, placed)


def point_in_ring(ring: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    return _point_in(ring, x, y, boundary=True)


def point_within_ring(ring: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Points on the outline are not in the ring."""
    return _point_in(ring, x, y, boundary=False)


def nearest_point(path: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """``dist, seg, x, y`` of the closest point of each path; the earliest segment wins a tie."""
    r, px, py = Lists(path, "x", "y"), _numbers(x), _numbers(y)
    out, ok = np.zeros((4, len(path))), np.zeros(len(path), bool)
    for rows, (n,) in _groups(r):
        rows = rows[~np.isnan(px[rows] + py[rows])]
        if n < 2 or not len(rows):
            continue
        ax, ay, bx, by = _segments(*r.of(rows, n), closed=False)
        u, v = px[rows, None], py[rows, None]
        dx, dy = bx - ax, by - ay
        n2 = dx * dx + dy * dy
        t = np.where(n2 > 0, ((u - ax) * dx + (v - ay) * dy) / np.where(n2 > 0, n2, 1.0), 0.0)
        t = np.minimum(np.maximum(t, 0.0), 1.0)
        fx, fy = ax + t * dx, ay + t * dy
        dist = np.round(np.hypot(u - fx, v - fy), 9)
        k = dist.argmin(axis=1)
        at = np.arange(len(rows))
        out[:, rows], ok[rows] = (dist[at, k], k, fx[at, k], fy[at, k]), True
    fields = [pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2]), pa.array(out[3])]
    return pa.StructArray.from_arrays(fields, names=["dist", "seg", "x", "y"], mask=pa.array(~ok))


def _distance(a: pa.Array, b: pa.Array, path: bool) -> pa.Array:
    r, q = Lists(a, "x", "y"), Lists(b, "x", "y")
    out = np.full(len(a), np.nan)
    for rows, (n, m) in _groups(r, q):
        if not n or not m:
            continue
        (x, y), (u, v) = r.of(rows, n), q.of(rows, m)
        e, f = _segments(x, y), _segments(u, v, closed=not path)
        gap = np.minimum(_nearest(x, y, f), _nearest(u, v, e))
        touch = _crossing(e, f) | _inside(e, u[:, :1], v[:, :1])[:, 0]
        if not path:
            touch |= _inside(f, x[:, :1], y[:, :1])[:, 0]
        out[rows] = np.where(touch, 0.0, gap)
    return pa.array(out, mask=np.isnan(out))


def ring_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return _distance(a, b, path=False)


def ring_path_distance(ring: pa.Array, path: pa.Array) -> pa.Array:
    return _distance(ring, path, path=True)

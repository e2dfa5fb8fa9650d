"""DXF text of many rows at once, for Arrow batches: numbers with six decimals, entities out of group-code lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked through at once; a longer document is a part of its own.
PART = 4 << 20
CODES = ("0", "8", "70", "10", "11", "20", "21")
KINDS = ("VERTEX", "SEQEND", "LWPOLYLINE", "POLYLINE", "LINE")

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ENTITY = pa.struct([
    ("entity_no", pa.int32()), ("kind", pa.string()), ("layer", pa.string()), ("flag", pa.string()), ("points", pa.list_(_POINT)),
])
_WIDE = Context(prec=400)


def _six_slowly(v: float) -> str:
    if np.isnan(v):
        return "NaN"
    sign = "-" if np.signbit(v) else ""
    if np.isinf(v):
        return sign + "Infinity"
    return sign + format(Decimal(repr(abs(float(v)))).quantize(Decimal("0.000001"), ROUND_HALF_UP, _WIDE), "f")


def six_decimals(a: pa.Array) -> pa.Array:
    """As ``%.6f`` of the engine, which rounds half up in the shortest decimal of a number; null gives ``null``.

    A number whose rounding is in doubt, because it is next to a tie, is worked out as a decimal.
    """
    v = np.asarray(a.to_numpy(zero_copy_only=False), dtype=float)
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(v) * 1e6
        whole = np.floor(y)
        rest = y - whole
        clear = np.abs(rest - 0.5) > y * 2.0**-51
    n = np.where(clear, whole + (rest > 0.5), 0).astype(np.int64)
    high = n // 1_000_000
    low = pc.utf8_slice_codeunits(pa.array(n - high * 1_000_000 + 1_000_000).cast(pa.string()), 1)
    minus = np.signbit(v)
    signs = [pa.array(["", "-"]).take(pa.array(minus.astype(np.int8)))] if minus.any() else []
    out = pc.binary_join_element_wise(*signs, pa.array(high).cast(pa.string()), ".", low, "")
    doubt = ~clear
    if doubt.any():
        out = pc.replace_with_mask(out, pa.array(doubt), pa.array([_six_slowly(x) for x in v[doubt]], pa.string()))
    return pc.if_else(a.is_valid(), out, "null") if a.null_count else out


def polyline_text(layer: pa.Array, ring: pa.Array) -> pa.Array:
    """Closed LWPOLYLINE as group-code lines; null without a layer or a ring."""
    flat = ring.flatten()
    x, y = (six_decimals(pc.struct_field(flat, [f])) for f in "xy")
    points = pc.binary_join_element_wise("10\n", x, "\n20\n", y, "\n", "")
    n = pc.list_value_length(ring)
    joined = pc.binary_join(_lists(pc.fill_null(n, 0).to_numpy(zero_copy_only=False), points), "")
    return pc.binary_join_element_wise("0\nLWPOLYLINE\n8\n", layer, "\n90\n", n.cast(pa.string()), "\n70\n1\n", joined, "")


_PLAIN = r"^-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"
_NUMBER = re.compile(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[fFdD]?", re.ASCII)
_HEX = re.compile(r"([+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?", re.ASCII)
_SPACE = "".join(map(chr, range(33)))


def _number_slowly(text: str) -> float | None:
    t = text.strip(_SPACE)
    if m := _NUMBER.fullmatch(t):
        return float(m[1])
    if m := _HEX.fullmatch(t):
        return float.fromhex(m[1])
    word = t.lower()
    if word in ("inf", "+inf", "infinity", "+infinity", "-inf", "-infinity", "nan"):
        return float(word)
    return float("nan") if t in ("+NaN", "-NaN") else None


def numbers(text: pa.Array) -> pa.Array:
    """As the engine's ``try_cast`` to double: what is no number is null."""
    try:
        known = text.cast(pa.float64())
        if not pc.any(pc.is_nan(known)).as_py():
            return known
    except pa.ArrowInvalid:
        pass
    plain = pc.match_substring_regex(text, _PLAIN)
    known = pc.if_else(plain, text, pa.scalar(None, pa.string())).cast(pa.float64())
    odd = pc.invert(plain)
    return pc.replace_with_mask(known, odd, pa.array([_number_slowly(t) for t in text.filter(odd).to_pylist()], pa.float64()))


def _parts(a: pa.Array) -> Iterator[pa.Array]:
    size = np.cumsum(pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, side="right")))
        yield a.slice(at, end - at)
        at = end


def _lists(counts: np.ndarray, values: pa.Array, mask: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values, mask=mask)


def _entities(value: pa.Array) -> pa.Array:
    """One list of entities for each document; pairs of lines before the first entity belong to none."""
    def has(mark: str) -> bool:
        return bool(pc.any(pc.match_substring(value, mark)).as_py())

    split = pc.split_pattern(pc.replace_substring(value, "\r", "") if has("\r") else value, "\n")
    lines = pc.ascii_trim(split.flatten(), " ") if has(" ") else split.flatten()
    n_lines = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_pairs = n_lines // 2
    doc = np.repeat(np.arange(len(value)), n_pairs)
    first = np.cumsum(n_pairs) - n_pairs
    line = (np.cumsum(n_lines) - n_lines)[doc] + 2 * (np.arange(len(doc)) - first[doc])

    def texts(pairs: np.ndarray) -> pa.Array:
        return lines.take(pa.array(line[pairs] + 1))

    def which(a: pa.Array, known: tuple[str, ...]) -> np.ndarray:
        return pc.fill_null(pc.index_in(a, value_set=pa.array(known)), -1).to_numpy(zero_copy_only=False)

    code = which(lines.take(pa.array(line)), CODES)
    zero = np.flatnonzero(code == 0)
    word = which(texts(zero), KINDS)
    opens = (word != 0) & (word != 1)
    start, kind = zero[opens], word[opens]
    begins = np.zeros(len(doc), np.int64)
    begins[start] = 1
    # entity of every pair; -1 before the first one of its document
    of = np.cumsum(begins) - 1
    some = n_pairs > 0
    if not begins[first[some]].all():
        of[(of >= 0) & (doc[start[of]] != doc if len(start) else True)] = -1
    read = kind >= 2
    # a POLYLINE owns the VERTEX entities after it, and its header carries a dummy point before the first one
    body = start.copy()
    vertex = zero[word == 0]
    vertex = vertex[of[vertex] >= 0]
    owner, at = np.unique(of[vertex], return_index=True)
    poly = kind[owner] == 3
    body[owner[poly]] = vertex[at[poly]]
    mine = np.flatnonzero((of >= 0) & (code > 0))
    mine = mine[read[of[mine]]]

    def first_text(k: int) -> pa.Array:
        pairs = mine[code[mine] == k]
        who, i = np.unique(of[pairs], return_index=True)
        index = np.full(len(start), -1)
        index[who] = pairs[i]
        index = index[read]
        return lines.take(pa.array(np.where(index >= 0, line[index] + 1, 0) if len(line) else index, mask=index < 0))

    axes = []
    for codes in ((3, 4), (5, 6)):
        pairs = mine[(code[mine] == codes[0]) | (code[mine] == codes[1])]
        axes.append(pairs[pairs >= body[of[pairs]]])
    counts = [np.bincount(of[a], minlength=len(start)) for a in axes]
    n_points = np.maximum(*counts)
    offset = np.cumsum(n_points) - n_points
    columns = []
    for a, c in zip(axes, counts):
        to = offset[of[a]] + np.arange(len(a)) - (np.cumsum(c) - c)[of[a]]
        back = np.full(int(n_points.sum()), -1)
        back[to] = np.arange(len(a))
        columns.append(numbers(texts(a)).take(pa.array(back, mask=back < 0)))
    points = pa.StructArray.from_arrays(columns, fields=list(_POINT))
    number = np.arange(len(start)) - np.searchsorted(doc[start], doc[start], side="left")
    found = pa.StructArray.from_arrays([
        pa.array(number[read].astype(np.int32)), pa.array(KINDS).take(pa.array(kind[read])), first_text(1), first_text(2),
        _lists(n_points[read], points),
    ], fields=list(_ENTITY))
    return _lists(np.bincount(doc[start[read]], minlength=len(value)), found)


def entities(value: pa.Array) -> pa.Array:
    parts = [_entities(p) for p in _parts(value)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_ENTITY))

"""Periodic runs of words in chat messages: stretches that repeat themselves, such as a reply stuck in a loop.

Method: seed and extend along diagonals.  A run of period q and length L agrees with itself, moved by q words, over
L - q consecutive words, and a run of at least ``least`` words and two periods guarantees an overlap of
``ceil(least / 2)`` of them.  So all grams of that many words are indexed, two occurrences of a gram in the same message
are a seed on the diagonal of their lag, and seeds are extended both ways.  A table of the furthest word covered on each
lag suppresses seeds that an earlier extension has passed.

Two things keep the work near linear where a gram occurs very often:

- longer lags guarantee longer overlaps, so lags in [k, 2k) are seeded by grams of k words only, k doubling from level
  to level; a gram of 2k words is named by the names of its halves, and these names also extend a seed in one jump per
  level;
- occurrences of a gram that overlap by half follow each other at its own period (a chain).  Lags inside a chain are
  multiples of that period; between two chains every lag is met from the first occurrence of one of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelgrid.llm.batches import map_rows, utf8

CHUNK_BYTES = 4 << 20
FILTER_BITS = 22
_WHITE = b" \t\n\x0b\x0c\r"
_MIX = 0x9E3779B97F4A7C15


def chunks(data: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Parts of a text of about ``size`` bytes, cut at white space only."""
    start = 0
    while start < len(data):
        stop = min(start + size, len(data))
        while stop < len(data) and data[stop] not in _WHITE:
            stop += 1
        yield data[start:stop]
        start = stop


def _groups(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by key and place, and a dense group number for each; keys met once are left out."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    often = np.zeros(len(key), bool)
    often[1:] |= same
    often[:-1] |= same
    first = np.concatenate(([True], ~same))[: len(key)]
    return at[often], np.cumsum(first[often]) - 1


def gram_groups(words: np.ndarray, text_no: np.ndarray, k: int, mix: int = _MIX) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal grams of ``k`` words inside a text; ``words`` has a value of its own between two texts."""
    n = len(words) - k + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = text_no[:n].astype(np.uint64)
    for x in range(k):
        key = key * np.uint64(mix) + words[x : x + n].astype(np.uint64)
        key ^= key >> np.uint64(29)
    # most grams occur once: a table of counts by some bits of the key leaves few to sort
    slot = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    at = np.flatnonzero(np.bincount(slot, minlength=1 << FILTER_BITS)[slot] > 1)
    at, group = _groups(key[at], at)
    inner = np.flatnonzero(group[1:] == group[:-1])
    if all((words[at[inner] + x] == words[at[inner + 1] + x]).all() for x in range(k)) and (
        text_no[at[inner]] == text_no[at[inner + 1]]
    ).all():
        return at, group
    # two different grams share a key: name them by their words instead
    at = np.arange(n)
    _, name = np.unique(np.stack([text_no[:n], *[words[x : x + n] for x in range(k)]]), axis=1, return_inverse=True)
    return _groups(name.ravel(), at)


def seeds(at: np.ndarray, group: np.ndarray, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence pairs as (place, lag) with ``lo <= lag < hi``: one for each lag that two chains have in common."""
    linked = (group[1:] == group[:-1]) & (np.diff(at) <= k // 2)
    opens = np.concatenate(([True], ~linked))[: len(at)]
    chain, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
    place, lag = [], []

    def emit(left: np.ndarray, right: np.ndarray) -> None:
        kept = right - left >= lo
        place.append(left[kept])
        lag.append((right - left)[kept])

    second = np.flatnonzero(linked & opens[:-1]) + 1
    inside = at[second] - at[second - 1] < hi
    emit(at[second - 1][inside], at[second][inside])
    ahead = np.arange(len(at))
    step = 1
    while len(ahead):  # every occurrence against the first ones of later chains
        ahead = ahead[chain[ahead] + step < len(first)]
        other = first[chain[ahead] + step]
        near = (group[other] == group[ahead]) & (at[other] - at[ahead] < hi)
        ahead, other = ahead[near], other[near]
        emit(at[ahead], at[other])
        step += 1
    behind, step = np.flatnonzero(~opens), 1
    while len(behind):  # every later occurrence of a chain against the first ones of earlier chains
        behind = behind[chain[behind] >= step]
        other = first[chain[behind] - step]
        near = (group[other] == group[behind]) & (at[behind] - at[other] < hi)
        behind, other = behind[near], other[near]
        emit(at[other], at[behind])
        step += 1
    return np.concatenate(place), np.concatenate(lag)


def reach(
    words: np.ndarray, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray, forward: bool
) -> np.ndarray:
    """How many words agree from ``i`` and ``j`` on, or before them: one jump per level, then single words."""
    out = np.zeros(len(i), np.int64)

    def jump(name: np.ndarray, k: int) -> bool:
        a, b = (i + out, j + out) if forward else (i - out - k, j - out - k)
        inside = (a >= 0) & (b < len(name))
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        hit = inside & (name[a] == name[b]) & (name[a] >= 0)
        out[hit] += k
        return bool(hit.any())

    for k, name in reversed(levels):
        while jump(name, k):
            pass
    known = np.maximum(words, -1)  # what stands between texts agrees with nothing
    while jump(known, 1):
        pass
    return out


def find_runs(words: np.ndarray, text_no: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, ordered by start and period.

    ``words`` are word numbers of texts laid side by side, with a negative number of its own after each text;
    ``text_no`` is the text of each place.
    """
    k = -(-least // 2)
    at, group = gram_groups(words, text_no, k)
    levels, found, lo = [], [], 1
    while len(at):
        name = np.full(len(words), -1, np.int32 if len(words) < 1 << 31 else np.int64)
        name[at] = group
        levels.append((k, name))
        found.append((k, *seeds(at, group, k, lo, 2 * k)))
        lo = k = 2 * k
        at = np.sort(at)
        at = at[at + k // 2 < len(words)]
        at = at[name[at + k // 2] >= 0]
        pair = name[at].astype(np.int64) * (int(group[-1]) + 1) + name[at + k // 2]
        at, group = _groups(pair, at)
    runs = [np.zeros((0, 3), np.int64)]
    for k, place, lag in found:
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # what a seed's own gram covers is passed at once
        fresh = np.ones(len(place), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + k)
        place, lag = place[fresh], lag[fresh]
        if not len(place):
            continue
        ends = place + reach(words, levels, place, place + lag, True)
        # furthest word covered on each lag so far: a running maximum that starts anew with the lag
        lag_no = np.cumsum(np.concatenate(([0], (lag[1:] != lag[:-1]).astype(np.int64))))
        covered = np.maximum.accumulate(lag_no * (len(words) + 1) + ends) - lag_no * (len(words) + 1)
        fresh = np.ones(len(place), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] > covered[:-1])
        place, lag, ends = place[fresh], lag[fresh], ends[fresh]
        start = place - reach(words, levels, place, place + lag, False)
        length = ends - start + lag
        good = length >= np.maximum(least, 2 * lag)
        runs.append(np.stack([start, length, lag], axis=1)[good])
    table = np.concatenate(runs)
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    # the same stretch on a multiple of its period
    smallest = np.ones(len(table), bool)
    smallest[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)
    table = table[smallest]
    table = table[np.lexsort((table[:, 2], table[:, 0]))]
    return table[:, 0], table[:, 1], table[:, 2]


def _work(least: int):
    """Turns a slice of texts into word counts, runs and collapsed texts."""

    def work(part: pa.RecordBatch):
        data, borders = utf8(part.column("text"))
        raw, n_texts = data.tobytes(), len(borders) - 1
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        pieces, sizes = [], np.zeros(n_texts, np.int64)
        for t in range(n_texts):
            for chunk in chunks(raw[borders[t] : borders[t + 1]]):
                ids = np.array(list(map(number.__getitem__, chunk.split())), np.int64)
                sizes[t] += len(ids)
                pieces.append(ids)
            pieces.append(np.array([-2 - t], np.int64))
        words = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))
        text_no = np.repeat(np.arange(n_texts), sizes + 1)
        start, length, period = find_runs(words, text_no, least)
        # words after the first period of any run
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        kept = np.cumsum(edge[:-1]) == 0
        whole = np.ones(n_texts, bool)
        whole[text_no[start]] = False
        collapsed = []
        for t in range(n_texts):
            place, out = first[t], []
            for chunk in chunks(raw[borders[t] : borders[t + 1]]):
                some = chunk.split()
                out.extend(some if whole[t] else compress(some, kept[place : place + len(some)].tolist()))
                place += len(some)
            collapsed.append(b" ".join(out).decode("utf-8"))
        owner = text_no[start]
        offsets = np.searchsorted(owner, np.arange(n_texts + 1)).astype(np.int32)
        columns = [pa.array(c) for c in (start - first[owner], length, period)]
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
        return pa.array(sizes), runs, pa.array(collapsed, pa.string())

    return work


def message_runs(
    messages: DataFrame, least: int = 12, keys: Sequence[str] = ("session_id", "seq"), text: str = "text"
) -> DataFrame:
    """Periodic runs of each chat message of the planning sessions, and the message without its repetitions.

    Words are what ASCII white space separates, numbered from 0.  A run is a stretch of consecutive words whose smallest
    period is q (words q apart are the same), at least ``max(least, 2 * q)`` words long, that no neighbouring word
    extends with that period.  Returns the ``keys``, then

    - ``n_words BIGINT``,
    - ``runs ARRAY<STRUCT<start BIGINT, length BIGINT, period BIGINT>>``, all of them, by start and period,
    - ``collapsed STRING``: the words that no run holds behind its first period, joined by one space.

    One row for each input row.  Null and empty texts, and texts of white space, have no words, no runs and an empty
    ``collapsed``.  Null keys stay null, repeated rows stay repeated, other columns of the input are ignored whatever
    their names.  An empty table gives an empty one.  A message is worked on where it lies, without a shuffle, in slices
    of a few megabytes; a longer text is a slice of its own, needing about 20 bytes for each of its own, or 40 where it
    repeats itself throughout.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    results = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    if {"n_words", "runs", "collapsed"} & set(keys):
        raise ValueError("a key has the name of a result")
    rows = messages.select(F.struct(*keys).alias("key"), F.col(text).alias("text"))
    out = map_rows(rows, "text", lambda: _work(least), results, "key")
    return out.select(*[F.col("key")[k].alias(k) for k in keys], "n_words", "runs", "collapsed")

"""Benchmark passages inside training messages.

Method: every training shard, a bounded slice of a partition, gets an FM-index over its words: a suffix array gives the
Burrows-Wheeler transform, a wavelet matrix answers rank queries on it, and every eighth suffix position is sampled.
All test windows are searched backwards at once, occurrences are located from the samples, and the words they cover
are merged into spans.

The index is built over the words that some window uses.  Runs of such words in a message that are shorter than the
shortest window cannot hold one and are left out; that loses no occurrence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parcelgrid.llm.batches import keyed, slices, utf8

WINDOW_WORDS = 10
#: Benchmark text that travels with the tasks of one pass; a larger benchmark takes several passes over the messages.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 3 << 20
SAMPLED = 8
_FACTOR = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[0x80:] = True


@dataclass(frozen=True)
class Words:
    """Words of the texts of a slice: where they start and end in its lower-cased bytes, their text, and a hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, borders: np.ndarray) -> Words:
        data = _LOWER[data]
        inside = _IN_WORD[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[borders] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        start = np.flatnonzero(after & (~before | cut))
        end = np.flatnonzero(before & (~after | cut))
        power = np.full(len(data), _FACTOR, np.uint64)
        power[:1] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
        # shifted to a common place: the same word has the same hash wherever it stands
        back = np.full(len(data) + 1, pow(_FACTOR, -1, 1 << 64), np.uint64)
        back[:1] = 1
        np.multiply.accumulate(back, out=back)
        return cls(data, start, end, np.searchsorted(borders, start, "right") - 1, (sums[end] - sums[start]) * back[start])

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


@dataclass(frozen=True)
class Phrases:
    """Windows of the benchmark items: rows of symbols, padded with -1 on the left, and the item of each."""

    vocabulary: np.ndarray
    words: list[bytes]
    windows: np.ndarray
    length: np.ndarray
    item: np.ndarray
    items: list[str | None]

    @classmethod
    def of(cls, items: list[tuple[str | None, str]], size: int = WINDOW_WORDS) -> Phrases:
        words = Words.of(*utf8(pa.array([t for _, t in items], pa.string())))
        spelled: dict[int, bytes] = {}
        clashes = False
        for k, h in enumerate(words.hash.tolist()):
            clashes |= spelled.setdefault(h, words.word(k)) != words.word(k)
        if clashes:
            raise ValueError("two benchmark words share a 64-bit hash")
        vocabulary = np.array(sorted(spelled), np.uint64)
        symbols = np.searchsorted(vocabulary, words.hash)
        rows: dict[tuple[bytes, int], None] = {}
        for i in range(len(items)):
            own = symbols[words.text == i] if len(items) < 64 else symbols[slice(*np.searchsorted(words.text, (i, i + 1)))]
            wide = min(size, len(own))
            for at in range(len(own) - wide + 1 if wide else 0):
                row = np.full(size, -1, np.int64)
                row[size - wide :] = own[at : at + wide]
                rows[row.tobytes(), i] = None
        windows = np.array([np.frombuffer(r, np.int64) for r, _ in rows], np.int64).reshape(-1, size)
        return cls(
            vocabulary, [spelled[h] for h in vocabulary.tolist()], windows, (windows >= 0).sum(1),
            np.array([i for _, i in rows], np.int64), [k for k, _ in items],
        )


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the length compared; only suffixes not yet told apart are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = np.empty(n, np.int64)
    sorted_ = symbols[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    ranks[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    width = 1
    while True:
        last = np.concatenate((first[1:], [True]))
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            return order
        part = order[open_]
        nxt = part + width
        key = np.where(nxt < n, ranks[np.minimum(nxt, n - 1)] + 1, 0)
        group = ranks[part]
        again = np.lexsort((key, group))
        part, key, group = part[again], key[again], group[again]
        order[open_] = part
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        first[open_] = new
        ranks[part] = np.maximum.accumulate(np.where(new, open_, 0))
        width *= 2


class WaveletMatrix:
    """Rank queries on a sequence of symbols, one level per bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b & 1).astype(bool)
            ones = np.concatenate((np.zeros(1, np.int32), np.cumsum(one, dtype=np.int32)))
            self.levels.append((b, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate((symbols[~one], symbols[one]))
        self.first = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, ones, zeros in self.levels:
            at = np.where(symbol >> b & 1, zeros + ones[at], at - ones[at])
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    """Index over runs of symbols; runs are divided by a border that no pattern contains.

    Internally 0 ends the sequence, 1 is a border, and symbols follow.
    """

    def __init__(self, symbols: np.ndarray, run_start: np.ndarray, kinds: int):
        """``symbols`` of all runs one after the other, ``run_start`` true where a run begins."""
        n = len(symbols)
        place = np.arange(n) + np.cumsum(run_start)
        text = np.ones(n + int(run_start.sum()) + 1, np.int64)
        text[place], text[-1] = symbols + 2, 0
        self.source = np.full(len(text), -1, np.int64)
        self.source[place] = np.arange(n)
        # borders are told apart while sorting, so that equal runs are compared no further than their ends
        border = text == 1
        order = suffix_array(np.where(border, np.cumsum(border), np.where(text == 0, 0, text + int(border.sum()))))
        self.last = text[order - 1]
        self.wavelet = WaveletMatrix(self.last, max(1, (kinds + 1).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=kinds + 2))))
        # a walk towards the front must not cross a border: what follows one is sampled as well
        follows = np.concatenate(([True], border[:-1])) | border
        kept = (np.arange(len(text)) % SAMPLED == 0) | follows
        self.sample = np.where(kept[order], order, -1)

    def _back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, at)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all windows: those found, and their ranges of suffixes."""
        live = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.last))
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[live, k] + 2
            ended = symbol < 2
            new_low = np.where(ended, low, self._back(np.maximum(symbol, 0), low))
            new_high = np.where(ended, high, self._back(np.maximum(symbol, 0), high))
            some = new_low < new_high
            live, low, high = live[some], new_low[some], new_high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the runs of the suffix of each row: walk to the front until a sampled suffix."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = self.sample[rows[open_]]
            hit = at >= 0
            out[open_[hit]] = at[hit] + steps
            open_ = open_[~hit]
            rows[open_] = self._back(self.last[rows[open_]], rows[open_])
            steps += 1
        return self.source[out]


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence of a window inside one text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.windows) or not len(words.hash):
        return none
    symbol = np.minimum(np.searchsorted(phrases.vocabulary, words.hash), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[symbol] == words.hash
    if not known.any():
        return none
    begins = known & ~(np.concatenate(([False], known[:-1])) & np.concatenate(([False], words.text[1:] == words.text[:-1])))
    run = np.cumsum(begins) - 1
    sizes = np.bincount(run[known], minlength=int(run[-1]) + 1)
    kept = np.flatnonzero(known & (sizes[np.maximum(run, 0)] >= phrases.length.min()))
    if not len(kept):
        return none
    index = FMIndex(symbol[kept], begins[kept], len(phrases.vocabulary))
    found, low, high = index.search(phrases.windows)
    count = high - low
    rows = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first, window = kept[index.locate(rows)], np.repeat(found, count)
    # hashes brought them together, the spelling decides
    wrong = np.array([
        k for k in np.flatnonzero(covered(first, phrases.length[window], len(symbol))).tolist()
        if words.word(k) != phrases.words[symbol[k]]
    ], np.int64)
    good = np.searchsorted(wrong, first) == np.searchsorted(wrong, first + phrases.length[window])
    return first[good], window[good]


def covered(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in some occurrence."""
    step = np.bincount(first, minlength=n + 1) - np.bincount(first + length, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


Span = tuple[int, int, int, int]


def merged(*lists: list[Span]) -> list[Span]:
    """Spans of one text from several passes; those that overlap or follow each other word by word become one."""
    out: list[Span] = []
    for start, stop, first, words in sorted((s for own in lists for s in own), key=lambda s: (s[2], s[3])):
        if out and first <= out[-1][2] + out[-1][3]:
            a = out[-1]
            out[-1] = (a[0], max(a[1], stop), a[2], max(a[2] + a[3], first + words) - a[2])
        else:
            out.append((start, stop, first, words))
    return out


def _pass(phrases: Phrases, part: pa.RecordBatch) -> tuple[np.ndarray, list[list[Span]], list[set[int]]]:
    """Words of each text, its merged spans, and its items by number."""
    data, borders = utf8(part.column("content"))
    words = Words.of(data, borders)
    first, window = occurrences(words, phrases)
    spans: list[list[Span]] = [[] for _ in range(part.num_rows)]
    items: list[set[int]] = [set() for _ in range(part.num_rows)]
    if len(first):
        hit = covered(first, phrases.length[window], len(words.start))
        joins = hit[1:] & hit[:-1] & (words.text[1:] == words.text[:-1])
        opens = np.flatnonzero(hit & ~np.concatenate(([False], joins)))
        closes = np.flatnonzero(hit & ~np.concatenate((joins, [False])))
        letter = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
        text = words.text[opens]
        base, number = letter[borders[text]], np.searchsorted(words.text, text)
        ends = (letter[words.start[opens]] - base, letter[words.end[closes]] - base, opens - number, closes - opens + 1)
        for t, *span in zip(text.tolist(), *(x.tolist() for x in ends)):
            spans[t].append(tuple(span))
        for t, i in set(zip(words.text[first].tolist(), phrases.item[window].tolist())):
            items[t].add(i)
    return np.bincount(words.text, minlength=part.num_rows), spans, items


SPANS = "array<struct<start:int,stop:int,first:int,words:int>>"
_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "stop", "first", "words")]))


def find_passages(
    messages: DataFrame, items: DataFrame, message_id: str = "message_id", content: str = "content",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Benchmark passages in the chat messages: ``message_id, n_words, spans, items``, one row per input row.

    A window is ``window`` consecutive words of a benchmark item, or the whole item if it has fewer.  ``spans`` are the
    places to remove, merged and in order: code points from ``start`` to before ``stop``, covering ``words`` words
    from number ``first``.
    ``items`` are the ids, as text and sorted, of the items with an occurring window.  Null and wordless messages and
    items have no words; items with a null id are searched but not named; repeated items count once; extra columns are
    ignored.

    The benchmark is read in blocks of about ``block_bytes`` of text, by a hash of the item; one block, the usual case,
    means one pass over the messages without a shuffle.  The benchmark is meant to be far smaller than the messages.
    """
    bench = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = keyed(messages, message_id, content=content)
    for b in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        phrases = Phrases.of(sorted({(r["item"], r["text"]) for r in part.collect()}, key=str), window)
        spread = messages.sparkSession.sparkContext.broadcast(phrases)
        more = b < blocks - 1
        found = T.StructType.fromDDL(f"n_words bigint, spans {SPANS}, items array<string>" + ", content string" * more)
        rows = rows.mapInArrow(_search(spread, b > 0, more), T.StructType([rows.schema["key"], *found]))
    return rows.withColumnRenamed("key", message_id)


def _search(spread, later: bool, more: bool):
    """One pass: adds to what an earlier pass found, and hands the content on if there are more."""

    def run(batches):
        phrases = spread.value
        for batch in batches:
            for part in slices(batch, "content", SHARD_BYTES):
                n_words, spans, found = _pass(phrases, part)
                items = [{i for k in f if (i := phrases.items[k]) is not None} for f in found]
                if later:
                    before = [[tuple(s.values()) for s in own] for own in part.column("spans").to_pylist()]
                    spans = [merged(a, b) for a, b in zip(before, spans)]
                    items = [a.union(b) for a, b in zip(items, part.column("items").to_pylist())]
                arrays = [
                    part.column("key"), pa.array(n_words, pa.int64()),
                    pa.array([[dict(zip(("start", "stop", "first", "words"), s)) for s in own] for own in spans], _SPANS),
                    pa.array([sorted(own) for own in items], pa.list_(pa.string())),
                ]
                names = ["key", "n_words", "spans", "items"]
                if more:
                    arrays, names = [*arrays, part.column("content")], [*names, "content"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_passages(
    messages: DataFrame, items: DataFrame, content: str = "content", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The messages with all their columns and without the benchmark passages in their content; no shuffle."""
    packed = messages.select(F.struct(*messages.columns).alias("row"), F.col(content).alias("content"))
    found = find_passages(packed, items, "row", "content", item_id, item_text)
    clean = cut_spans(F.col("row").getField(content), F.col("spans")).alias(content)
    return found.select(*[clean if c == content else F.col("row").getField(c).alias(c) for c in messages.columns])


def cut_spans(content: Column, spans: Column) -> Column:
    """The text without the spans; a single space stands where one was cut out between other text."""
    ends = F.transform(spans, lambda s: s["stop"])
    n = F.size(spans)
    left = F.concat(F.array(F.lit(0)), ends)
    right = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(content)))
    kept = F.zip_with(left, right, lambda a, b: F.trim(content.substr(a + 1, b - a)))
    return F.when(n > 0, F.array_join(F.filter(kept, lambda t: t != ""), " ")).otherwise(content)

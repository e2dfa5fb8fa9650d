"""Token counts of chat messages under a sentence-piece BPE vocabulary, without producing the tokens.

Method: rank-synchronous array merging.  The distinct pre-tokens of a slice lie side by side in one ragged numpy
array.  In each round every pre-token finds its own lowest-ranked neighbouring pair, and all of them apply theirs at
the same time; a pre-token without a pair is finished, and its surviving symbols are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelgrid.llm.batches import keyed, map_rows

SPACE = "▁"
NONE = np.iinfo(np.int32).max
SEGMENT_CHARS = 1 << 20
HELD_CHARS = 1 << 21
CACHED_WORDS = 600_000
_CUT = re.compile("[^ ](?= )")


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut only in front of a space that follows another character."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + size)
        stop = cut.end() if cut else len(text)
        yield text[start:stop]
        start = stop


class PieceMerger:
    """Merge tables of a vocabulary, and the array merging of pre-tokens.

    Symbols are the vocabulary's pieces, then the single characters that only occur inside pieces.  A pair may merge
    if its joined text is a piece; pieces with better scores merge first, the leftmost of equals.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models without a normalisation table are counted this way")
        if not proto.trainer_spec.byte_fallback or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with byte fallback that keep all spaces are counted this way")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece crosses a word border")
        self.prefix = " " if proto.normalizer_spec.add_dummy_prefix else ""
        order = sorted({-p.score for p in proto.pieces if p.type == 1})
        dense = {s: r for r, s in enumerate(order)}
        rank = {p: dense[-proto.pieces[i].score] for p, i in normal.items()}
        symbol = dict(normal)
        for piece in normal:
            for c in piece:
                symbol.setdefault(c, len(proto.pieces) + len(symbol))
        self.symbol, self.pieces = symbol, len(proto.pieces)
        pairs = [
            (symbol[p[:k]] << 32 | symbol[p[k:]], rank[p], i)
            for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol
        ]
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        # a piece is calm if none of its later pairs can come before another copy of it in the same pre-token
        calm = np.ones(len(proto.pieces), bool)
        by_rank: dict[int, set[int]] = {}
        for key, r, i in pairs:
            by_rank.setdefault(r, set()).add(i)
            for part in (key >> 32, key & 0xFFFFFFFF):
                if part < len(calm) and r <= rank[proto.pieces[part].piece]:
                    calm[part] = False
        for same in by_rank.values():
            if len(same) > 1:
                calm[list(same)] = False
        self.calm = calm
        self.word = self._borders(normal)
        self.known: dict[str, int] = {}

    @staticmethod
    def _borders(pieces: dict[str, int]) -> re.Pattern:
        """Pattern of pre-tokens: the borders between them are those that no piece crosses.

        Always a space that follows another character; beyond that, both sides of an ASCII character that no longer
        piece holds, and the front of an ASCII mark that no piece holds behind a letter.
        """
        inner = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
        used = {c for ab in inner for c in ab}
        alone = {chr(c) for c in range(128) if chr(c) not in used and chr(c) != " "}
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} - alone
        while crossed := {b for a, b in inner if b in marks and a not in marks and a != SPACE}:
            marks -= crossed
        group = lambda chars: "".join(map(re.escape, sorted(chars)))
        stop, mark = group(alone | {" "}), group(marks)
        forms = [f" *[^{stop}{mark}]+", f" *[{mark}][^{stop}]*" if mark else "", f"[{group(alone)}]" if alone else "", " +"]
        return re.compile("|".join(filter(None, forms)))

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols; rank ``NONE`` where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, whose spaces are written as plain spaces."""
        counts = np.zeros(len(words), np.int64)
        if not words:
            return counts
        text = "".join(words).replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, inverse = np.unique(points, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), -1) for c in letters], np.int64)[inverse]
        bytes_of = 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)
        # what a symbol counts if it survives: a piece one, any other character its bytes
        cost = np.where((sym >= 0) & (sym < self.pieces), 1, bytes_of[inverse])
        seq = np.repeat(np.arange(len(words)), [len(w) for w in words])

        def look(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and piece of the pair that starts at each position."""
            nxt = np.minimum(i + 1, len(sym) - 1)
            r, m = self.pair(sym[i], sym[nxt])
            r[(nxt == i) | (seq[i] != seq[nxt])] = NONE
            return r, m

        rank, made = look(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                counts[seq[starts[done]]] = np.add.reduceat(cost, starts)[done]
                live = np.repeat(~done, sizes)
                sym, cost, seq, rank, made = (x[live] for x in (sym, cost, seq, rank, made))
                continue
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            fresh = np.concatenate(([True], (np.diff(hit) > 1) | (seq[hit[1:]] != seq[hit[:-1]])))
            run = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            first = np.concatenate(([True], seq[hit[1:]] != seq[hit[:-1]]))
            hit = hit[first | (self.calm[made[hit]] & self._all_calm(hit, seq, made) & (run % 2 == 0))]
            sym[hit], cost[hit] = made[hit], 1
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, cost, seq, rank, made = (x[keep] for x in (sym, cost, seq, rank, made))
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(changed)
            rank[changed], made[changed] = look(changed)
        return counts

    def _all_calm(self, hit: np.ndarray, seq: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Whether the lowest pair of a pre-token gives the same calm piece at all its places."""
        first = np.concatenate(([True], seq[hit[1:]] != seq[hit[:-1]]))
        return made[hit] == made[hit[np.flatnonzero(first)[np.cumsum(first) - 1]]]


@lru_cache(maxsize=2)
def _merger(model: bytes) -> PieceMerger:
    return PieceMerger(model)


class Counter:
    """Counts texts.  Distinct pre-tokens already counted stay in the Python worker, about ``CACHED_WORDS`` of them."""

    def __init__(self, model: bytes):
        self.merger = _merger(model)

    def __call__(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            if text:
                for part in segments(self.merger.prefix + text.replace(SPACE, " ")):
                    held.append((i, self.merger.word.findall(part)))
                    size += len(part)
                    if size >= HELD_CHARS:
                        self._add(held, total)
                        held, size = [], 0
        self._add(held, total)
        return total

    def _add(self, held: list[tuple[int, list[str]]], total: np.ndarray) -> None:
        known = self.merger.known
        if len(known) > CACHED_WORDS:
            known.clear()
        fresh = list(set().union(*(words for _, words in held)).difference(known))
        known.update(zip(fresh, self.merger.count(fresh).tolist()))
        for i, words in held:
            total[i] += sum(map(known.__getitem__, words))


def count_message_tokens(
    messages: DataFrame, model_path: str, message_id: str = "message_id", content: str = "content"
) -> DataFrame:
    """UTF-8 bytes and tokens of every message, for planning the context of a chat model.

    ``messages`` are the chat messages of planning sessions, one row each.  ``model_path`` is a file that the driver
    reads; its few hundred kilobytes travel with the tasks.  Returns ``message_id, n_bytes, n_tokens`` (both
    BIGINT), one row per input row, repeated rows included.  Null and empty contents count zero bytes and tokens; a
    null id stays null.  Texts of any length are counted in segments that end in front of a space.  Extra columns
    are ignored.  There is no shuffle.
    """
    model = open(model_path, "rb").read()

    def make():
        counter = Counter(model)

        def work(part: pa.RecordBatch):
            texts = part.column("content")
            size = [0 if t is None else len(t.encode()) for t in (texts.to_pylist())]
            return pa.array(size, pa.int64()), pa.array(counter([t or "" for t in texts.to_pylist()]), pa.int64())

        return work

    rows = keyed(messages, message_id, content=content)
    return map_rows(rows, "content", make, "n_bytes bigint, n_tokens bigint", message_id)

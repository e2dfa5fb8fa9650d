"""Token ids of many texts at once: unseen pre-tokens of a slice are merged together in ragged numpy arrays.

The symbols of all pre-tokens lie side by side.  In each round every pre-token finds its lowest-ranked pair and merges
all places of it; the merge list is proper (a merge comes after those of its parts), so a merge never makes a pair of a
lower rank, and this is the order that one merge at a time would take.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

from parcelgrid.llm.bpe_codec import _FORMS, _GAP, LONGEST_CACHED, SEGMENT_CHARS, Transducer, segments

HELD_WORDS = 600_000
NONE = np.iinfo(np.int64).max
_PIECES = regex.compile(f"{_FORMS}|\x20")
_COMMON = re.compile("[\0-\u0557]*")
#: Separators of ``str.split`` that are no white space here.
_CONTROL = re.compile("[\x1c-\x1f]")


def _words(text: str) -> list[str]:
    return [w for w in _GAP.split(text) if w] if _CONTROL.search(text) else text.split()


class BatchEncoder(Transducer):
    """The encoder of a vocabulary file, for lists of texts."""

    def __init__(self, spec: bytes):
        super().__init__(spec)
        order = sorted(self.pairs)
        self.keys = np.array(order, np.int64)
        self.values = np.array([self.pairs[k] for k in order], np.int64)
        self.inner_ids, self.final_ids = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        # pairs of single bytes, the first of which never ends a word, in a table of their own
        code = np.concatenate([self.inner_ids, self.final_ids])
        self.place = np.zeros(len(self.surface), np.int64)
        self.place[code] = np.arange(512)
        self.bytes_table = self.look_up(np.repeat(code, 512), np.tile(code, 512))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_buffer(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.held: dict[str, bytes] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and new symbol of each pair as one number, ``NONE`` where they do not merge."""
        key = left << 16 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_batch(self, pieces: Sequence[str]) -> list[bytes]:
        """Ids of each pre-token, none of them empty, as bytes of unsigned 32-bit integers."""
        if not pieces:
            return []
        data = [p.encode("utf-8") for p in pieces]
        size = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        seq, last = np.repeat(np.arange(len(data)), size), np.cumsum(size) - 1
        sym = self.inner_ids[raw]
        sym[last] = self.final_ids[raw[last]]
        pair = np.full(len(sym), NONE)
        pair[:-1] = self.bytes_table[self.place[sym[:-1]] * 512 + self.place[sym[1:]]]
        pair[last] = NONE
        done_seq, done_sym = [], []
        while True:
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            low = np.minimum.reduceat(pair, starts)
            long = np.diff(np.append(starts, len(seq)))
            finished = np.repeat(low == NONE, long)
            done_seq.append(seq[finished])
            done_sym.append(sym[finished])
            if finished.all():
                break
            going = ~finished
            best = np.repeat(low, long)[going]
            seq, sym, pair = seq[going], sym[going], pair[going]
            hit = pair == best
            twin = np.flatnonzero(hit[1:] & hit[:-1] & (seq[1:] == seq[:-1])) + 1
            if len(twin):  # a symbol that pairs with itself: every other place, from the left
                run = np.cumsum(np.concatenate(([0], np.diff(twin) != 1)))
                first = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
                hit[twin[(np.arange(len(twin)) - first[run]) % 2 == 0]] = False
            at = np.flatnonzero(hit)
            sym[at] = pair[at] & 0xFFFF
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            fresh = hit.copy()
            fresh[at[at > 0] - 1] = True
            fresh[at[at > 1] - 2] |= ~kept[at[at > 1] - 1]
            seq, sym, pair, fresh = seq[kept], sym[kept], pair[kept], np.flatnonzero(fresh[kept])
            after = np.minimum(fresh + 1, len(sym) - 1)
            inside = (after > fresh) & (seq[after] == seq[fresh])
            pair[fresh] = np.where(inside, self.look_up(sym[fresh], sym[after]), NONE)
        seq, sym = np.concatenate(done_seq), np.concatenate(done_sym)
        packed = sym[np.argsort(seq, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(seq, minlength=len(data)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, words: list[str]) -> None:
        plain = unicodedata.normalize("NFC", " ".join(words)).replace("Σ", "σ").lower().split(" ")
        # a word of letters is one piece
        mixed = [k for k, w in enumerate(plain) if not w.isalpha()]
        pieces = _PIECES.findall(" ".join([plain[k] for k in mixed]))
        unseen = list({*pieces, *(w for w in plain if w.isalpha())}.difference(" "))
        made = dict(zip(unseen, self.merge_batch(unseen)))
        self.held.update((w, made[p]) for w, p in zip(words, plain) if p.isalpha())
        word, found = iter(mixed), []
        for piece in [*pieces, " "] if mixed else []:
            if piece == " ":
                self.held[words[next(word)]] = b"".join(found)
                found = []
            else:
                found.append(made[piece])

    def _learn_rare(self, words: list[str]) -> None:
        self.held.update((w, array("I", e.ids).tobytes()) for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)))

    def _long(self, word: str) -> bytes:
        if _COMMON.fullmatch(word) or len(word) > SEGMENT_CHARS:
            return b"".join(self.encode(word))
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def encode_texts(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Words between white space are encoded once and held.  Those with a special token, or a character above
        ``U+0557``, whose class and normal form depend on the version of Unicode, are left to the tokenizers library;
        words longer than ``LONGEST_CACHED`` stream through the transducer.
        """
        if len(self.held) > HELD_WORDS:
            self.held.clear()
        split = [_words(s) for text in texts for s in (segments(text) if len(text) > SEGMENT_CHARS else (text,))]
        unseen = set(chain.from_iterable(split)).difference(self.held)
        long = {w for w in unseen if len(w) > LONGEST_CACHED}
        unseen -= long
        rare = set()
        if any(not _COMMON.fullmatch(t) or self.special_re.search(t) for t in texts):
            rare = {w for w in unseen if not _COMMON.fullmatch(w) or self.special_re.search(w)}
        if unseen - rare:
            self._learn(list(unseen - rare))
        if rare:
            self._learn_rare(list(rare))
        held, out, parts = self.held.__getitem__, [], iter(split)
        for text in texts:
            packed = []
            for _ in range(1 if len(text) <= SEGMENT_CHARS else sum(1 for _ in segments(text))):
                words = next(parts)
                plain = not long or long.isdisjoint(words)
                packed.append(b"".join(map(held, words) if plain else [self._long(w) if w in long else held(w) for w in words]))
            out.append(b"".join(packed))
        return out


@lru_cache(maxsize=2)
def batch_encoder(spec: bytes) -> BatchEncoder:
    return BatchEncoder(spec)

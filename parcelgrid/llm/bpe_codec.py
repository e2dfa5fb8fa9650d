"""BPE encoding of chat messages as a streaming transducer, and decoding as an incremental state machine.

Encoding.  A pre-token is read from left to right.  What is read later can change the tokens already formed only
near the reading head: the border between the part that both tokenisations share and the rest moves left across the
left half ``u`` of a merge ``(u, v)``, and the next merge that moves it must come later in the list and have a right
half that starts with ``u``.  The longest such chain, counted in symbols, is the merge list's sufficient lookahead.
Tokens further than that from the reading head are stable and are emitted; the rest is read again with what follows.
Memory is bounded by a constant, however long a pre-token is.

Decoding.  Tokens become bytes, and bytes become text as soon as a character is complete.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parcelgrid.llm.batches import keyed, map_rows

WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT_CHARS = 1 << 18
CACHED_WORDS = 300_000
LONGEST_CACHED = 64
NO_MERGE = 1 << 48
_CUT = re.compile(f"(?=[{WHITE}])")
_GAP = re.compile(f"[{WHITE}]+")


#: Pre-tokens of this tokenizer family (fixed pattern).
_FORMS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"
_PRETOKEN = regex.compile(_FORMS)
#: Letters and digits that the regex module knows but the interpreter's Unicode, like the tokenizer, does not yet.
_YOUNG = "".join(
    regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"))
)
_MAYBE_YOUNG = re.compile(f"[{min(_YOUNG, default=chr(0x10FFFF))}-\U0010ffff]")
_YOUNG_SET = frozenset(_YOUNG)
_PRETOKEN_YOUNG = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_YOUNG}]]+|[\p{{N}}--[{_YOUNG}]]|[^{WHITE}[[\p{{L}}\p{{N}}]--[{_YOUNG}]]]+"
)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut only in front of white space."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + size)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


class Transducer:
    """Encoder for a vocabulary file whose words end in a suffix (lower-cased, white space dropped)."""

    def __init__(self, spec: bytes):
        conf = json.loads(spec)
        model, names = conf["model"], [n.get("type") for n in (conf["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or names != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("only BPE files with word ends, NFC, white space and lower case steps are supported")
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {a + b: i for i, (a, b) in enumerate(merges)}
        if len(made) < len(merges) or any(made.get(x, -1) >= i for i, ab in enumerate(merges) for x in ab):
            raise ValueError("the merge list is not proper: a merge comes before the merges of its parts")
        self.lookahead = self.sufficient_lookahead(merges)
        self.block = 4 * self.lookahead + 1024
        if len(vocab) > 1 << 16:
            raise ValueError("ids are packed into 16 bits")
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.pairs = {a << 16 | b: rank << 16 | new for (a, b), (rank, new) in self.rank.items()}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.final = [vocab[c + self.suffix] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in conf["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        longest = sorted(self.special, key=len, reverse=True)
        self.special_re = re.compile("|".join(map(re.escape, longest)) or "(?!)")
        self.surface: list[str] = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.surface[i] = token
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.raw = [
            t.encode() if t in self.special else bytes(byte_of[c] for c in t.removesuffix(self.suffix))
            + (b" " if t.endswith(self.suffix) else b"")
            for t in self.surface
        ]
        self.words: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    @staticmethod
    def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
        """Symbols behind the reading head that later input can still change; one more for the word end."""
        chain: dict[str, int] = {}
        most = 0
        for left, right in merges:
            far = len(left) + max((chain.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
            chain[left] = max(far, chain.get(left, 0))
            most = max(most, far)
        return most + 1

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a short run of symbols, lowest rank first, leftmost of equals first."""
        find = self.pairs.get
        waiting = [find(a << 16 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while waiting:
            best = min(waiting)
            if best == NO_MERGE:
                break
            k, new = waiting.index(best), best & 0xFFFF
            ids[k : k + 2] = [new]
            del waiting[k]
            if k:
                waiting[k - 1] = find(ids[k - 1] << 16 | new, NO_MERGE)
            if k < len(waiting):
                waiting[k] = find(new << 16 | ids[k + 1], NO_MERGE)
        return ids

    def merged_block(self, ids: list[int]) -> list[int]:
        """The same for a long run, with a queue of pairs."""
        n = len(ids)
        ids, nxt, prev = ids[:], list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*self.rank[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(queue)
        while queue:
            _, new, k, pair = heapq.heappop(queue)
            j = nxt[k]
            if j >= n or ids[k] != pair[0] or ids[j] != pair[1]:
                continue
            ids[k], ids[j], nxt[k] = new, -1, nxt[j]
            if nxt[k] < n:
                prev[nxt[k]] = k
            for a in (prev[k], k):
                if a >= 0 and nxt[a] < n and (p := (ids[a], ids[nxt[a]])) in self.rank:
                    heapq.heappush(queue, (*self.rank[p], a, p))
        return [i for i in ids if i >= 0]

    def pretoken(self, word: str) -> Iterator[list[int]]:
        """Ids of one pre-token in portions, each emitted once no later symbol can change it."""
        data = word.encode("utf-8", "surrogatepass")
        if len(data) <= LONGEST_CACHED:
            yield self.merged([*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]])
            return
        start = 0
        while len(data) - start > self.block:
            ids = self.merged_block([*map(self.inner.__getitem__, data[start : start + self.block])])
            width, end = 0, 0
            for end, i in enumerate(ids):
                if width + len(self.raw[i]) > self.block - self.lookahead:
                    break
                width += len(self.raw[i])
            yield ids[:end]
            start += width
        yield self.merged_block([*map(self.inner.__getitem__, data[start:-1]), self.final[data[-1]]])

    def _short(self, pretoken: str) -> bytes:
        packed = self.pretokens.get(pretoken)
        if packed is None:
            packed = array("I", [i for part in self.pretoken(pretoken) for i in part]).tobytes()
            self.pretokens[pretoken] = packed
        return packed

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers, in portions."""
        for segment in segments(text):
            start = 0
            for m in self.special_re.finditer(segment):
                yield from self._plain(segment[start : m.start()])
                yield array("I", [self.special[m[0]]]).tobytes()
                start = m.end()
            yield from self._plain(segment[start:])

    def _plain(self, text: str) -> Iterator[bytes]:
        # capital sigma has one lower case here, wherever it stands in a word
        plain = _GAP.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        words, known = plain.split(" "), self.words
        if len(known) > CACHED_WORDS:
            known.clear()
            self.pretokens.clear()
        fresh = set(words).difference(known)
        young = _MAYBE_YOUNG.search(plain) and not _YOUNG_SET.isdisjoint(plain)
        pretokens = _PRETOKEN_YOUNG if young else _PRETOKEN
        long = {w for w in fresh if len(w) > LONGEST_CACHED}
        for word in fresh - long:
            known[word] = b"".join(map(self._short, pretokens.findall(word)))
        if not long:
            yield b"".join(map(known.__getitem__, words))
            return
        for word in words:
            if word in long:
                for m in pretokens.finditer(word):
                    for part in self.pretoken(m[0]):
                        yield array("I", part).tobytes()
            else:
                yield known[word]


class TextDecoder:
    """Incremental byte-to-text machine: its state is whether a token came before, and the bytes of an open character.

    ``table`` gives the bytes of each token, ``joiner`` stands between two tokens.  Bytes that are no UTF-8 become
    U+FFFD, as late as they are known to be wrong.
    """

    def __init__(self, table: list[bytes], joiner: bytes = b""):
        self.table, self.joiner, self.begun = table, joiner, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self.joiner.join(map(self.table.__getitem__, ids))
        if data or self.joiner:
            data, self.begun = (self.joiner if self.begun else b"") + data, True
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def transducer(spec: bytes) -> Transducer:
    return Transducer(spec)


def _spec(vocabulary_path: str) -> bytes:
    with open(vocabulary_path, "rb") as file:
        return file.read()


def encode_messages(
    messages: DataFrame, vocabulary_path: str, message_id: str = "message_id", content: str = "content"
) -> DataFrame:
    """Token ids of every chat message of the planning sessions.

    Returns ``message_id, tokens ARRAY<INT>``, one row per input row.  Null and empty contents give an empty array; a
    null id stays null; repeated rows stay repeated; extra columns are ignored.  The vocabulary file is read on the
    driver and travels with the tasks (a few megabytes).  No shuffle.
    """
    spec = _spec(vocabulary_path)

    def make():
        coder = transducer(spec)

        def work(part: pa.RecordBatch):
            texts = (t.as_py() or "" for t in part.column("content"))
            return [pa.array([array("I", b"".join(coder.encode(t))).tolist() for t in texts], pa.list_(pa.int32()))]

        return work

    return map_rows(keyed(messages, message_id, content=content), "content", make, "tokens array<int>", message_id)


def decode_messages(
    encoded: DataFrame, vocabulary_path: str, surface: bool = False, message_id: str = "message_id",
    tokens: str = "tokens",
) -> DataFrame:
    """Text of token ids: ``message_id, content``.

    With ``surface`` the vocabulary's own spellings are joined by spaces, as the library does for a file without a
    decoder; otherwise bytes are put together and word ends become spaces.  Null or empty arrays give empty text.
    """
    spec = _spec(vocabulary_path)

    def make():
        coder = transducer(spec)
        table = [s.encode() for s in coder.surface] if surface else coder.raw

        def work(part: pa.RecordBatch):
            out = []
            for ids in part.column("tokens").to_pylist():
                machine = TextDecoder(table, b" " if surface else b"")
                text = machine.feed(ids or []) + machine.finish()
                out.append(text if surface else text.rstrip(" "))
            return [pa.array(out, pa.string())]

        return work

    rows = keyed(encoded, message_id, tokens=tokens)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), *work(batch)], [message_id, "content"])

    return rows.mapInArrow(run, f"`{message_id}` {kind}, content string")


def codec_digests(
    messages: DataFrame, vocabulary_path: str, message_id: str = "message_id", content: str = "content",
    with_tokens: bool = False,
) -> DataFrame:
    """Encodes every message and decodes the result, keeping only digests: a check of a stored encoding.

    Ids and decoded text stream from the transducer through the decoder, so a message of any length needs constant
    memory beside its text.  Returns ``message_id, n_tokens BIGINT, ids_sha256, decoded_sha256`` (lower-case hex; of
    the ids as little-endian unsigned 32-bit integers, and of the surface form in UTF-8), and with
    ``with_tokens`` the ids as ``tokens ARRAY<INT>``.  Null counts as empty.
    """
    spec = _spec(vocabulary_path)

    def make():
        coder = transducer(spec)
        table = [s.encode() for s in coder.surface]

        def digests(text: str) -> tuple:
            kept = array("I")
            n, ids_hash, text_hash, machine = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder(table, b" ")
            for packed in coder.encode(text):
                if packed:
                    ids_hash.update(packed)
                    n += len(packed) // 4
                    if with_tokens:
                        kept.frombytes(packed)
                    text_hash.update(machine.feed(memoryview(packed).cast("I")).encode())
            text_hash.update(machine.finish().encode())
            return n, ids_hash.hexdigest(), text_hash.hexdigest(), kept

        def work(part: pa.RecordBatch):
            rows = [digests(t.as_py() or "") for t in part.column("content")]
            n, ids, decoded, kept = zip(*rows)
            tokens = [pa.array([np.frombuffer(k, np.int32) for k in kept], pa.list_(pa.int32()))] if with_tokens else []
            return pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), *tokens

        return work

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * with_tokens
    return map_rows(keyed(messages, message_id, content=content), "content", make, fields, message_id)

"""Language of chat messages by prediction by partial matching.

Method: every language has a byte context tree of orders 0 to 2 with frozen counts.  A byte costs the code length its
longest context gives; a byte that a context has not seen pays the context's escape and goes on in the next shorter
one, with the bytes seen before excluded.  Because the statistics are frozen, the cost of a byte depends on its two
predecessors only, so the tree is unrolled into one table per language and a message costs one look-up per byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parcelgrid.llm.batches import keyed, map_rows, slices, utf8

ORDER = 2
#: Symbols before training: 0 for all that is no letter, 26 letters without case, each byte from 0x80.
RAW_SYMBOLS = 1 + 26 + 128
_RAW = np.zeros(256, np.int64)
_RAW[ord("a") : ord("z") + 1] = _RAW[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_RAW[0x80:] = np.arange(27, RAW_SYMBOLS)
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class LanguageProfiles:
    """Code lengths in bits, indexed by (two symbols of context, symbol) and language; ``symbols`` maps bytes."""

    languages: tuple[str, ...]
    symbols: np.ndarray
    bits: np.ndarray

    @property
    def size(self) -> int:
        return int(self.symbols.max()) + 1


def contexts(data: np.ndarray, borders: np.ndarray, symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of every (context, symbol) of the texts, runs of non-letters as one; and each text's borders in it."""
    s = symbols[data]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    starts = borders[:-1][borders[:-1] < borders[1:]]
    keep[starts] = True
    moved = np.concatenate(([0], np.cumsum(keep)))[borders]
    s = s[keep]
    one, two = np.zeros_like(s), np.zeros_like(s)
    one[1:], two[2:] = s[:-1], s[:-2]
    first = moved[:-1][moved[:-1] < moved[1:]]
    one[first] = two[first] = 0
    second = first + 1
    two[second[second < len(s)]] = 0
    return (two * size + one) * size + s, moved


def profiles_from_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageProfiles:
    """Context trees from the counts of raw (context, symbol) indices of each language."""
    languages = tuple(sorted(counts))
    seen = {0}
    for grams, _ in counts.values():
        seen.update(np.unique(grams % RAW_SYMBOLS).tolist())
    # symbols never seen share one of their own, which every tree meets by escapes alone
    dense = np.full(RAW_SYMBOLS, len(seen), np.int64)
    dense[sorted(seen)] = np.arange(len(seen))
    size = len(seen) + 1
    bits = np.empty((size**3, len(languages)), np.float32)
    for k, language in enumerate(languages):
        grams, n = counts[language]
        table = np.zeros((size, size, size))
        a, b, c = grams // RAW_SYMBOLS**2, grams // RAW_SYMBOLS % RAW_SYMBOLS, grams % RAW_SYMBOLS
        np.add.at(table, (dense[a], dense[b], dense[c]), n)
        shorter = np.full(size, 1.0 / size)
        for order in (table.sum((0, 1)), table.sum(0), table):
            shorter = _escape(order, shorter)
        bits[:, k] = -np.log2(shorter).reshape(-1)
    return LanguageProfiles(languages, dense[_RAW], bits)


def _escape(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of one order: seen symbols by count, the others share the escape as the shorter order has them.

    The escape weighs as much as the number of different symbols seen.
    """
    new = (count > 0).sum(-1, keepdims=True)
    total = count.sum(-1, keepdims=True) + new
    unseen = np.where(count > 0, 0.0, shorter)
    left = unseen.sum(-1, keepdims=True)
    share = np.divide(unseen, left, out=np.zeros_like(unseen), where=left > 0)
    p = (count + new * share) / np.maximum(total, 1)
    return np.where(total > 0, p, np.broadcast_to(shorter, count.shape))


def learn_profiles(messages: DataFrame, lang: str = "lang", content: str = "content") -> LanguageProfiles:
    """Counts the contexts of all messages with a language and builds the profiles.

    Every row counts; tasks add up their own rows first, and what reaches the driver is one row per language and
    (context, symbol) that occurs, at most 155^3 per language.  Rows without language or content teach nothing.  No
    rows give profiles without a language.
    """
    rows = messages.filter(F.col(lang).isNotNull() & F.col(content).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(content).alias("content")
    )

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part in slices(batch, "content", SLICE_BYTES):
                names = part.column("lang").dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    data, borders = utf8(pc.filter(part.column("content"), pa.array(code == k)))
                    n = np.bincount(contexts(data, borders, _RAW, RAW_SYMBOLS)[0])
                    grams = np.flatnonzero(n)
                    sums = held.setdefault(name, [])
                    sums.append((grams, n[grams]))
                    if len(sums) > 16:
                        held[name] = [_added(sums)]
        for name, sums in held.items():
            grams, n = _added(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())],
                ["lang", "gram", "n"],
            )

    counted = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    lang_of = np.array(table.column("lang").to_pylist(), object)
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    return profiles_from_counts({name: (gram[lang_of == name], n[lang_of == name]) for name in set(lang_of)})


def _added(sums: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in sums]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in sums]), len(grams)).astype(np.int64)


def code_lengths(data: np.ndarray, borders: np.ndarray, profiles: LanguageProfiles) -> np.ndarray:
    """Bits of every text under every language."""
    out = np.zeros((len(borders) - 1, len(profiles.languages)))
    index, moved = contexts(data, borders, profiles.symbols, profiles.size)
    full = moved[:-1] < moved[1:]
    if full.any():
        out[full] = np.add.reduceat(profiles.bits[index], moved[:-1][full], axis=0, dtype=np.float64)
    return out


def identify_languages(
    messages: DataFrame, profiles: LanguageProfiles, message_id: str = "message_id", content: str = "content"
) -> DataFrame:
    """Language of every chat message: ``message_id, lang_pred, score``.

    ``lang_pred`` is the language with the shortest code, the first by name of equals, and ``score`` its share of the
    probability under equal priors.  Null contents, contents without a letter, and all contents when the profiles
    have no language are ``und`` with score 0.  One row per input row; whole texts are read; extra columns are
    ignored.  The profiles travel with the tasks: their size depends on the bytes in use and the number of languages.
    """
    spread = messages.sparkSession.sparkContext.broadcast(profiles)

    def make():
        model = spread.value

        def work(part: pa.RecordBatch):
            letters = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            n, score, pred = part.num_rows, np.zeros(part.num_rows), np.full(part.num_rows, "und", object)
            if model.languages and letters.any():
                bits = code_lengths(*utf8(part.column("content")), model)
                best = bits.argmin(1)
                share = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                pred = np.where(letters, np.array(model.languages, object)[best], "und")
                score = np.where(letters, share, 0.0)
            assert len(pred) == n
            return pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64())

        return work

    letters = F.coalesce(F.col(content).rlike(r"\p{L}"), F.lit(False))
    rows = keyed(messages, message_id, content=content, letters=letters)
    return map_rows(rows, "content", make, "lang_pred string, score double", message_id, SLICE_BYTES)

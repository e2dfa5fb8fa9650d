"""Packed sequences against the tokenizer library, and the plan against exhaustive search."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parcelgrid.fixtures import Fixtures
from parcelgrid.llm import packing as pk, ragged_bpe
from parcelgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts, end=1):
    tokenizer = Tokenizer.from_file(WORDS)
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_sequences(rows, window):
    """Gapless sequences, all full but for one of each smaller power of two."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(held) == list(range(len(held)))
    sizes = []
    for pieces in held.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place and length > 0
            place += length
        sizes.append(place)
    short = [s for s in sizes if s != window]
    assert len(set(short)) == len(short) and all(s < window and s & s - 1 == 0 for s in short)


def test_filling_comes_closest_to_the_room():
    rng = random.Random(4)
    for _ in range(200):
        room, counts = rng.randint(0, 30), np.zeros(33, np.int64)
        for _ in range(rng.randint(0, 5)):
            counts[rng.randint(1, 32)] = rng.randint(1, 3)
        used = pk.best_filling(counts, room)
        assert all(0 < n <= counts[length] for length, n in used.items())
        items = [length for length in range(33) for _ in range(counts[length])]
        sums = {sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
        assert sum(length * n for length, n in used.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("window", [1, 8, 64, 2048])
def test_every_rank_has_one_place(window):
    rng = np.random.default_rng(window)
    for _ in range(12):
        counts = np.zeros(window + 1, np.int64)
        kinds = rng.integers(1, min(window, 40) + 1)
        counts[rng.choice(np.arange(1, window + 1), kinds, replace=False)] = rng.integers(1, 60, kinds)
        plan, total = pk.Plan(counts, window), int((counts * np.arange(window + 1)).sum())
        taken, filled = {}, np.zeros(plan.n_sequences, np.int64)
        for length, first, last, per, sequence, offset in plan.fills:
            for r in range(first, last):
                at = sequence + (r - first) // per
                taken.setdefault(length, []).append(r)
                filled[at] += length
        for length, first, last, parts in plan.cuts:
            taken.setdefault(length, []).extend(range(first, last))
            assert sum(size for size, _ in parts) == length
        assert all(sorted(r) == list(range(len(r))) for r in taken.values())
        assert filled.sum() == total and plan.n_sequences == total // window + (total % window).bit_count()


def test_one_length_of_a_billion_pieces_stays_a_short_plan():
    counts = np.zeros(2049, np.int64)
    counts[1100] = 10**9
    plan = pk.Plan(counts, 2048)
    assert len(plan.fills) + len(plan.cuts) < 2000 and plan.n_sequences == 1100 * 10**9 // 2048 + (1100 * 10**9 % 2048).bit_count()


def test_messages_of_sessions(spark):
    messages = Fixtures(spark, SF).messages
    rows = pk.pack_messages(messages, WORDS, window=64).collect()
    check_sequences(rows, 64)
    source = messages.select("session_id", "seq", "text").collect()
    pieces = {}
    for r in rows:
        pieces.setdefault((r.session_id, r.seq), []).append(r)
    assert len(pieces) == len(source)
    for m, ids in zip(source, library_ids([m.text for m in source])):
        mine = sorted(pieces[m.session_id, m.seq], key=lambda r: r.start)
        assert [i for r in mine for i in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.n_tokens == len(ids) and r.length == len(r.ids) // 4 for r in mine)
        assert [r.start for r in mine] == [sum(r.length for r in mine[:k]) for k in range(len(mine))]


def test_nulls_empty_long_repeated_and_clashing(spark):
    texts = [None, "", "a plot", "a plot", "road " * 60_000, "x" * 20_000, " \n ", "<|endoftext|>"]
    rows = [(None if k == 2 else k // 2, k, t, "i", 3, 4) for k, t in enumerate(texts)] + [(1, 3, "a plot", "i", 3, 4)]
    df = spark.createDataFrame(rows, "session_id int, seq int, text string, ids string, length int, start int").repartition(3)
    got = pk.pack_messages(df, WORDS).collect()
    assert got[0].__fields__ == ["session_id", "seq", "start", "length", "n_tokens", "ids", "sequence_id", "offset"]
    check_sequences(got, 2048)
    totals = {}
    for r in got:
        totals[r.seq] = totals.get(r.seq, 0) + r.length
    want = {k: len(ids) for k, ids in enumerate(library_ids(texts))}
    want[3] *= 2
    assert totals == want
    assert pk.pack_messages(df.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        pk.pack_messages(df, WORDS, keys=["ids"])
    with pytest.raises(ValueError):
        pk.pack_messages(df, WORDS, window=100)


def some_text(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(rng.choice("aaab ") for _ in range(rng.randint(0, 60)))
    if kind == 1:
        return "".join(rng.choice([*"the road's plot İßΣσς 12 ,.!?-é日本🙂\u0301\t\n\x1c\x85 हिन्", "<|endoftext|>"]) for _ in range(rng.randint(0, 80)))
    if kind == 2:
        return "".join(chr(rng.randrange(32, 0x557)) for _ in range(rng.randint(0, 60)))
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 30)))


def test_batches_of_texts_against_the_library(monkeypatch):
    monkeypatch.setattr(ragged_bpe, "HELD_WORDS", 500)
    rng, coder = random.Random(5), ragged_bpe.BatchEncoder(open(WORDS, "rb").read())
    for _ in range(8):
        texts = [some_text(rng) for _ in range(200)] + ["road plot, " * 40_000, "ab" * 3_000, "\x1c" * 3, ""]
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode_texts(texts)] == [i[:-1] for i in library_ids(texts)]
    assert coder.merge_batch([]) == [] and coder.encode_texts([]) == []


def test_query_against_the_library(spark):
    rows = QUERIES["op13_packing"](spark, SF).collect()
    check_sequences(rows, 2048)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([d.doc_id for d in docs], library_ids([d.text for d in docs])))
    covered = {d: 0 for d in ids}
    for r in rows:
        some = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(some) == r.length and zlib.crc32(some.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
    assert covered == {d: len(i) for d, i in ids.items()}

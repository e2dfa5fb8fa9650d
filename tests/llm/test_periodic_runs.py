"""Periodic runs of messages against brute force over every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelgrid.fixtures import Fixtures
from parcelgrid.llm import periodic_runs as pr
from parcelgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every stretch of every lag; the smallest lag of a stretch is its period."""
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        same = (ids[:-q] == ids[q:]).astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same, [0]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((s, e - s + q), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def side_by_side(texts):
    words = [w for t, text in enumerate(texts) for w in [*text, -2 - t]]
    text_no = [t for t, text in enumerate(texts) for _ in range(len(text) + 1)]
    return np.array(words, np.int64), np.array(text_no, np.int64)


def some_text(rng):
    letters = rng.choice([1, 2, 2, 3, 4, 10])
    text = [rng.randrange(letters) for _ in range(rng.randint(0, 100))]
    if text and rng.random() < 0.5:
        period = [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
        text = text[: rng.randint(0, 10)] + period * rng.randint(1, 6) + text[: rng.randint(0, 20)]
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = letters
    return text


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_of_random_texts(least):
    rng = random.Random(least)
    for _ in range(400):
        texts = [some_text(rng) for _ in range(rng.randint(1, 4))]
        words, text_no = side_by_side(texts)
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        mine = [[] for _ in texts]
        for s, length, q in zip(*(c.tolist() for c in pr.find_runs(words, text_no, least))):
            mine[text_no[s]].append((s - int(first[text_no[s]]), length, q))
        assert mine == [brute(t, least) for t in texts]


def test_grams_that_share_a_key_are_told_apart():
    rng = random.Random(3)
    words, text_no = side_by_side([[rng.randrange(3) for _ in range(300)], [rng.randrange(3) for _ in range(200)]])
    at, group = pr.gram_groups(words, text_no, 4, mix=0)
    seen = {}
    for i, g in zip(at.tolist(), group.tolist()):
        seen.setdefault((text_no[i], *words[i : i + 4].tolist()), set()).add(g)
    assert all(len(g) == 1 for g in seen.values()) and len(seen) == len({g for s in seen.values() for g in s})
    assert len(at) == len(pr.gram_groups(words, text_no, 4)[0])


def test_work_grows_with_the_text_where_one_word_fills_it():
    """Pairs of occurrences would be half a million million here."""
    at = np.arange(1_000_000)
    place, _ = pr.seeds(at, np.zeros(len(at), np.int64), 6, 1, 12)
    assert len(place) <= 2 * len(at)
    words, text_no = side_by_side([[0] * 200_000 + [1] + [0] * 200_000, list(range(1000)) * 40])
    start, length, period = pr.find_runs(words, text_no, 12)
    assert [*zip(start, length, period)] == [(0, 200_000, 1), (200_001, 200_000, 1), (400_002, 40_000, 1000)]


def test_messages_of_sessions(spark):
    messages = Fixtures(spark, SF).messages
    loop = F.when(F.col("seq") % 2 == 0, F.concat("text", F.repeat(F.lit(" so the plot stays green"), 5))).otherwise(F.col("text"))
    messages = messages.withColumn("text", loop)
    got = {(r.session_id, r.seq): r for r in pr.message_runs(messages).collect()}
    rows = messages.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs, mine = brute(words), got[r.session_id, r.seq]
        assert [tuple(x) for x in mine.runs] == runs and mine.n_words == len(words)
        assert mine.collapsed == collapsed(words, runs)
    assert any(r.runs for r in got.values())


def test_nulls_empty_long_repeated_and_clashing(spark):
    loop = "a b c " * 30_000
    rows = [(1, 1, "x y " * 9), (1, 1, "x y " * 9), (None, 2, None), (2, None, ""), (3, 1, " \n\t\x0b "), (4, 1, loop),
            (5, 1, " x\x1cy " * 12), (6, 1, "Ä" * 300_000)]
    df = spark.createDataFrame(
        [(*r, "k", "r", 7) for r in rows], "session_id int, seq int, text string, key string, runs string, n_words int")
    got = pr.message_runs(df).collect()
    assert got[0].__fields__ == ["session_id", "seq", "n_words", "runs", "collapsed"] and len(got) == len(rows)
    by = {(r.session_id, r.seq): ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in got}
    assert by[1, 1] == ([(0, 18, 2)], "x y", 18) and sum(r.session_id == 1 for r in got) == 2
    assert by[None, 2] == by[2, None] == by[3, 1] == ([], "", 0)
    assert by[4, 1] == ([(0, 90_000, 3)], "a b c", 90_000)
    assert by[5, 1] == ([(0, 12, 1)], " x\x1cy", 12) and by[6, 1] == ([], "Ä" * 300_000, 1)
    assert pr.message_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.message_runs(df, keys=["runs"])


def test_long_text_in_chunks(monkeypatch):
    rng = random.Random(8)
    for _ in range(20):
        data = " ".join(rng.choice(["ab", "c", "déf", "\t\n"]) for _ in range(200)).encode()
        assert b"".join(pr.chunks(data, 7)) == data
        assert [w for c in pr.chunks(data, 7) for w in c.split()] == data.split()


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = brute(words), rows[d.doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()

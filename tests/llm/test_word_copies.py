"""Near copies of the pipeline against brute force over sets of five-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
from parcelgrid.llm import near_copies


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def lowest(texts):
    sets, group = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    return group


def edited(words, r, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"x{r.randrange(10_000)}"
    return " ".join(out)


def some_texts():
    r, texts = random.Random(6), {}
    for _ in range(25):
        base = [f"w{r.randrange(3_000)}" for _ in range(r.choice([60, 120, 400]))]
        for edits in (0, 0, 1, 2, len(base) // 60, len(base) // 40, len(base) // 12):
            texts[len(texts)] = edited(base, r, edits)
    # one group far larger than a cell, one passage in many texts
    base = [f"v{k}" for k in range(200)]
    for _ in range(150):
        texts[len(texts)] = edited(base, r, r.choice([1, 2, 3]))
        texts[len(texts)] = " ".join(base[:60]) + " " + " ".join(f"u{r.randrange(10_000)}" for _ in range(80))
    return texts


def test_groups_match_brute_force(spark):
    texts = some_texts()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {g.doc_id: g.component_id for g in near_copies.word_copy_groups(rows, "doc_id", "text").collect()}
    assert got == lowest(texts)


def test_stage_drops_copies_farther_than_two_bits(spark):
    r = random.Random(1)
    base = [f"w{k}" for k in range(100)]
    texts = {1: " ".join(base), 2: edited(base, r, 2), 3: " ".join(f"o{k}" for k in range(100))}
    assert (near_copies.fingerprint(texts[1]) ^ near_copies.fingerprint(texts[2])).bit_count() > near_copies.DISTANCE
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {d.doc_id for d in corpus_pipeline.near_copies(spark, rows, "").collect()} == {1, 3}

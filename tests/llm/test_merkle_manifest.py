"""Manifest and proofs against a tree built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.fixtures import Fixtures
from parcelgrid.llm import merkle_manifest as mm

SF = "/root/testdata/sf0.001"
FIELDS = ["session_id", "seq", "role", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        i //= 8
    return out


def expected(rows, group, order, received=None):
    """Sorted (order value, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[group], []).append((leaf(r[f] for f in FIELDS), r))
    names = sorted(groups, key=lambda g: (g is not None, str(g).encode()))
    for g in names:
        groups[g].sort(key=lambda x: (*((x[1][o] is not None, x[1][o]) for o in order), x[0]))
    trees = {g: tree([x[0] for x in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (own, r) in enumerate(groups[g]):
            proof = siblings(trees[g], i) + siblings(top, k)
            node = leaf(r[(received or {}).get(f, f)] for f in FIELDS)
            for before, after in proof:
                node = digest(before + node + after)
            out.append((*(r[o] for o in order), own, trees[g][-1][0], top[-1][0], tuple(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def collected(df):
    return sorted(((*r[:-3], tuple(tuple(s) for s in r[-3]), *r[-2:]) for r in df.collect()), key=str)


def test_messages_by_role_and_by_session(spark):
    messages = Fixtures(spark, SF).messages
    altered = messages.withColumn("arrived", F.when(F.col("seq") % 3 == 0, F.upper("text")).otherwise(F.col("text")))
    rows = altered.collect()
    got = collected(mm.message_manifest(altered, "role", ["session_id", "seq"], FIELDS, {"text": "arrived"}))
    assert got == expected(rows, "role", ["session_id", "seq"], {"text": "arrived"})
    assert {r[-1] for r in got} == {True, False}
    assert collected(mm.message_manifest(messages)) == expected(rows, "session_id", ["seq"])


@pytest.mark.parametrize("sizes", [[1], [8, 1, 9], [64, 65, 63], [513, 7], [1] * 70, []])
def test_sizes_of_groups(spark, monkeypatch, sizes):
    monkeypatch.setattr(mm, "BLOCK_NODES", 64)
    rng = random.Random(1)
    rows = [(g, i, None, f"t{rng.random()}") for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id int, seq int, role string, text string")
    assert collected(mm.message_manifest(df)) == expected(df.collect(), "session_id", ["seq"])


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(None, 1, "user", "ä🙂"), ("", 1, None, ""), ("é", None, "x", None), ("z", 2, "", "a"), ("z", 2, "", "a"), ("z", 2, "", "b"),
            ("z", None, None, None), ("Z", 3, "-", "-"), (None, 1, "user", "word " * 200_000)]
    schema = "session_id string, seq int, role string, text string"
    df = spark.createDataFrame(rows, schema)
    want = expected(df.collect(), "session_id", ["seq"])
    clash = df.selectExpr("*", "1 AS _g", "'p' AS proof", "'x' AS _node", "2 AS rn", "3 AS n", "4 AS root", "5 AS _o0")
    assert collected(mm.message_manifest(clash)) == want
    assert len({r[1] for r in want}) == 8  # a repeated row has the same leaf, a null is no empty text
    with pytest.raises(ValueError):
        mm.message_manifest(df, order=["leaf"])
    with pytest.raises(ValueError):
        mm.message_manifest(df, received={"colour": "role"})

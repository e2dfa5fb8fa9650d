"""Every stage of the pipeline against brute force, on all that its predecessor kept."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from parcelgrid.llm import queries
from parcelgrid.session import cut_lineage
from tests.llm.test_word_copies import lowest
from tests.oracle import open_duckdb

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_stages(spark):
    con = open_duckdb(SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        tables[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe_codec" or docs.columns == columns

    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op7_quality_rules']}) WHERE kept").fetchall()}
    assert set(tables["quality_rules"]) == kept

    group = lowest({i: r.text for i, r in tables["quality_rules"].items()})
    assert set(tables["near_copies"]) == set(group.values())

    windows = set()
    for (text,) in con.execute("SELECT text FROM benchmark").fetchall():
        own = WORD.findall(lowered(text or ""))
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9)) if own}
    for i, r in tables["decontamination"].items():
        before = tables["near_copies"][i]
        own = WORD.findall(lowered(before.text))
        hit = {p for k in range(len(own)) for w in (10,) if tuple(own[k : k + w]) in windows for p in range(k, k + w)}
        assert WORD.findall(lowered(r.text)) == [w for p, w in enumerate(own) if p not in hit]
        assert r.n_chars == len(r.text) and (hit or r == before)

    for i, r in tables["secret_scans"].items():
        before = tables["decontamination"][i]
        found = [m for m in ASSIGN.finditer(before.text) if len(m[1]) >= 6] or re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", before.text)
        assert not re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text)
        assert ("[secret]" in r.text) >= bool(found) and (found or "[secret]" in r.text or r == before)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(tables["bpe_codec"]) == set(tables["secret_scans"])
    for i, r in tables["bpe_codec"].items():
        ids = library.encode(tables["secret_scans"][i].text, add_special_tokens=False).ids
        assert r.tokens == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_odd_documents_go_through(spark):
    text = "one two three four five six seven eight nine ten eleven twelve " * 9
    rows = [(1, None), (None, text), (2, ""), (3, text), (3, text), (None, None), (4, "x" * 200_000)]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "n_words": ["clash"] * 7, "key": [1] * 7})
    docs = spark.createDataFrame(table)
    for name, stage in corpus_pipeline.STAGES:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, SF)
            assert name == "bpe_codec" or out.columns == docs.columns
            out.collect()

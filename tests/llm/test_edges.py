"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parcelgrid.llm import (
    bpe_codec, decontaminate, language, main_text, near_copies, quality_rules, secrets, token_counts, toxicity,
    url_filters,
)

SCHEMA = (
    "message_id bigint, content string, key string, text string, spans string, kept string, fp string, n_words string, "
    "component_id string, words string, _words string, doc string, item string, lang string, score string"
)
LONG = "wort satz " * 40_000
TEXTS = [
    (1, "the plot has a road"), (1, "the plot has a road"), (None, "the plot has a road"), (2, None), (3, ""), (4, LONG),
    (5, " \n\t "), (6, "x" * 30_000), (7, "grüße 日本語 🙂 the plot"), (None, None), (1, "another text under the same id"),
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(*t, *["z"] * 13) for t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _items(df):
    return df.sparkSession.createDataFrame([(1, "plot has a"), (1, "plot has a"), (2, None), (3, ""), (None, "grüße")], "item_id long, text string")


def _language(df):
    return language.identify_languages(df, language.learn_profiles(df))


def _toxicity(df):
    model = toxicity.fit_toxicity(df, df.sparkSession.createDataFrame([(1, 1), (4, 0), (None, 1)], "message_id long, toxic int"))
    return toxicity.score_toxicity(df, model)


OPERATORS = {
    "secrets": secrets.find_secrets,
    "passages": lambda df: decontaminate.find_passages(df, _items(df)),
    "toxicity": _toxicity,
    "encode": lambda df: bpe_codec.encode_messages(df, WORDS),
    "digests": lambda df: bpe_codec.codec_digests(df, WORDS),
    "copies": near_copies.near_copy_groups,
    "rules": quality_rules.measure_messages,
    "verdicts": quality_rules.judge_messages,
    "tokens": lambda df: token_counts.count_message_tokens(df, PIECES),
    "language": _language,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_once(name, messages, nothing):
    got = OPERATORS[name](messages).collect()
    assert sorted(str(r.message_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    by_row = {}
    for r in got:
        by_row.setdefault(r.message_id, set()).add(str(r))
    assert len(by_row[1]) <= 2 and len(by_row[2]) == 1
    assert OPERATORS[name](nothing).collect() == []


def test_defined_results(messages):
    one = lambda df, i: next(r for r in df.collect() if r.message_id == i)
    assert one(secrets.find_secrets(messages), 2).spans == []
    found = decontaminate.find_passages(messages, _items(messages))
    assert one(found, 2).n_words == one(found, 3).n_words == one(found, 5).n_words == 0
    assert one(found, 7).spans[0].words == 1 and one(found, 7).items == []
    rules = quality_rules.measure_messages(messages)
    assert one(rules, 2).base_failed and not one(rules, 2).kept and one(rules, 4).n_repeat_words == 80_000
    tokens = token_counts.count_message_tokens(messages, PIECES)
    assert (one(tokens, 2).n_bytes, one(tokens, 2).n_tokens, one(tokens, 3).n_tokens) == (0, 0, 0)
    assert one(_language(messages), 2).lang_pred == "und" and one(_language(messages), 5).score == 0
    groups = near_copies.near_copy_groups(messages).collect()
    empty = [r for r in groups if r.fingerprint == "0" * 16]
    assert {r.message_id for r in empty} == {2, 3, 5, None} and {r.component_id for r in empty} == {2}
    assert one(bpe_codec.decode_messages(bpe_codec.encode_messages(messages, WORDS), WORDS), 1).content


def test_rows_keep_their_columns(messages):
    for out in (
        quality_rules.keep_messages(messages), near_copies.keep_first_copies(messages),
        decontaminate.remove_passages(messages, _items(messages)), secrets.redact_messages(messages),
    ):
        assert out.columns == messages.columns
        out.collect()
    first = near_copies.keep_first_copies(messages).select("message_id", "content").collect()
    assert len(first) == len(set(first)) and sum(r.content == "the plot has a road" for r in first) == 1


def test_links_and_pages(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), (None, "/", "block"), ("a.org", "/x", "block")], "host string, path string, verdict string")
    urls = [(1, "http://A.org/x?y"), (1, "http://A.org/x?y"), (None, "https://b.org/"), (2, None), (3, ""), (4, "no scheme"), (5, "x://a.org")]
    links = spark.createDataFrame(urls, "link_id long, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2))
    got = url_filters.filter_links(links, rules, default="none").collect()
    assert sorted((str(r.link_id), r.rule, r.verdict) for r in got if r.rule) == [("1", "a.org/x", "block")] * 2 + [("None", "org/", "allow")]
    assert len(got) == len(urls) and all(r.verdict == "none" for r in got if r.link_id in (2, 3, 4, 5))
    assert url_filters.filter_links(links.limit(0), rules).collect() == []

    pages = [(1, "u", "<article><p>a &lt; b<br>c</p></article><footer>f</footer>"), (1, "u", None), (None, None, ""), (2, "u", "<p " + "x" * 99_999), (3, "u", "<article>" + "<p>text here." * 3_000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("key", F.lit(1))
    labeller = main_text.BlockLabeller()
    assert main_text.extract_text(table, labeller).count() == 5
    assert main_text.extract_text(table.limit(0), main_text.fit_labeller(table.limit(0))).collect() == []

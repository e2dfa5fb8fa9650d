"""Quality rules for chat messages, as a short-circuit cascade.

Method: on a bounded sample every rule's cost, the time to evaluate it, and its selectivity, the share of messages it
rejects, are measured.  Rules are tried in the order of rejections per cost, and a message leaves the cascade at the
first rule that rejects it.  The order changes what a message costs, never its verdict.  All rules are column
expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 500
BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text: what ASCII white space leaves."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK, -1))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included.

    Most texts have no two windows with the same hash and end there.  In the others windows are sorted, by hash and
    then by their words, so that equal ones are neighbours, and their places are merged into covered words.
    """
    def count(w: Column) -> Column:
        return _with(_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _with(_sorted(w, h), _covered)).otherwise(0))

    return _with(words, lambda w: F.when(F.size(w) >= 3, count(w)).otherwise(0)).cast("long")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def _hashes(words: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )


def _sorted(words: Column, hashes: Column) -> Column:
    """All three-word windows and their places, equal ones next to each other."""
    return F.sort_array(F.transform(
        hashes, lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice(words, i + 1, 3), " ").alias("g"), i.alias("i"))
    ))


def _covered(ordered: Column) -> Column:
    same = lambda x, k: F.coalesce(F.get(ordered, k)["g"] == x["g"], F.lit(False))
    again = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    # a window adds the words that the window before it does not cover
    return F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])), start,
        lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(i - s["at"], F.lit(3))).alias("n")),
        lambda s: s["n"],
    )


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives, from the text and its words, the condition under which a message goes."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _letters(text: Column) -> Column:
    """Letters and the marks that write their vowels, as in Devanagari or Thai."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))


def _inked(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK, ""))


#: Base rules first, then the method's own; none rejects a message that only is unusual.
RULES = (
    Rule("few_words", lambda text, words: F.size(words) < 50),
    Rule("repeated_words", lambda text, words: 100 * repeated_words(words) > 50 * F.size(words)),
    Rule("symbols", lambda text, words: 10 * symbol_count(text) > 3 * F.size(words)),
    Rule("duplicate_lines", lambda text, words: 2 * duplicate_lines(text) > F.size(F.split(text, "\n", -1))),
    Rule("long_words", lambda text, words: F.length(text) > 40 * F.size(words)),
    Rule("few_letters", lambda text, words: 2 * _letters(text) < _inked(text)),
)
BASE = ("few_words", "repeated_words")


def order_rules(messages: DataFrame, content: str, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per second on at most ``sample_rows`` rows; without rows, as given."""
    text = F.coalesce(F.col(content), F.lit("")).alias("text")
    sample = messages.select(text).limit(sample_rows).persist()
    try:
        rows = sample.count()
        worth = []
        for rule in rules:
            rejected = F.count_if(rule.rejects(F.col("text"), F.col("words")))
            begun = time.perf_counter()
            n = sample.withColumn("words", words_of(F.col("text"))).agg(rejected).first()[0]
            worth.append(n / (time.perf_counter() - begun))
    finally:
        sample.unpersist()
    if not rows:
        return rules
    return tuple(r for _, _, r in sorted(((-w, k, r) for k, (w, r) in enumerate(zip(worth, rules))), key=lambda x: x[:2]))


def cascade(text: Column, words: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule in order that rejects, or null; later rules are not evaluated then."""
    out = F.when(rules[0].rejects(text, words), rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.rejects(text, words), rule.name)
    return out


def with_words(messages: DataFrame, content: str) -> DataFrame:
    """``messages`` and their words as ``_words``; the content as ``_text``, empty for null."""
    text = F.coalesce(F.col(content), F.lit(""))
    return messages.withColumn("_text", text).withColumn("_words", words_of(F.col("_text")))


def judge_messages(
    messages: DataFrame, message_id: str = "message_id", content: str = "content", rules: tuple[Rule, ...] = RULES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Verdict on every chat message: ``message_id, kept``, one row per input row.

    Null and empty contents have no words and are rejected for that.  Words are cut at ASCII white space.  Repeated
    rows are judged alike; extra columns are ignored.  No shuffle.
    """
    ordered = order_rules(messages, content, rules, sample_rows)
    rows = with_words(messages.select(F.col(message_id).alias("key"), F.col(content).alias("content")), "content")
    return rows.select(F.col("key").alias(message_id), cascade(F.col("_text"), F.col("_words"), ordered).isNull().alias("kept"))


def keep_messages(
    messages: DataFrame, content: str = "content", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The messages that no rule rejects, with all their columns."""
    ordered = order_rules(messages, content, rules, sample_rows)
    text = F.coalesce(F.col(content), F.lit(""))
    return messages.filter(_with(words_of(text), lambda words: cascade(text, words, ordered)).isNull())


def measure_messages(
    messages: DataFrame, message_id: str = "message_id", content: str = "content", rules: tuple[Rule, ...] = RULES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The verdict with the counts that the base rules use, for every message.

    ``message_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.  The base rules
    are decided from the counts; the cascade of the other rules runs only for messages that pass them.
    """
    extra = tuple(r for r in rules if r.name not in BASE)
    ordered = order_rules(messages, content, extra, sample_rows) if extra else ()
    rows = with_words(messages.select(F.col(message_id).alias("key"), F.col(content).alias("content")), "content")
    text, words = F.col("_text"), F.col("_words")
    counted = rows.select(
        F.col("key").alias(message_id), "_text", "_words", F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"), symbol_count(text).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = cascade(text, words, ordered).isNull() if ordered else F.lit(True)
    return counted.withColumn("base_failed", failed).select(
        message_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(passed).alias("kept"),
    )

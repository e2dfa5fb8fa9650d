"""Allow and block rules for the links of web pages.

Method: a sort-merge range join.  The labels of a host are reversed (``blog.example.org`` becomes
``org.example.blog.``), so a rule for a host and its subdomains is an interval of keys.  Links are range partitioned
and sorted by key; one sweep over a partition and the sorted rules keeps the rules whose interval is open on a stack.
The stack is never deeper than a host has labels.  Planning projects hold no web links, so the operator is general.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_SWEPT_RULES = 100_000


def host_of(url: Column) -> Column:
    """Host of a link, ASCII letters in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a link without query and fragment; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot, so that a host's key starts with the keys of its parents."""
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(key)


class Sweep:
    """Rules in key order and the stack of those that are open at the current key."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        """``rules``: key, path, rule text, verdict."""
        self.at: dict[str, list[tuple[str, str, str]]] = {}
        for key, path, text, verdict in sorted(rules):
            self.at.setdefault(key, []).append((path, text, verdict))
        self.keys = sorted(self.at)
        self.stack: list[str] | None = None
        self.next = 0

    def move(self, key: str) -> None:
        """To a key that is not smaller than the one before; the first key may lie anywhere."""
        if self.stack is None:
            self.next = bisect_right(self.keys, key)
            ends = [0, *(i + 1 for i, c in enumerate(key) if c == ".")]
            self.stack = [key[:e] for e in ends if key[:e] in self.at]
            return
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            new = self.keys[self.next]
            while self.stack and not new.startswith(self.stack[-1]):
                self.stack.pop()
            self.stack.append(new)
            self.next += 1
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()

    def find(self, path: str) -> tuple[str, str] | None:
        """Text and verdict of the longest open rule whose path fits; of equals the first in text order."""
        fits = ((-len(text), text, verdict) for k in self.stack for start, text, verdict in self.at[k] if path.startswith(start))
        best = min(fits, default=None)
        return best and best[1:]


def filter_links(
    links: DataFrame, rules: DataFrame, link_id: str = "link_id", url: str = "url", default: str = "allow",
    most_swept: int = MOST_SWEPT_RULES,
) -> DataFrame:
    """Verdict on every link: ``link_id, host, path, rule, verdict``, one row per input row.

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all subdomains if the link's path starts with the
    rule's path; the longest rule text wins.  Of rules with the same text the first verdict by name holds.  Links
    without a fitting rule, null and malformed ones included, get a null rule and ``default``.  Rules with a null
    host, path or verdict are left out.  Extra columns are ignored.

    Up to ``most_swept`` rules travel with the tasks, which is checked before; more are joined by key to the parents
    of the distinct hosts.  Path and id are part of the sort order, so a host with most of the links is split.
    """
    text = F.concat("host", "path")
    clean = rules.select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict"
    ).dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keyed_rules = clean.select(host_key(F.col("host")).alias("key"), "path", text.alias("rule"), "verdict")
    split = links.select(F.col(link_id).alias("link_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    split = split.withColumn("key", host_key(F.col("host")))
    held = keyed_rules.take(most_swept + 1)
    if len(held) > most_swept:
        return _joined(split, keyed_rules, default).withColumnRenamed("link_id", link_id)
    plain = [tuple(r) for r in held]
    kind = split.schema["link_id"].dataType.simpleString()

    def sweep(batches):
        state = Sweep(plain)
        for batch in batches:
            key, path = batch.column("key").to_pylist(), batch.column("path").to_pylist()
            found = []
            for k, p in zip(key, path):
                state.move(k)
                found.append(state.find(p) or (None, default))
            texts, verdicts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("link_id"), batch.column("host"), batch.column("path"),
                 pa.array(texts, pa.string()), pa.array(verdicts, pa.string())],
                ["link_id", "host", "path", "rule", "verdict"],
            )

    ordered = split.repartitionByRange("key", "path", "link_id").sortWithinPartitions("key")
    out = ordered.mapInArrow(sweep, f"link_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("link_id", link_id)


def _joined(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for rule tables of any size: rules meet the parents of each distinct (host, path)."""
    places = split.select("key", "path").distinct()
    labels = F.split(F.rtrim(F.col("key"), F.lit(".")), r"\.", -1)
    parents = F.transform(
        F.sequence(F.lit(0), F.size(labels)),
        lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))),
    )
    up = places.select("key", "path", F.explode(F.array_distinct(parents)).alias("parent"))
    hit = up.join(rules.select(F.col("key").alias("parent"), F.col("path").alias("start"), "rule", "verdict"), "parent")
    hit = hit.filter(F.col("path").startswith(F.col("start")))
    best = hit.groupBy("key", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best")
    )
    return split.join(best, ["key", "path"], "left").select(
        "link_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )

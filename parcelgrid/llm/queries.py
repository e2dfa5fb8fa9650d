"""Registered queries of the operators: each maps a given table to the operator's records and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def messages_of(documents: DataFrame) -> DataFrame:
    """Documents as chat messages of planning sessions: the source is the session."""
    return documents.select(
        F.col("doc_id").alias("message_id"), F.col("source").alias("session_id"), F.col("text").alias("content")
    )


def read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the messages of planning sessions, keyed by session and number: the source is the session."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), "text")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.bpe_codec import codec_digests

    out = codec_digests(read_messages(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return out.withColumnRenamed("message_id", "doc_id")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.token_counts import count_message_tokens

    out = count_message_tokens(read_messages(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return out.select(F.col("message_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def held_out(key: str) -> Column:
    """Whether a row is kept from training; a null id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.toxicity import fit_toxicity, score_toxicity

    messages = read_messages(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("message_id"), "toxic")
    known = labels.filter(F.col("message_id").isNotNull() & ~held_out("message_id"))
    model = fit_toxicity(messages, known)
    return score_toxicity(messages, model).select(
        F.col("message_id").alias("doc_id"), held_out("message_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


#: Rules of the contract (fixed values).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.url_filters import filter_links

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_links(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, "page_id", "url")


ORACLES["op8_url_filters"] = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.language import identify_languages, learn_profiles

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = documents.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    profiles = learn_profiles(known, content="text")
    return identify_languages(messages_of(documents), profiles).select(
        F.col("message_id").alias("doc_id"), held_out("message_id").alias("held_out"), "lang_pred", "score"
    )


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.near_copies import near_copy_groups

    return near_copy_groups(read_messages(spark, sf_dir)).withColumnRenamed("message_id", "doc_id")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.decontaminate import find_passages

    found = find_passages(read_messages(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(
        F.col("message_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.secrets import KINDS, find_secrets, spans_text

    found = find_secrets(read_messages(spark, sf_dir))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        F.col("message_id").alias("doc_id"), *counts, F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.quality_rules import measure_messages

    return measure_messages(read_messages(spark, sf_dir)).withColumnRenamed("message_id", "doc_id")


ORACLES["op7_quality_rules"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
words AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), grams AS (
  SELECT row_no, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 1)) AS i FROM words)
), again AS (
  SELECT row_no, i FROM (SELECT *, count(*) OVER (PARTITION BY row_no, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT row_no, sum(least(3, i - coalesce(before, -3))) AS n
  FROM (SELECT *, lag(i) OVER (PARTITION BY row_no ORDER BY i) AS before FROM again) GROUP BY row_no
), counted AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(string_split(text, chr(10))) AS n_lines
  FROM words LEFT JOIN covered c USING (row_no)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR length(text) > 40 * n_words
            OR 2 * length(regexp_replace(text, '[^\p{L}\p{M}]+', '', 'g')) < length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))) AS kept
FROM judged
"""


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.main_text import extract_text, fit_labeller

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, fit_labeller(pages))


ORACLES["op1_secret_scans"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
patterns(family, pattern, inner_group) AS (VALUES
  ('assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
  ('access', 'AKIA[A-Z0-9]{16,}', 0), ('hex', '[0-9a-f]{24,}', 0),
  ('weak', 'https?://[^\s"''<>]+|(?:access|client|account|user)_?(?:key_?)?id["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{4,}|A[A-Z]{2}A[A-Z0-9]{12,}|[A-Za-z0-9+/_=-]{20,}', 0)
), found AS (
  SELECT row_no, 'assign' AS family, regexp_extract_all(text, (SELECT pattern FROM patterns WHERE family = 'assign'), 0) AS whole,
         regexp_extract_all(text, (SELECT pattern FROM patterns WHERE family = 'assign'), 2) AS value,
         string_split_regex(text, (SELECT pattern FROM patterns WHERE family = 'assign')) AS gaps FROM texts
  UNION ALL
  SELECT row_no, family, regexp_extract_all(text, pattern, 0), regexp_extract_all(text, pattern, 0), string_split_regex(text, pattern)
  FROM texts, patterns WHERE family <> 'assign'
), placed AS (
  SELECT row_no, family, whole[k] AS m, value[k] AS v,
         CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x)))
              + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM found WHERE len(whole) > 0)
), kinds AS (
  SELECT row_no, start, start + length(m) AS stop, CASE
    WHEN family = 'assign' THEN CASE WHEN length(v) >= 6 THEN 0 END
    WHEN family = 'access' THEN 1 WHEN family = 'hex' THEN 2
    WHEN regexp_matches(m, '^https?://') THEN 5
    WHEN regexp_matches(m, '^(?:access|client|account|user)_?(?:key_?)?id["'']?\x20*[:=]') THEN 3
    WHEN regexp_matches(m, '^A[A-Z]{2}A[A-Z0-9]{12,}$') THEN 3
    WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN 4 END AS kind
  FROM placed
), base AS (SELECT * FROM kinds WHERE kind < 3),
weak AS (
  SELECT * FROM kinds k WHERE kind > 2 AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.row_no = k.row_no AND k.start < b.stop AND b.start < k.stop)
), parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (
  SELECT * FROM weak w WHERE EXISTS (
    SELECT 1 FROM parts p WHERE p.row_no = w.row_no AND greatest(p.start - w.stop, w.start - p.stop) <= 200
      AND CASE WHEN w.kind = 4 THEN p.kind IN (1, 3, 5) ELSE p.kind IN (0, 2, 4) END)
), spans AS (
  SELECT row_no, start, kind, ['assign', 'access', 'hex', 'link_id', 'link_value', 'link_endpoint'][kind + 1] || ':' || start || ':' || stop AS s
  FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)
)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM texts LEFT JOIN spans USING (row_no) GROUP BY row_no, doc_id
"""


ORACLES["op2_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, n, array_to_string(words[k:k + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS k FROM (SELECT *, least(10, len(words)) AS n FROM items WHERE len(words) > 0))
), doc_windows AS (
  SELECT row_no, k, n, array_to_string(words[k:k + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM item_windows))
), hits AS (SELECT row_no, k, n, item FROM doc_windows JOIN item_windows USING (n, g)),
hit_words AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(k, k + n)) AS p FROM hits) GROUP BY row_no),
hit_items AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT row_no, item FROM hits) GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row_no) LEFT JOIN hit_items USING (row_no)
"""


def looping(messages: DataFrame) -> DataFrame:
    """Messages of which a tenth, by a hash of their number, get stuck at some word and repeat what follows it."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("seq").cast("string"))
    g, rest = F.floor(h / 10), F.col("_n") - F.col("_a")
    rows = messages.withColumn("_w", F.coalesce(words, F.array().cast("array<string>"))).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_stuck", F.coalesce(h % 10 == 0, F.lit(False)) & (F.col("_n") > 0))
    rows = rows.withColumn("_a", F.when(F.col("_stuck"), (g % F.col("_n")).cast("int")))
    rows = rows.withColumn("_p", 1 + F.floor(rest / (3 + g % 8)).cast("int"))
    again = F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))
    stuck = F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(F.flatten(again), F.lit(1), rest))
    return rows.withColumn("text", F.when(F.col("_stuck"), F.array_join(stuck, " ")).otherwise(F.col("text"))).select(*messages.columns)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.periodic_runs import message_runs

    found = message_runs(looping(session_messages(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("seq").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-longest["start"]).alias("start"),
        longest["length"].alias("length"), (-longest["period"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.merkle_manifest import message_manifest

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    rows = documents.withColumn("received_text", F.when(altered, lower).otherwise(F.col("text")))
    proved = message_manifest(
        rows, "lang", ["doc_id"], ["doc_id", "source", "lang", "n_chars", "text"], {"text": "received_text"}
    )
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelgrid.llm.packing import pack_messages

    packed = pack_messages(session_messages(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return packed.select(
        F.col("seq").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
        "sequence_id", "offset",
    )


ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE rows_of AS (
  SELECT doc_id, lang, text, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS fields,
         -- CRC-32, bit by bit
         list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, b: list_reduce(list_concat([xor(crc, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
             lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc
  FROM documents
), coded AS (
  SELECT *, array_to_string(list_transform(fields, lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '') AS head FROM rows_of
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS node,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || CASE WHEN xor(crc, 4294967295) % 3 = 0
           THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS arrived
  FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, node) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM leaves
), low(lang, level, pos, size, node) AS (
  SELECT lang, 0, pos, size, node FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, max((size + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE size > 1 GROUP BY lang, level, pos // 8
), subroots AS (
  SELECT lang, node, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1
), high(level, pos, size, node) AS (
  SELECT 0, pos, size, node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, max((size + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY level, pos // 8
), steps AS (
  SELECT lang, 0 AS tree, level, pos, size,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM low WINDOW w AS (PARTITION BY lang, level, pos // 8 ORDER BY pos)
), top_steps AS (
  SELECT level, pos, size,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM high WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)
), way AS (
  SELECT p.lang, p.pos, 0 AS tree, s.level, s.before, s.after FROM placed p JOIN steps s
    ON s.lang IS NOT DISTINCT FROM p.lang AND s.size > 1 AND s.pos = p.pos // CAST(pow(8, s.level) AS BIGINT)
  UNION ALL
  SELECT p.lang, p.pos, 1, t.level, t.before, t.after FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
    JOIN top_steps t ON t.size > 1 AND t.pos = r.pos // CAST(pow(8, t.level) AS BIGINT)
), proofs AS (
  SELECT lang, pos, string_agg(before || after, '' ORDER BY tree, level) AS proof, list(before || '|' || after ORDER BY tree, level) AS parts
  FROM way GROUP BY lang, pos
), folded AS (
  SELECT p.doc_id, p.node AS leaf, r.node AS subroot, (SELECT node FROM high WHERE size = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_concat([arrived], coalesce(parts, [])),
           lambda acc, part: sha256(string_split(part, '|')[1] || acc || string_split(part, '|')[2])) AS folded_root
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proofs f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""

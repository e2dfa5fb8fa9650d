"""Secrets in chat messages, with weak parts of credentials reported only when their counterparts are near.

Method: certain patterns are reported as they are.  Access identifiers, secret values and endpoints that mean little
alone become intervals; an interval join over bins of the message text links identifiers and endpoints to secrets
within ``scope`` code points, and only linked weak parts are added.  Everything is DataFrame operations: one pass over
the texts writes the intervals, a few numbers for each part found, and only those are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.session import cut_lineage

#: Certain patterns (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
#: Weak parts, matched family by family: named (in any case, after any prefix) or typical identifiers, endpoints with a
#: scheme or a port, long runs of key characters.
ID = (
    r"(?i:(?:access|client|account|user)[_-]?(?:key[_-]?)?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
    r"|(?<![A-Za-z0-9])A[A-Z]{2}A[A-Z0-9]{12,}"
)
ENDPOINT = (
    r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s\"'<>]+"
    r"|(?<![A-Za-z0-9.-])(?:localhost|(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z0-9-]{1,63}):[0-9]{2,5}(?![A-Za-z0-9])"
)
VALUE = r"[A-Za-z0-9+/_=-]{20,}"
SCOPE = 200
KINDS = ("assign", "access", "hex", "link_id", "link_value", "link_endpoint")
_ASSIGN, _ACCESS, _HEX, _ID, _VALUE, _ENDPOINT = range(6)
PART = "struct<start:int,kind:int,stop:int>"


def _part(start: Column, kind: Column | int, stop: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), stop.cast("int").alias("stop"))


def _placed(text: Column, pattern: str, whole: Column, kinds: Column) -> Column:
    """Parts of all matches: a match starts after the pieces and matches before it.  Null kinds are left out.

    ``whole`` are the matches and ``kinds`` their kinds; the text is split only if there are any.
    """
    pieces = F.split(text, pattern, -1)
    sized = F.zip_with(F.slice(pieces, 1, F.size(whole)), whole, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PART}>").alias("parts"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        return F.struct(
            (start + m["size"]).alias("at"),
            F.concat(state["parts"], F.array(_part(start, 0, start + m["size"]))).alias("parts"),
        )

    parts = F.aggregate(sized, empty, step, lambda state: state["parts"])
    typed = F.zip_with(parts, kinds, lambda p, kind: _part(p["start"], kind, p["stop"]))
    none = F.array().cast(f"array<{PART}>")
    return F.when(F.size(whole) > 0, F.filter(typed, lambda p: p["kind"].isNotNull())).otherwise(none)


def _weak_parts(text: Column, ids: Column, endpoints: Column, values: Column) -> Column:
    """Parts of the three families; inside an endpoint there is no identifier, and no value overlaps one of the others."""
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    kind = lambda matches, k: F.transform(matches, lambda m: F.lit(k))
    placed = F.struct(
        _placed(text, ID, ids, kind(ids, _ID)).alias("ids"),
        _placed(text, ENDPOINT, endpoints, kind(endpoints, _ENDPOINT)).alias("ends"),
        _placed(text, VALUE, values, F.transform(values, lambda m: F.when(mixed(m), _VALUE))).alias("runs"),
    )

    def resolve(p: Column) -> Column:
        within = lambda a, b: (b["start"] <= a["start"]) & (a["stop"] <= b["stop"])
        free = F.filter(p["ids"], lambda a: ~F.exists(p["ends"], lambda b: within(a, b)))
        ends = F.filter(p["ends"], lambda a: ~F.exists(p["ids"], lambda b: within(a, b)))
        anchors = F.concat(p["ids"], p["ends"])
        runs = F.filter(p["runs"], lambda a: ~F.exists(anchors, lambda b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])))
        return F.array_sort(F.concat(free, ends, runs))

    return F.get(F.transform(F.array(placed), resolve), 0)


def _candidates(rows: DataFrame) -> DataFrame:
    """``key, base, weak``: certain and weak parts of every message, from one pass over the texts."""
    rows = rows.select("key", F.coalesce("text", F.lit("")).alias("text"))
    lit = F.lit
    matched = rows.select(
        "key", "text",
        F.regexp_extract_all("text", lit(ASSIGN), lit(0)).alias("m_assign"),
        F.regexp_extract_all("text", lit(ACCESS), lit(0)).alias("m_access"),
        F.regexp_extract_all("text", lit(HEX), lit(0)).alias("m_hex"),
        F.regexp_extract_all("text", lit(ID), lit(0)).alias("m_id"),
        F.regexp_extract_all("text", lit(ENDPOINT), lit(0)).alias("m_endpoint"),
        F.regexp_extract_all("text", lit(VALUE), lit(0)).alias("m_value"),
    ).withColumn(
        # the assigned values, for the least length
        "g_assign", F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", lit(ASSIGN), lit(2)))
    )
    long = F.transform("g_assign", lambda g: F.when(F.length(g) >= LEAST_ASSIGNED, _ASSIGN))
    all_ = lambda matches, kind: F.transform(matches, lambda m: F.lit(kind))
    base = F.array_sort(F.concat(
        _placed(F.col("text"), ASSIGN, F.col("m_assign"), long),
        _placed(F.col("text"), ACCESS, F.col("m_access"), all_("m_access", _ACCESS)),
        _placed(F.col("text"), HEX, F.col("m_hex"), all_("m_hex", _HEX)),
    ))
    weak = _weak_parts(*map(F.col, ("text", "m_id", "m_endpoint", "m_value")))
    # equal rows may share their links, other rows may not, even under one id
    doc = F.sha2(F.to_json(F.struct(F.col("key").cast("string").alias("k"), F.col("text").alias("t"))), 256)
    out = matched.select("key", "text", base.alias("base"), weak.alias("weak"))
    return out.select("key", "base", "weak", F.when(F.size("weak") > 0, doc).alias("doc"))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts with a counterpart at most ``scope`` code points away: ``doc, start, kind, stop``."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    anchors = parts.filter(F.col("kind").isin(_ACCESS, _ID, _ENDPOINT)).withColumn(
        "bin", bins(F.col("start") - scope, F.col("stop") + scope)
    )
    values = parts.filter(F.col("kind").isin(_ASSIGN, _HEX, _VALUE)).withColumn("bin", bins(F.col("start"), F.col("stop")))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(F.col("doc").alias("o_doc"), F.col("bin").alias("o_bin"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"))
        at = (F.col("doc") == F.col("o_doc")) & (F.col("bin") == F.col("o_bin"))
        gap = F.greatest(F.col("o_start") - F.col("stop"), F.col("start") - F.col("o_stop"))
        weak = left.filter(F.col("kind").isin(_ID, _VALUE, _ENDPOINT))
        return weak.join(other, at & (gap <= scope), "left_semi").select("doc", "start", "kind", "stop")

    return near(anchors, values).unionByName(near(values, anchors)).distinct()


def find_secrets(
    messages: DataFrame, message_id: str = "message_id", content: str = "content", scope: int = SCOPE
) -> DataFrame:
    """Secrets in every chat message: ``message_id, spans``, one row per input row.

    ``spans`` is ``ARRAY<STRUCT<start, kind, stop>>`` in code points, ``stop`` exclusive, sorted by start and kind;
    kinds are numbers of ``KINDS``.  Assignments, access keys and long hex numbers are always there.  Identifiers,
    mixed values and endpoints are there if they lie within ``scope`` of a counterpart, identifiers and endpoints of a
    secret and secrets of one of those, and overlap none of the certain ones.

    Null and empty contents have no spans; a null id stays null; repeated rows stay repeated; rows that share an id
    but not a text are kept apart; extra columns are ignored.
    """
    return _with_spans(messages.select(F.col(message_id).alias("key"), F.col(content).alias("text")), scope).withColumnRenamed(
        "key", message_id
    )


def redact_messages(messages: DataFrame, content: str = "content", scope: int = SCOPE) -> DataFrame:
    """The messages with all their columns and their secrets replaced by a mark."""
    packed = messages.select(F.struct(*messages.columns).alias("key"), F.col(content).alias("text"))
    found = _with_spans(packed, scope)
    clean = redact(F.col("key").getField(content), F.col("spans")).alias(content)
    return found.select(*[clean if c == content else F.col("key").getField(c).alias(c) for c in messages.columns])


def _with_spans(rows: DataFrame, scope: int) -> DataFrame:
    """``key, spans`` for rows of ``key, text``."""
    found = cut_lineage(_candidates(rows))
    some = found.filter(F.col("doc").isNotNull())
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (w["start"] < b["stop"]) & (b["start"] < w["stop"])))
    parts = some.select("doc", F.explode(F.concat("base", free)).alias("p")).select("doc", "p.*").distinct()
    added = _linked(parts, scope).groupBy("doc").agg(
        F.collect_list(F.struct("start", "kind", "stop")).alias("added")
    )
    joined = some.join(added, "doc", "left").select(
        "key", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{PART}>")))).alias("spans")
    )
    plain = found.filter(F.col("doc").isNull()).select("key", F.col("base").alias("spans"))
    return plain.unionByName(joined)


def spans_text(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, joined by commas."""
    name = lambda k: reduce(lambda c, x: c.when(k == x[0], x[1]), enumerate(KINDS), F)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["stop"])), ",")


def redact(content: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced by ``mark``."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(content.substr(state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        fresh = F.concat(state["out"], F.array(piece))
        return F.when(s["start"] >= state["at"], F.struct(s["stop"].alias("at"), fresh.alias("out"))).otherwise(
            F.struct(F.greatest(s["stop"], state["at"]).alias("at"), state["out"].alias("out"))
        )

    tail = lambda state: F.concat(F.array_join(state["out"], ""), content.substr(state["at"] + 1, F.length(content)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, empty, step, tail)).otherwise(content)

"""Near copies among chat messages, by SimHash fingerprints.

Method: a fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits.  The Manhattan distance
of two embeddings is at most the Hamming distance of the fingerprints, so it serves as a lower bound.  A grid over the
embedding finds the pairs to test: the segments form four blocks, a distance of two touches at most two of them, so
near fingerprints share a cell of at least one of the six grids over two blocks.  Pairs are tested by the lower bound
and then exactly.

Counts are kept in unary (none ``00``, one ``01``, two ``11``), which makes the Manhattan distance a bit count as well.

Two bits find little but exact copies, so the pipeline takes ``word_copy_groups``: sets of five-word shingles, candidates
by bands of min-hashes, and an exact test of the Jaccard similarity of every candidate.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.llm.batches import keyed, map_rows
from parcelgrid.session import cut_lineage

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
#: Cells with more fingerprints are linked through the fingerprints between them instead of pair by pair.
CELL_PAIRS = 48
_LOW_BITS = 0x5555555555555555
_PORTION = 1 << 16

#: Word copies: shingles of five words, similarity in ninths of the sum of two sets' sizes (4/9 is Jaccard 0.8).
COPY_WORDS = 5
#: A pair of Jaccard 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 30, more than 0.99999.
BANDS, BAND_ROWS = 30, 5
#: Cells with more sets than ``CELL_PAIRS`` are split by the next band, at most so often.
LEVELS = 6
#: Pairs that meet one copy of a set in their exact test.
PAIRS_A_COPY = 256
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str) -> int:
    """SimHash of the word shingles of a text: a bit is set if more than half of the shingles' hashes have it."""
    plain = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not plain:
        return 0
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(plain)]))
    wide = min(SHINGLE_WORDS, len(starts)) - 1
    starts, ends = starts[: len(starts) - wide], ends[wide:]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _PORTION):
        spans = zip(starts[at : at + _PORTION].tolist(), ends[at : at + _PORTION].tolist())
        hashes = np.array([digest(plain[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        even = len(bits) // 255 * 255
        counts += bits[even:].sum(0, dtype=np.uint8)
        if even:
            counts += bits[:even].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def message_fingerprints(messages: DataFrame, message_id: str = "message_id", content: str = "content") -> DataFrame:
    """``message_id, fp BIGINT`` of every row; null and wordless contents have fingerprint zero."""

    def make():
        def work(part: pa.RecordBatch):
            fps = np.array([fingerprint(t or "") for t in part.column("content").to_pylist()], np.uint64)
            return [pa.array(fps.view(np.int64), pa.int64())]

        return work

    return map_rows(keyed(messages, message_id, content=content), "content", make, "fp bigint", message_id)


def unary_counts(fp: Column) -> Column:
    """Bit counts of the 32 segments, two bits each in unary."""
    up = F.shiftrightunsigned(fp, 1)
    low, high = fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW_BITS)), fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW_BITS))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _cells(unary: Column) -> Column:
    block = [F.shiftrightunsigned(unary, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    return F.array(*[
        F.lit(no << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
        for no, (i, j) in enumerate(combinations(range(4), 2))
    ])


def near_links(nodes: DataFrame) -> DataFrame:
    """Links ``u < v`` that join exactly what distance 2 joins; ``nodes`` has distinct ``fp``.

    Cells with up to ``CELL_PAIRS`` fingerprints list their near pairs.  In a larger cell every fingerprint names the
    65 fingerprints within one bit of it; two are within two bits if and only if they name a common one, so all that
    name it are linked to the smallest of them.  Work is linear in the fingerprints either way.
    """
    marked = nodes.select("fp", unary_counts(F.col("fp")).alias("unary"))
    cells = marked.select("fp", "unary", F.explode(_cells(F.col("unary"))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(cells.join(sizes, "cell"))
    few = shared.filter(F.col("n") <= CELL_PAIRS)
    other = few.select("cell", F.col("fp").alias("v"), F.col("unary").alias("unary_v"))
    pairs = few.join(other, "cell").filter(
        (F.col("fp") < F.col("v"))
        & (F.bit_count(F.col("unary").bitwiseXOR(F.col("unary_v"))) <= DISTANCE)
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= DISTANCE)
    ).select(F.col("fp").alias("u"), "v")
    many = shared.filter(F.col("n") > CELL_PAIRS).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << k) - (1 << 64) * (k == 63)).cast("bigint") for k in range(64)])
    named = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    first = named.groupBy("mid").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1")
    hub = named.join(first, "mid").filter(F.col("u") < F.col("fp")).select("u", F.col("fp").alias("v"))
    return pairs.unionByName(hub).distinct()


def link_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from every linked node: ``node, root``.

    Labels go over links and then along labels until nothing changes; each round is a written table, and one counter
    reaches the driver.
    """
    both = cut_lineage(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select(
        "node", F.least("node", "low").alias("root")
    ))
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("root").alias("low")
        )
        lower = labels.join(seen, "node").select("node", "root", F.least("root", "low").alias("next"))
        hop = labels.select(F.col("node").alias("next"), F.col("root").alias("hop"))
        step = cut_lineage(lower.join(hop, "next").select("node", "root", F.least("next", "hop").alias("new")))
        moved = step.filter(F.col("new") != F.col("root")).count()
        labels = step.select("node", F.col("new").alias("root"))
        if not moved:
            return labels


def near_copy_groups(messages: DataFrame, message_id: str = "message_id", content: str = "content") -> DataFrame:
    """Groups of near copies among the chat messages of planning sessions: ``message_id, fingerprint, component_id``.

    One row per input row.  Contents are lower-cased (A-Z) and cut at ASCII white space; shingles are three words, a
    shorter content is one shingle, null and wordless ones have fingerprint zero.  Fingerprints within two bits are
    linked, and ``component_id`` is the smallest id that links reach, null only if no message of the group has an id.
    Repeated rows share their group; extra columns are ignored; an empty table gives an empty table.

    Equal fingerprints are merged before anything else, so a group of copies of any size is one node.
    """
    fps = cut_lineage(message_fingerprints(keyed(messages, message_id, content=content), "key", "content"))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("key").alias("low")))
    roots = link_components(near_links(nodes)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    found = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return fps.join(found, "fp").select(
        F.col("key").alias(message_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest, wide = xxhash.xxh64_intdigest, COPY_WORDS
    if len(words) <= wide:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    hashes = (digest(b" ".join(words[k : k + wide]), SEED) for k in range(len(words) - wide + 1))
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - wide + 1))


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def _bands(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of the least values under ``BANDS * BAND_ROWS`` orders of the shingles."""
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 1024):
        values = (_FACTORS * hashes[at : at + 1024]) >> np.uint64(32)
        np.minimum(least, values.min(1).astype(np.uint32), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _with_shingles(rows: DataFrame, fields: str, work) -> DataFrame:
    def make():
        return lambda part: work([shingle_set(t or "") for t in part.column("content").to_pylist()])

    return map_rows(rows, "content", make, fields, "key")


def _signatures(sets: list[np.ndarray]) -> list[pa.Array]:
    return [
        pa.array(np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()),
        _lists([_bands(s) for s in sets]),
    ]


def _hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)), _lists(sets)]


def _shared_cells(nodes: DataFrame) -> list[DataFrame]:
    """``cell, fp, size, lead, lead_size, n`` of sets that share a cell, a table for each level of cells.

    A cell of the first level is a band; a cell with more than ``CELL_PAIRS`` sets is split by the band after it.
    """
    levels, members = [], nodes.select("fp", "size", F.posexplode("bands").alias("band", "cell"))
    for level in range(1, LEVELS + 1):
        found = members.groupBy("cell").agg(F.min(F.struct("fp", "size")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        cells = found.select("cell", "n", F.col("first.fp").alias("lead"), F.col("first.size").alias("lead_size"))
        shared = cut_lineage(members.join(cells, "cell"))
        levels.append(shared)
        large = shared.filter(F.col("n") > CELL_PAIRS).select("fp", "size", "band", "cell")
        if large.isEmpty():
            break
        after = F.get("bands", (F.col("band") + level) % BANDS)
        members = large.join(nodes.select("fp", "bands"), "fp").select("fp", "size", "band", F.xxhash64("cell", after).alias("cell"))
    return levels


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``u, v`` whose sets have a Jaccard similarity of at least 0.8, tested exactly.

    A set that many pairs have in common goes to their test in several copies.
    """
    common = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
    left = sets.join(common.withColumnRenamed("u", "fp"), "fp").select(
        F.col("fp").alias("u"), F.col("hashes").alias("a"), "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    ).drop("copies")
    dealt = pairs.join(common, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int").alias("copy"))
    right = sets.select(F.col("fp").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return dealt.join(left, ["u", "copy"]).join(right, "v").filter(9 * both >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _may_be_similar(a: str, b: str) -> Column:
    """Sets whose sizes differ more cannot reach a Jaccard similarity of 0.8."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def word_copy_groups(messages: DataFrame, message_id: str = "message_id", content: str = "content") -> DataFrame:
    """Groups of messages whose five-word shingles have a Jaccard similarity of at least 0.8: ``message_id, component_id``.

    One row per input row; words and groups as in ``near_copy_groups``, wordless contents are one group.  Equal sets
    are merged first.  Candidates share a cell of min-hashes: first every set is tested against the first one of each
    of its cells, then all pairs of cells with up to ``CELL_PAIRS`` sets, as far as links have not joined them.  Larger
    cells are split by further bands, so the work stays linear in the sets.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    rows = messages.select(
        F.struct(F.col(message_id).alias("id"), F.xxhash64(text).alias("text_hash")).alias("key"), text.alias("content")
    )
    prints = cut_lineage(_with_shingles(rows, "fp bigint, size int, bands array<bigint>", _signatures))
    first = F.min(F.struct(F.col("key.id").isNull().alias("no_id"), F.col("key.id").alias("id"), F.col("key.text_hash").alias("text_hash")))
    nodes = cut_lineage(prints.groupBy("fp").agg(first.alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    levels = _shared_cells(nodes)
    stars = cut_lineage(reduce(DataFrame.unionByName, [
        s.filter((F.col("fp") != F.col("lead")) & _may_be_similar("size", "lead_size")).select(F.col("lead").alias("u"), F.col("fp").alias("v"))
        for s in levels
    ]).distinct())

    few = reduce(DataFrame.unionByName, [s.filter((F.col("n") > 2) & (F.col("n") <= CELL_PAIRS)) for s in levels])
    wanted = stars.select(F.explode(F.array("u", "v")).alias("fp")).unionByName(few.select("fp")).distinct()
    wanted = wanted.join(nodes.select("fp", "rep"), "fp").select("rep.id", "rep.text_hash").distinct()
    same = F.col("key.id").eqNullSafe(F.col("id")) & (F.col("key.text_hash") == F.col("text_hash"))
    # the wanted texts grow with the messages, so their ids are never broadcast
    texts = rows.join(wanted.hint("merge"), same).select("key", "content")
    sets = cut_lineage(_with_shingles(texts, "fp bigint, hashes array<bigint>", _hashes).drop("key").dropDuplicates(["fp"]))

    links = cut_lineage(_similar(stars, sets))
    roots = link_components(links).withColumnRenamed("node", "fp")
    rooted = few.join(roots, "fp", "left").select("cell", "fp", "size", "lead", F.coalesce("root", "fp").alias("root"))
    open_cells = rooted.groupBy("cell").agg((F.min("root") < F.max("root")).alias("open")).filter("open").select("cell")
    rooted = cut_lineage(rooted.join(open_cells, "cell"))
    other = rooted.select("cell", F.col("fp").alias("v"), F.col("size").alias("size_v"), F.col("root").alias("root_v"))
    rest = rooted.filter(F.col("fp") != F.col("lead")).join(other, "cell").filter(
        (F.col("fp") < F.col("v")) & (F.col("root") != F.col("root_v")) & _may_be_similar("size", "size_v")
    ).select(F.col("fp").alias("u"), "v").distinct()
    more = cut_lineage(_similar(cut_lineage(rest), sets))
    if not more.isEmpty():
        roots = link_components(links.unionByName(more)).withColumnRenamed("node", "fp")

    whole = nodes.join(roots, "fp", "left").select("fp", F.col("rep.id").alias("low"), F.coalesce("root", "fp").alias("root"))
    lowest = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    found = whole.join(lowest, "root").select("fp", "component_id")
    return prints.select("key.id", "fp").join(found, "fp").select(F.col("id").alias(message_id), "component_id")


def keep_first_copies(messages: DataFrame, message_id: str = "message_id", content: str = "content") -> DataFrame:
    """One message of each group of word copies, that with the smallest id, with all its columns.

    Repeated rows become one.  Rows that share an id but not a content are one message in several parts: they stay or
    go together.  In a group without any id only repeated rows can be told to be the same.
    """
    groups = cut_lineage(word_copy_groups(messages, message_id, content).select(F.col(message_id).alias("_kept"), "component_id"))
    kept = groups.groupBy("_kept").agg(
        F.max(F.col("_kept").eqNullSafe(F.col("component_id"))).alias("_first"), (F.count("*") > 1).alias("_again")
    ).filter("_first").select("_kept", "_again")
    # the kept ids grow with the messages, so they are never broadcast, however few they are just now
    rows = messages.join(kept.hint("merge"), F.col(message_id).eqNullSafe(F.col("_kept")))
    once = rows.filter(~F.col("_again")).select(messages.columns)
    again = rows.filter("_again").select(messages.columns).dropDuplicates([message_id, content])
    return once.unionByName(again)

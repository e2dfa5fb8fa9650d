"""Packing of chat messages into token sequences of a fixed window.

Method: minimum bin slack on the multiset of remaining lengths.  A message is cut at whole windows; what remains of all
messages is a histogram of at most ``window`` lengths, however many messages there are.  A window is opened by the
longest remaining length, and a subset-sum dynamic program over bitsets finds which multiset of the other lengths brings
it closest to capacity; counts are read back from the bitsets, and the pattern is used as often as the counts allow.
Where some slack would stay, half of the pieces of the longest length that is no power of two are cut at its binary
digits: powers of two fill windows without slack, and the few at the very end, which fill no window, are put together to
one sequence for each binary digit of their sum, which needs no padding either.

The plan speaks of ranks within a length.  Tasks number their own pieces of each length while they write them, the counts
of the tasks give the offsets, and each piece finds its window, or its cuts, by its rank.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from parcelgrid.llm.batches import slices
from parcelgrid.llm.bpe_codec import _spec
from parcelgrid.llm.ragged_bpe import batch_encoder
from parcelgrid.session import cut_lineage

#: Tokens handed to Spark at once by a task.
BATCH_TOKENS = 1 << 18


def best_filling(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum is closest to ``room`` from below.

    One bitset of reachable sums for each length and binary share of its count; the counts come back from the last to
    the first, so long pieces are preferred.
    """
    everything = (1 << room + 1) - 1
    reachable, steps = 1, []
    for length in np.flatnonzero(counts[: room + 1]).tolist():
        left, share = min(int(counts[length]), room // length), 1
        while left:
            share = min(share, left)
            steps.append((length, share, reachable))
            reachable = (reachable | reachable << length * share) & everything
            left, share = left - share, share * 2
    target, used = reachable.bit_length() - 1, {}
    for length, share, before in reversed(steps):
        if not before >> target & 1:
            target -= length * share
            used[length] = used.get(length, 0) + share
    return used


class Plan:
    """What happens to the pieces of each length, by their rank in it.

    ``fills`` rows ``(length, first, last, per, sequence, offset)``: ranks ``first <= r < last`` lie in sequences
    ``sequence + (r - first) // per`` from ``offset + (r - first) % per * length`` on.  ``cuts`` rows
    ``(length, first, last, parts)``: those ranks are cut, and ``parts`` gives for each binary digit, largest first, its
    length and the rank that the first of these pieces takes there.
    """

    def __init__(self, counts: np.ndarray, window: int):
        self.window = window
        self.fills: list[tuple[int, int, int, int, int, int]] = []
        self.cuts: list[tuple[int, int, int, list[tuple[int, int]]]] = []
        self.n_sequences = 0
        self.left = counts.astype(np.int64).copy()
        self.known = self.left.copy()
        self._run()

    def _take(self, length: int, n: int) -> int:
        first = int(self.known[length] - self.left[length])
        self.left[length] -= n
        return first

    def _fill(self, used: dict[int, int], most: int | None = None) -> None:
        times = min(int(self.left[length]) // per for length, per in used.items())
        times = min(times, most or times)
        offset = 0
        for length, per in sorted(used.items(), reverse=True):
            first = self._take(length, per * times)
            self.fills.append((length, first, first + per * times, per, self.n_sequences, offset))
            offset += length * per
        self.n_sequences += times

    def _run(self) -> None:
        while (lengths := np.flatnonzero(self.left)).size:
            longest = int(lengths[-1])
            self.left[longest] -= 1
            used = best_filling(self.left, self.window - longest)
            self.left[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            if sum(length * per for length, per in used.items()) == self.window:
                self._fill(used)
                continue
            odd = lengths[lengths & lengths - 1 > 0]
            if odd.size:
                self._cut(int(odd[-1]))
                continue
            # powers of two only, and too few for a window: one sequence for each binary digit of their sum
            rest = int((self.left * np.arange(self.window + 1)).sum())
            self._fill(best_filling(self.left, 1 << rest.bit_length() - 1), 1)

    def _cut(self, length: int) -> None:
        n = -(-int(self.left[length]) // 2)
        first, parts = self._take(length, n), []
        for digit in range(length.bit_length() - 1, -1, -1):
            if length >> digit & 1:
                parts.append((1 << digit, int(self.known[1 << digit])))
                self.known[1 << digit] += n
                self.left[1 << digit] += n
        self.cuts.append((length, first, first + n, parts))


def token_pieces(
    messages: DataFrame, vocabulary_path: str, window: int, end_id: int, keys: Sequence[str], text: str
) -> DataFrame:
    """Messages as pieces of at most ``window`` tokens: ``key, start, length, n_tokens, ids, task, nth``.

    ``ids`` are little-endian unsigned 32-bit integers.  ``nth`` numbers the pieces of one length within a task.
    """
    spec = _spec(vocabulary_path)
    rows = messages.select(F.struct(*keys).alias("key"), F.col(text).alias("text"))
    fields = "start bigint, length int, n_tokens bigint, ids binary, task int, nth bigint"
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL(fields)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = batch_encoder(spec), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)

        def ready(part: pa.RecordBatch, of: list[int], cut: list[tuple]) -> pa.RecordBatch:
            start, length, n, ids, nth = zip(*cut)
            return pa.RecordBatch.from_arrays([
                part.column("key").take(pa.array(of, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(of), pa.int32()), pa.array(nth, pa.int64()),
            ], names)

        for batch in batches:
            for part in slices(batch, "text"):
                of, cut, held = [], [], 0
                texts = [t or "" for t in part.column("text").to_pylist()]
                for row, packed in enumerate(coder.encode_texts(texts)):
                    ids = array("I", packed)
                    ids.append(end_id)
                    for start in range(0, len(ids), window):
                        some = ids[start : start + window]
                        cut.append((start, len(some), len(ids), some.tobytes(), int(seen[len(some)])))
                        seen[len(some)] += 1
                        of.append(row)
                        held += len(some)
                        if held >= BATCH_TOKENS:
                            yield ready(part, of, cut)
                            of, cut, held = [], [], 0
                if cut:
                    yield ready(part, of, cut)

    return rows.mapInArrow(run, schema)


def pack_messages(
    messages: DataFrame, vocabulary_path: str, window: int = 2048, end_id: int = 1,
    keys: Sequence[str] = ("session_id", "seq"), text: str = "text",
) -> DataFrame:
    """Packs the token ids of all chat messages of the planning sessions, an ``end_id`` after each, into sequences.

    Each id of a message lies in exactly one piece.  Returns the ``keys``, then for each piece ``start BIGINT`` (ids of the
    message before it), ``length BIGINT``, ``n_tokens BIGINT`` (ids of the message), ``ids BINARY`` (little-endian unsigned
    32-bit integers), ``sequence_id BIGINT`` (from 0, without gaps) and ``offset BIGINT`` (place in the sequence; pieces lie
    side by side).  Every sequence holds exactly ``window`` ids, except at most one for each smaller power of two, which
    holds as many as that.  ``window`` is a power of two.

    Null and empty texts are the ``end_id`` alone.  Null keys stay null, repeated rows are packed each on its own, other
    columns of the input are ignored whatever their names, and an empty table gives no pieces.  Which message lies
    in which sequence depends on how the table is split into tasks.  Ids are written once to the checkpoint folder; on
    the driver is a histogram of ``window`` lengths, and what is broadcast is the plan made of it.
    """
    if window < 1 or window & window - 1:
        raise ValueError("the window must be a power of two")
    results = {"start", "length", "n_tokens", "ids", "sequence_id", "offset"}
    if results & set(keys):
        raise ValueError("a key has the name of a result")
    spark = messages.sparkSession
    pieces = cut_lineage(token_pieces(messages, vocabulary_path, window, end_id, keys, text))

    tasks = cut_lineage(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(window + 1, np.int64)
    for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    plan = Plan(counts, window)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["length", "task"]).select(
        "key", "start", "length", "n_tokens", "ids", (F.col("nth") + F.col("_before")).alias("_rank")
    )

    cuts = spark.createDataFrame(
        plan.cuts, "cut_length int, first bigint, last bigint, parts array<struct<size:int,rank:bigint>>"
    )
    inside = (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last"))
    cut = ranked.join(F.broadcast(cuts), (F.col("length") == F.col("cut_length")) & inside, "left")
    whole = F.array(F.struct(F.col("length").alias("size"), F.col("_rank").alias("rank"), F.lit(0).alias("skip")))
    sizes = F.transform("parts", lambda p: p["size"])
    skips = F.transform("parts", lambda p, i: F.struct(
        p["size"].alias("size"), (p["rank"] + F.col("_rank") - F.col("first")).alias("rank"),
        F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, s: a + s).alias("skip"),
    ))
    parts = cut.select(
        "key", "start", "n_tokens", "ids", "length", F.explode(F.coalesce(skips, whole)).alias("_part")
    ).select(
        "key", (F.col("start") + F.col("_part.skip")).alias("start"), "n_tokens", F.col("_part.size").alias("size"),
        F.col("_part.rank").alias("_rank"),
        F.when(F.col("_part.size") == F.col("length"), F.col("ids")).otherwise(
            F.col("ids").substr(F.col("_part.skip") * 4 + 1, F.col("_part.size") * 4)).alias("ids"),
    )
    fills = spark.createDataFrame(
        plan.fills, "fill_length int, first bigint, last bigint, per bigint, sequence bigint, fill_offset bigint"
    )
    at = F.col("_rank") - F.col("first")
    return parts.join(F.broadcast(fills), (F.col("size") == F.col("fill_length")) & inside).select(
        *[F.col("key")[k].alias(k) for k in keys], "start", F.col("size").cast("long").alias("length"), "n_tokens", "ids",
        (F.col("sequence") + F.floor(at / F.col("per"))).alias("sequence_id"),
        (F.col("fill_offset") + F.pmod(at, F.col("per")) * F.col("size")).alias("offset"),
    )

"""Merkle manifest of a table of chat messages: a digest per row, per group and for all, and each row's proof.

Method: windows with lag and lead.  Rows are numbered within their group.  On each level a run is ``FAN`` consecutive
nodes; lag and lead columns at the fixed offsets 1 to ``FAN - 1``, masked by a node's slot in its run and the length of
that run, supply its siblings, and the first child of a run hashes the parent.  Levels are windowed in blocks of whole
runs, so the largest group is spread like any other.  The digests of the groups go up in the same way, as one group.
Proofs come back down: a node's proof is its siblings and then the proof of its parent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.operators.prefix import ranked
from parcelgrid.session import cut_lineage

#: Children of a node.
FAN = 8
#: Nodes of a window partition, a whole number of runs.
BLOCK_NODES = FAN**3
#: The only group of the tree over groups.
TOP = "_"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its text, or ``-`` where it is null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _joined(columns: Sequence[Column]) -> Column:
    return F.concat(*[F.coalesce(c, F.lit("")) for c in columns])


def level_rows(nodes: DataFrame) -> DataFrame:
    """Siblings before and after each node in its run, and on first children the digest of the parent.

    ``nodes(_g, _pos, _size, _node)``: group, place from 0, nodes of the group on this level, digest.  Adds ``_left``,
    ``_right`` and ``_parent`` (null on other children).
    """
    w = Window.partitionBy("_g", F.floor(F.col("_pos") / BLOCK_NODES)).orderBy("_pos")
    slot = F.pmod(F.col("_pos"), F.lit(FAN))
    run = F.least(F.lit(FAN), F.col("_size") - F.col("_pos") + slot)
    left = [F.when(slot >= k, F.lag("_node", k).over(w)) for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("_node", k).over(w)) for k in range(1, FAN)]
    parent = F.when(slot == 0, F.sha2(F.concat(F.col("_node"), _joined(right)), 256))
    return nodes.withColumns({"_left": _joined(left), "_right": _joined(right), "_parent": parent})


def _tree(leaves: DataFrame, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Written levels, leaves first, and the top node of each group; only leaves keep the ``carried`` columns."""
    levels, tops, nodes = [], [], leaves
    while True:
        level = cut_lineage(level_rows(nodes).select("_g", "_pos", "_size", "_node", "_left", "_right", "_parent", *carried))
        levels.append(level)
        tops.append(level.filter("_size = 1").select("_g", "_node"))
        higher = level.filter("_size > 1 AND _parent IS NOT NULL")
        if higher.isEmpty():
            break
        nodes = higher.select(
            "_g", F.floor(F.col("_pos") / FAN).alias("_pos"), F.ceil(F.col("_size") / FAN).alias("_size"),
            F.col("_parent").alias("_node"),
        )
        carried = ()
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return levels, top


def _proofs(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``_proof``: siblings before and after, level by level, then those of ``above``.

    ``above(_g, _proof, _subroot, _root)`` holds what lies over the top node of each group.
    """
    carried = [c for c in levels[0].columns if c not in ("_left", "_right", "_parent", "_size")]
    over = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        columns = carried if depth == 0 else ["_g", "_pos"]
        out = level.filter("_size = 1").join(above, "_g").select(*columns, "_proof", "_subroot", "_root")
        if over is not None:
            parents = over.select(F.col("_g"), F.col("_pos").alias("_up"), "_proof", "_subroot", "_root")
            own = F.array(F.struct(F.col("_left").alias("before"), F.col("_right").alias("after")))
            below = level.filter("_size > 1").withColumn("_up", F.floor(F.col("_pos") / FAN)).join(parents, ["_g", "_up"])
            out = out.unionByName(below.select(*columns, F.concat(own, "_proof").alias("_proof"), "_subroot", "_root"))
        over = out if depth == 0 else cut_lineage(out)
    return over


def message_manifest(
    messages: DataFrame, group: str = "session_id", order: Sequence[str] = ("seq",),
    fields: Sequence[str] = ("session_id", "seq", "role", "text"), received: Mapping[str, str] | None = None,
) -> DataFrame:
    """Manifest of all chat messages of the planning sessions, with a proof for each, checked against what was received.

    A message is a leaf, the digest of its ``fields``.  Per ``group`` the leaves ascend by ``order``; every ``FAN``
    consecutive nodes, fewer at the end, become the SHA-256 digest of their digests as hex text, until one is left, the
    subroot (a lone leaf itself).  Subroots, ordered by the group as text (null first, bytewise), give the root likewise.
    ``received`` names, for fields, the columns that hold them as they arrived (default: unchanged).

    Returns the columns ``order``, then ``leaf``, ``subroot``, ``root`` and

    - ``proof ARRAY<STRUCT<before STRING, after STRING>>``: the siblings in each run on the way from leaf to root,
    - ``folded_root``: the root recomputed from the received leaf and the proof,
    - ``verified BOOLEAN``: whether that is the root.

    Null fields count as null, which differs from an empty text; null order values come first; equal ones are ordered by
    their leaf, so repeated rows are leaves of their own next to each other.  Other columns of the input are ignored
    whatever their names.  An empty table gives an empty result.  Texts are read once, where they lie; what is shuffled
    is digests: a row three times without and once with its siblings.
    """
    results = {"leaf", "subroot", "root", "proof", "folded_root", "verified"}
    if results & set(order):
        raise ValueError("an order column has the name of a result")
    received = dict(received or {})
    if not set(received) <= set(fields):
        raise ValueError("received holds something that is no field")
    digest = leaf_digest([F.col(f) for f in fields])
    arrived = leaf_digest([F.col(received.get(f, f)) for f in fields])
    names = [f"_o{i}" for i in range(len(order))]
    leaves = messages.select(
        # null first, before the empty text
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_g"),
        *[F.col(c).alias(n) for c, n in zip(order, names)], digest.alias("_node"), arrived.alias("_arrived"),
    )
    placed = ranked(leaves, ["_g"], names, "_node")
    placed = placed.select("_g", (F.col("rn") - 1).alias("_pos"), F.col("n").alias("_size"), "_node", "_arrived", *names)
    levels, subroots = _tree(placed, ["_arrived", *names])

    tops = ranked(subroots, [], "_g").select(
        F.lit(TOP).alias("_g"), (F.col("rn") - 1).alias("_pos"), F.col("n").alias("_size"), "_node", F.col("_g").alias("_of")
    )
    upper, root = _tree(tops, ["_of"])
    none = F.array().cast("array<struct<before:string,after:string>>")
    above = root.select("_g", none.alias("_proof"), F.col("_node").alias("_subroot"), F.col("_node").alias("_root"))
    over = cut_lineage(_proofs(upper, above).select(F.col("_of").alias("_g"), "_proof", F.col("_node").alias("_subroot"), "_root"))

    folded = F.aggregate(
        "_proof", F.col("_arrived"), lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256)
    )
    return _proofs(levels, over).select(
        *[F.col(n).alias(c) for c, n in zip(order, names)], F.col("_node").alias("leaf"), F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"), F.col("_proof").alias("proof"), folded.alias("folded_root"),
        (folded == F.col("_root")).alias("verified"),
    )

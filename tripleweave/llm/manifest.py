"""Merkle manifest of a dataset: a leaf per row, a tree per group, one root, and a proof for every row.

Nodes are numbered within their group by a range sort and running counts of the sorted partitions, so a group of any size is
shared by many tasks.  A tree is then built in passes of ``levels`` levels: a window holds one block of fanout**levels
neighbours.  At each level the first row of a node carries its hash; the node's siblings are found by lag and lead at fixed
offsets, masked by the node's slot in its run and by the length of the level, and the first child's row hashes the parent.
One node a block goes on to the next pass, so 10**12 rows take four passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, stored

#: What separates the steps of a proof: the digests left and right of the path at one level.
STEP = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def numbered(nodes: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the rank in its group from 0, and ``size``, the group's number of rows.

    The rows are range sorted and numbered as they lie; a small table of counts by (partition, group) says where each
    partition's share of a group starts."""
    laid = nodes.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    laid = stored(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "laid")
    counts = laid.groupBy(*groups, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("part").alias("_part"),
                           (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("part") == F.col("_part")]
    kept = [c for c in laid.columns if c not in ("at", "part")]
    return laid.join(starts, reduce(lambda a, b: a & b, same)).select(*kept, (F.col("at") + F.col("shift")).alias("pos"), "size")


def _div(column: str, by: int, up: bool = False) -> Column:
    """Integer quotient, rounded down or up."""
    return F.expr(f"({column} + {by - 1 if up else 0}) div {by}")


def _pass(nodes: DataFrame, groups: list[str], fanout: int, levels: int) -> DataFrame:
    """``nodes`` (``groups, pos, size, h``) with ``block``, ``top`` (hash of the block's node after the pass, on its first row) and
    ``steps``, the proof of the row up to there."""
    rows = nodes.withColumn("block", _div("pos", fanout ** levels))
    inside = Window.partitionBy(*groups, "block").orderBy("pos")
    held = F.col("h")
    names = []
    for level in range(levels):
        step = fanout ** level                                              # rows from one node's first row to the next's
        length = _div("size", step, up=True)                                # nodes at this level
        node = _div("pos", step)
        slot = F.pmod(node, F.lit(fanout))
        rows = rows.withColumn(f"h{level}", F.when(F.pmod(F.col("pos"), F.lit(step)) == 0, held) if level else held)
        here = f"h{level}"
        behind = [F.when(slot >= d, F.lag(here, d * step).over(inside)) for d in range(fanout - 1, 0, -1)]
        ahead = [F.when((slot + d < fanout) & (node + d < length), F.lead(here, d * step).over(inside)) for d in range(1, fanout)]
        rows = rows.withColumns({f"l{level}": F.concat_ws("", *behind), f"r{level}": F.concat_ws("", *ahead)})
        active = length > 1
        rows = rows.withColumn(f"s{level}", F.when(active & F.col(here).isNotNull(), F.struct(
            F.col(f"l{level}").alias("left"), F.col(f"r{level}").alias("right"))))
        names.append(f"s{level}")
        first = F.col(here).isNotNull() & (slot == 0)
        held = F.when(first, F.when(active, digest(F.concat(F.col(here), F.col(f"r{level}")))).otherwise(F.col(here)))
    # each row takes the steps of the nodes it lies in from their first rows, the nearest ones at or before it
    fill = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("top", held).withColumns({f"_{n}": F.last(n, ignorenulls=True).over(fill) for n in names})
    steps = F.filter(F.array(*[F.when(_div("size", fanout ** i, up=True) > 1, F.col(f"_{n}")) for i, n in enumerate(names)]),
                     lambda s: s.isNotNull())
    return filled.select(*nodes.columns, "block", "top", steps.alias("steps"))


def trees(nodes: DataFrame, groups: list[str], fanout: int = 2, levels: int = 10) -> DataFrame:
    """``nodes`` (``groups, pos, size, h`` and more) with ``root``, the hash of the group's tree, and ``steps``, the row's proof."""
    done = stored(_pass(nodes, groups, fanout, levels), "tree")
    span = fanout ** levels
    tops = done.where(F.pmod(F.col("pos"), F.lit(span)) == 0).select(
        *groups, F.col("block").alias("pos"), _div("size", span, up=True).alias("size"), F.col("top").alias("h"))
    # groups of at most one block end here; only the larger ones enter another pass
    if tops.where("size > 1").isEmpty():
        up = tops.withColumns({"root": F.col("h"), "more": F.array().cast(STEP)})
    else:
        up = trees(tops, groups, fanout, levels).withColumnRenamed("steps", "more")
    up = up.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("pos").alias("_block"), "root", "more")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("block") == F.col("_block")]
    return done.join(up, reduce(lambda a, b: a & b, same)).select(
        *nodes.columns, "root", F.concat("steps", "more").alias("steps"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = 2, levels: int = 10) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``steps`` (the proof, an array of the digests left and right at each level).

    ``leaves`` is a stored table; within a group rows go by ``order``, then by the leaf's digest, nulls first; rows that agree in
    all of these are equal leaves, and each has its own place and proof.  Groups go by their value, null first.  A column named
    ``pos, size, h, block, top, subroot, root`` or ``steps`` is refused.  An empty table gives no rows."""
    clash = {"pos", "size", "h", "at", "part", "block", "top", "subroot", "root", "steps"} & set(leaves.columns)
    if clash:
        raise ValueError(f"columns of the manifest itself: {sorted(clash)}")
    nodes = numbered(leaves, [group], [*order, *[leaf for _ in [0] if leaf not in order]]).withColumn("h", F.col(leaf))
    built = stored(trees(nodes, [group], fanout, levels).withColumnRenamed("root", "subroot"), "subtrees")
    subroots = built.where("pos = 0").select(group, F.col("subroot").alias("h")).withColumn("all", F.lit(0))
    above = trees(numbered(subroots, ["all"], [group]), ["all"], fanout, min(levels, 5))
    above = above.select(F.col(group).alias("_group"), "root", F.col("steps").alias("more"))
    return built.join(above, F.col(group).eqNullSafe(F.col("_group"))).select(
        *leaves.columns, "subroot", "root", F.concat("steps", "more").alias("steps"))


def document_manifest(docs: DataFrame, fanout: int = 2, levels: int = 10) -> DataFrame:
    """``doc_id, leaf, tampered, subroot, root, steps``: the manifest of documents by language.

    ``leaf`` is the digest of doc_id, source, lang, n_chars and text.  ``tampered`` is the leaf with 1 added to n_chars (a null
    stays null) where 7 divides the CRC-32 of the decimal doc_id; a null doc_id is never tampered with.  Nulls in any column have
    a digest of their own (``-``), empty texts are ``0:``, repeated rows are leaves beside each other.  Further columns are not read."""
    rows = picked(docs, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    leaf = leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")  # one more than the largest long is still a number
    other = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text"))
    leaves = stored(rows.select("doc_id", "lang", leaf.alias("leaf"), F.when(chosen, other).alias("tampered")), "leaves")
    return manifest(leaves, "lang", ["doc_id"], fanout=fanout, levels=levels)


def verified_proofs(proofs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of :func:`document_manifest`: each row's proof, folded
    from its tampered leaf if it has one."""
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    up = folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    return proofs.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), up.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))

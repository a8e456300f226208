"""Strongly connected components of a directed graph of any size, as tables.

Nodes are strings, edges ``a, b``.  Every round first *rakes* off nodes without an edge in or out, which lie on no cycle, and then
*compresses* nodes with a single edge out: pointer doubling takes each to the end of its chain in log2(length) steps, or finds it
to run into a ring, which is a component.  Chains, trees and rings are gone after a few such steps, whatever their length.  Where
nothing is left to compress, *colouring* removes at least one component of every part: the largest name that reaches a node is its
colour, and what leads back to the node of that name within the colour is its component; that takes as many steps as the longest
shortest path of the core.  At the end the compressed chains are unwound: a chain belongs to a component if an edge from the
component enters it and it leads back there.  Every table holds nodes or edges, never pairs of a component.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stored


def kept(df: DataFrame, label: str, *conditions: Column) -> tuple[DataFrame, list[int]]:
    """A stored table, with its rows and those that meet each condition, counted while they are written."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(conditions)]]
    seen = Observation()
    table = stored(df.observe(seen, *sums), label)
    try:
        return table, list(seen.get.values())
    except Py4JJavaError:  # the observation went with a plan that Spark found to be empty
        return table, list(table.agg(*sums).first())


def _raked(live: DataFrame) -> tuple[DataFrame, int]:
    """Edges whose start has an edge in and whose end has an edge out, and their number."""
    into = live.select(F.col("b").alias("n")).distinct()
    out = live.select(F.col("a").alias("m")).distinct()
    rest, n = kept(live.join(into, F.col("a") == F.col("n"), "left_semi").join(out, F.col("b") == F.col("m"), "left_semi"), "raked")
    return rest, n[0]


@dataclass
class _Layer:
    """What one compression took out: pointer tables ``v, to, open`` by steps 1, 2, 4, ... and the edges into the chains."""

    jumps: list[DataFrame]
    entries: DataFrame  # a, w, t: an edge from a live node into a chain at w, which ends at t


def _doubled(jump: DataFrame) -> tuple[DataFrame, int]:
    """Twice as many steps: ``to`` is the node reached, or the end of the chain; ``open`` says that it is no end."""
    ahead = jump.select(F.col("v").alias("n"), F.col("to").alias("far"), F.col("open").alias("on"), F.col("least").alias("low"))
    step = jump.join(ahead, F.col("to") == F.col("n"), "left").select(
        "v", F.coalesce("far", "to").alias("to"), F.coalesce("on", F.lit(False)).alias("open"), F.least("least", "low").alias("least"))
    table, (_, unsettled) = kept(step, "jumps", F.col("open"))
    return table, unsettled


def _compressed(live: DataFrame, size: int | None) -> tuple[DataFrame, int, _Layer | None, DataFrame | None] | None:
    """(edges between the nodes that stay, their number, the layer, nodes of rings with their component); None if no node has a
    single edge out.  ``size`` is the number of edges, if it is known."""
    single = live.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("to")).where("n = 1").select(F.col("a").alias("v"), "to")
    jump, (total, unsettled) = kept(single.join(single.select(F.col("v").alias("n")), F.col("to") == F.col("n"), "left").select(
        "v", "to", F.col("n").isNotNull().alias("open"), F.col("v").alias("least")), "jumps", F.col("open"))
    if not total:
        return None
    jumps, before = [jump], None
    while unsettled and unsettled != before:  # a step that settles no node: the others run in circles
        before = unsettled
        jump, unsettled = _doubled(jumps[-1])
        jumps.append(jump)
    rings = _rings(jumps[-1].where("open").drop("open")) if unsettled else None
    if total == size:  # no node has a second edge: none stays
        return live, 0, None, rings
    inner = jumps[0].select(F.col("v").alias("n"))
    last = jumps[-1].select(F.col("v").alias("w"), F.col("to").alias("t"), "open")
    staying = live.join(inner, F.col("a") == F.col("n"), "left_anti")
    # an edge into a ring, or to what runs into one, never leads back
    moved = staying.join(last, F.col("b") == F.col("w"), "left").where("NOT coalesce(open, false)").select("a", "b", "w", "t")
    moved, (n, entering) = kept(moved, "moved", F.col("w").isNotNull())
    edges = moved.select("a", F.coalesce("t", "b").alias("b")).where("a <> b").distinct()
    return edges, n, _Layer(jumps, moved.where("w IS NOT NULL").select("a", "w", "t")) if entering else None, rings


def _rings(jump: DataFrame) -> DataFrame:
    """``node, component`` of the rings that all these pointers ``v, to, least`` run into.

    Once doubling the steps reaches no fewer nodes, those reached are the nodes of rings; once it lowers no least name, that is the
    least of the ring."""
    while True:
        ahead = jump.select(F.col("v").alias("n"), F.col("to").alias("far"), F.col("least").alias("low"))
        step, (_, lower) = kept(jump.join(ahead, F.col("to") == F.col("n")).select(
            "v", F.col("far").alias("to"), F.least("least", "low").alias("least"), (F.col("low") < F.col("least")).alias("lower")),
            "circling", F.col("lower"))
        reached = step.select(F.col("to").alias("n")).distinct()
        if not lower and reached.count() == jump.select("to").distinct().count():
            return step.join(reached, F.col("v") == F.col("n"), "left_semi").select(F.col("v").alias("node"), F.col("least").alias("component"))
        jump = step.drop("lower")


def _coloured(live: DataFrame) -> DataFrame:
    """``node, component`` of at least one component of every part of the graph, single nodes included."""
    colour = live.select(F.col("a").alias("v")).unionByName(live.select(F.col("b").alias("v"))).distinct().withColumn("c", F.col("v"))
    colour, changed = stored(colour.withColumn("new", F.lit(True)), "colour"), True
    while changed:
        pushed = live.join(colour.where("new").select(F.col("v").alias("n"), "c"), F.col("a") == F.col("n")).groupBy("b").agg(F.max("c").alias("p"))
        better = F.col("p").isNotNull() & (F.col("p") > F.col("c"))
        colour, (_, changed) = kept(colour.join(pushed, F.col("v") == F.col("b"), "left").select(
            "v", F.when(better, F.col("p")).otherwise(F.col("c")).alias("c"), better.alias("new")), "colour", F.col("new"))
    of = colour.select("v", "c")
    ends = of.select(F.col("v").alias("m"), F.col("c").alias("d"))
    within = stored(live.join(of, F.col("a") == F.col("v")).join(ends, (F.col("b") == F.col("m")) & (F.col("c") == F.col("d"))).select("a", "b", "c"), "within")
    found = [stored(of.where("v = c").select(F.col("v").alias("node"), F.col("c").alias("component")), "back")]
    while True:
        known = reduce(DataFrame.unionByName, found)
        tip = found[-1].select(F.col("node").alias("n"))
        step = within.join(tip, F.col("b") == F.col("n"), "left_semi").select(F.col("a").alias("node"), F.col("c").alias("component")).distinct()
        step, (n,) = kept(step.join(known.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti"), "back")
        if not n:
            return known
        found.append(step)


def _unwound(layer: _Layer, known: DataFrame) -> DataFrame:
    """``known`` components with those nodes of a layer's chains that belong to them."""
    start = known.select(F.col("node").alias("n"), F.col("component").alias("x"))
    end = known.select(F.col("node").alias("m"), F.col("component").alias("y"))
    entries = layer.entries.join(start, F.col("a") == F.col("n"), "left").join(end, F.col("t") == F.col("m"), "left")
    # the edge and the chain close a ring at one node, or at one component
    entries = entries.where("a = t OR x = y").select("w", "t", F.col("y").isNull().alias("fresh"), F.coalesce("y", "t").alias("component"))
    entries, (n,) = kept(entries.distinct(), "entries")
    if not n:
        return known
    marks = entries.select(F.col("w").alias("node"), "component")
    for jump in layer.jumps:
        on = marks.join(jump.where("open").select("v", "to"), F.col("node") == F.col("v")).select(F.col("to").alias("node"), "component")
        marks = stored(marks.unionByName(on).distinct(), "marks")
    ends = entries.where("fresh").select(F.col("t").alias("node"), "component").distinct()
    return stored(known.unionByName(marks).unionByName(ends), "known")


def strong_components(edges: DataFrame, size: int | None = None) -> DataFrame | None:
    """``node, component`` for every node on a cycle of two or more nodes; None if there is no such cycle.

    ``edges`` holds strings ``a, b`` without repeats.  The component is the name of one of its nodes.  Self-loops and null ends are
    ignored; ``size`` is the number of edges without the loops, if it is known."""
    live, left = edges.select("a", "b").where("a <> b"), size
    layers, found = [], []
    while left != 0:
        step = _compressed(live, left)
        if step is not None:
            live, left, layer, rings = step
            if layer is not None:
                layers.append(layer)
            if rings is not None:
                found.append(stored(rings, "rings"))
            if left:
                live, left = _raked(live)  # without the repeats that chains to one end have left
            continue
        live, n = _raked(live)
        if not n:
            break
        done = stored(_coloured(live), "coloured")
        size = done.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("component").alias("c"))
        found.append(stored(done.join(size, F.col("component") == F.col("c"), "left_semi"), "core"))
        gone = done.select(F.col("node").alias("n"))
        live = live.join(gone, F.col("a") == F.col("n"), "left_anti").join(gone, F.col("b") == F.col("n"), "left_anti")
        live, left = _raked(live)
    if not found and not layers:
        return None
    known = reduce(DataFrame.unionByName, found) if found else edges.sparkSession.createDataFrame([], "node string, component string")
    for layer in reversed(layers):
        known = _unwound(layer, known)
    return known

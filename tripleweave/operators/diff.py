"""Comparing two versions of a model that sit in two named graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ne
from ..functions.terms import IRI, RDF_TYPE, Lit, Term, same_term
from ..session import stored
from .graph import TRIPLE_COLUMNS, as_graph
from .modifiers import project
from .paths import Inv, Seq, path
from .patterns import Solutions, bgp, bind, filter_, join, not_exists, triple_pattern, union


def assign_graph(triples: DataFrame, iri: str) -> DataFrame:
    """Put all triples of a source into a named graph."""
    return triples.withColumn("g", F.lit(iri))


def _entities(triples: DataFrame, g: str, cls: str, name: str) -> Solutions:
    return bgp(triples, ("?entity", RDF_TYPE, IRI(cls)), ("?entity", name, "?name"), g=g)


def diff_removed(triples: DataFrame, old: str, new: str, cls: str, name: str) -> Solutions:
    """Entities of a class in ``old`` that ``new`` does not have, with their names."""
    return not_exists(_entities(triples, old, cls, name), triple_pattern(triples, "?entity", RDF_TYPE, IRI(cls), new))


def diff_added(triples: DataFrame, old: str, new: str, cls: str, name: str) -> Solutions:
    return diff_removed(triples, new, old, cls, name)


def diff_changed(triples: DataFrame, old: str, new: str, value_path, name: str | None = None) -> Solutions:
    """Entities whose value at the end of a property path differs by value (``!=``) between the graphs.

    Both graphs are read in one scan per predicate of the path.  One grouped pass tells the entities that have values in both and
    not one and the same term everywhere; only these are joined."""
    found = stored(_values(triples, [old, new], value_path), "versions")
    held = found.groupBy("entity").agg(F.max(F.col("g") == old).alias("before"), F.max(F.col("g") == new).alias("after"),
                                       F.min("value").alias("least"), F.max("value").alias("most"))
    changed = held.where(F.col("before") & F.col("after") & (F.col("least") != F.col("most"))).select(F.col("entity").alias("e"))
    mine = found.join(changed, same_term(F.col("entity"), F.col("e")), "left_semi")
    side = lambda g, at: Solutions(mine.where(F.col("g") == g).select("entity", F.col("value").alias(at)), frozenset(["entity", at]))
    both = join(side(old, "old"), side(new, "new"))
    if name is not None:
        both = project(join(both, triple_pattern(triples, "?entity", name, "?name", old)), "entity", "old", "name", "new")
    return filter_(both, ne("?old", "?new"))


def _values(triples: DataFrame, graphs: Sequence[str], value_path) -> DataFrame:
    """``entity, value, g``: the ends of a path in several graphs.  Paths of plain steps carry the graph along."""
    if isinstance(value_path, Seq):
        first, *rest = [_values(triples, graphs, step) for step in value_path.steps]
        for step in rest:
            step = step.select(F.col("entity").alias("middle"), F.col("value").alias("end"), F.col("g").alias("h"))
            first = first.join(step, same_term(F.col("value"), F.col("middle")) & (F.col("g") == F.col("h")))
            first = first.select("entity", F.col("end").alias("value"), "g")
        return first
    if isinstance(value_path, Inv) and isinstance(value_path.of, (str, Term)):
        return _values(triples, graphs, value_path.of).select(F.col("value").alias("entity"), F.col("entity").alias("value"), "g")
    if isinstance(value_path, (str, Term)):
        p = value_path.value if isinstance(value_path, Term) else value_path
        return as_graph(triples).scan(p).where(F.col("g").isin(list(graphs))).select(F.col("s").alias("entity"), F.col("o").alias("value"), "g")
    parts = [path(triples, "?entity", value_path, "?value", g=g).df.withColumn("g", F.lit(g)) for g in graphs]
    return reduce(DataFrame.unionByName, parts).select("entity", "value", "g")


def merge_tagged(triples: DataFrame, tags: Sequence[tuple[str, str]], cls: str, name: str) -> Solutions:
    """Entities of several graphs in one result, each row tagged; ``tags`` holds (graph, tag) pairs."""
    parts = [bind(_entities(triples, g, cls, name), "scenario", Lit(tag), certain=True) for g, tag in tags]
    return project(reduce(union, parts), "entity", "name", "scenario")


def graph_stats(triples: DataFrame) -> DataFrame:
    """Distinct triples and, if the triples know their file, distinct files per graph."""
    quads = triples.groupBy(*TRIPLE_COLUMNS).agg(F.lit(1).alias("one"))
    stats = quads.groupBy("g").agg(F.count(F.lit(1)).alias("triples_loaded"))
    if "file" not in triples.columns:
        return stats
    files = triples.groupBy("g").agg(F.countDistinct("file").alias("files_loaded"))
    return stats.join(files, "g")

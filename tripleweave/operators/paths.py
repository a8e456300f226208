"""Property paths.

A path expression is a predicate IRI or one of ``Seq, Alt, Inv, Neg, Opt, Plus, Star``.  Closures run as a loop
of joins over scratch tables; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import Term, native_term, same_term
from ..session import counted, rows_seen, scratch_path, stored
from .components import kept, strong_components
from .graph import Graph, as_graph
from .patterns import Solutions, _constant, _equals, _is_var, var


class Path:
    pass


@dataclass(frozen=True)
class Seq(Path):
    steps: tuple

    def __init__(self, *steps):
        object.__setattr__(self, "steps", steps)


@dataclass(frozen=True)
class Alt(Path):
    options: tuple

    def __init__(self, *options):
        object.__setattr__(self, "options", options)


@dataclass(frozen=True)
class Inv(Path):
    of: object


@dataclass(frozen=True)
class Neg(Path):
    """``!(a|^b)``: any predicate but these; inverse members are ``Inv(iri)``."""

    members: tuple

    def __init__(self, *members):
        object.__setattr__(self, "members", members)


@dataclass(frozen=True)
class Opt(Path):
    of: object


@dataclass(frozen=True)
class Plus(Path):
    of: object


@dataclass(frozen=True)
class Star(Path):
    of: object


def path(graph: Graph | DataFrame, s, expr, o, g: str = "", seeds: Solutions | None = None) -> Solutions:
    """Solutions of ``s expr o``; ends are ``"?var"`` or constants.

    A constant end starts closures from that node, and a sequence from that end, so only its neighbourhood is read.  With
    ``seeds``, solutions that bind the variable ``s``, closures start from its nodes and the result is that for these nodes:
    join it with the seeds.
    """
    graph = as_graph(graph)
    s_const = None if _is_var(s) else _constant(s)
    o_const = None if _is_var(o) else _constant(o)
    if seeds is not None:
        if s_const is not None or var(s) not in seeds.types:
            raise ValueError("seeds must bind the variable that the path starts from")
        start = native_term(F.col(var(s)), seeds.types[var(s)])
        wanted = seeds.df.select(start.alias("n")).where(F.col("n").isNotNull()).distinct()
        # a path of length zero holds for the nodes of the graph only
        node = _zero(graph, g, None, None).select(F.col("s").alias("k"))
        starts = stored(wanted.join(node, same_term(F.col("n"), F.col("k")), "left_semi"), "seeds")
        df = _from_seeds(_pairs(graph, expr, g, None, o_const, starts), starts)
    else:
        df = _pairs(graph, expr, g, s_const, o_const)
    if s_const is not None:
        df = df.where(_equals(F.col("s"), s_const))
    if o_const is not None:
        df = df.where(_equals(F.col("o"), o_const))
    if _is_var(s) and s == o:
        df = df.where(same_term(F.col("s"), F.col("o"))).select(F.col("s").alias(var(s)))
    else:
        ends = [(x, c) for x, c in ((s, "s"), (o, "o")) if _is_var(x)]
        df = df.select(*[F.col(c).alias(var(x)) for x, c in ends]) if ends else df.select(F.lit(True).alias("_"))
    return Solutions(df, frozenset(df.columns))


def _pairs(graph: Graph, expr, g: str, s: Term | None = None, o: Term | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """The (s, o) pairs of a path; a bound end narrows what is read where the path form allows it.

    ``seeds`` (a stored table of distinct nodes ``n``) says which starts matter: closures begin there, other forms may
    return pairs of other starts too."""
    if isinstance(expr, Term):
        expr = expr.value
    if isinstance(expr, str):
        return _narrow(graph.scan(expr).where(F.col("g") == g).select("s", "o"), s, o)
    if isinstance(expr, Inv):
        turned = _turned(expr.of)
        return _swap(_pairs(graph, expr.of, g, o, s)) if turned is None else _pairs(graph, turned, g, s, o, seeds)
    if isinstance(expr, Alt):
        return reduce(DataFrame.unionByName, [_pairs(graph, e, g, s, o, seeds) for e in expr.options])
    if isinstance(expr, Seq):
        if s is None and seeds is None and o is not None and any(map(_closes, expr.steps)):
            return _swap(_pairs(graph, _turned(expr), g, o))
        first, *rest = expr.steps
        found = _pairs(graph, first, g, s, o if not rest else None, seeds)
        for i, e in enumerate(rest):
            reached = None
            if _closes(e):  # from the nodes reached so far, not from all
                found = stored(found if seeds is None else _from_seeds(found, seeds), "walks")
                reached = stored(found.select(F.col("o").alias("n")).distinct(), "reached")
            found = _compose(found, _pairs(graph, e, g, None, o if i == len(rest) - 1 else None, reached))
        return found
    if isinstance(expr, Neg):
        return _narrow(_negated(graph, expr.members, g), s, o)
    if isinstance(expr, Opt):
        return _pairs(graph, expr.of, g, s, o, seeds).unionByName(_zero(graph, g, s, o, seeds)).distinct()
    if isinstance(expr, (Plus, Star)):
        edges = _pairs(graph, expr.of, g)
        if s is not None and o is not None:
            if s == o and isinstance(expr, Star):
                return _zero(graph, g, s, None)
            return _between(graph, edges, s, o)
        if s is not None:
            found = _reach(graph, edges, s)
        elif seeds is not None:
            found = _narrow(_reach_all(edges, seeds), None, o)
        elif o is not None:
            found = _swap(_reach(graph, _swap(edges), o))
        else:
            found = closure_of(edges)
        return found if isinstance(expr, Plus) else found.unionByName(_zero(graph, g, s, o, seeds)).distinct()
    raise TypeError(f"not a path: {expr!r}")


def _closes(expr) -> bool:
    """Whether a closure is part of the path."""
    if isinstance(expr, (Plus, Star)):
        return True
    parts = expr.steps if isinstance(expr, Seq) else expr.options if isinstance(expr, Alt) else [expr.of] if isinstance(expr, (Inv, Opt)) else []
    return any(map(_closes, parts))


def _turned(expr):
    """The path from the other end, with the turning done on its parts; None for a single step."""
    if isinstance(expr, Seq):
        return Seq(*[Inv(e) for e in reversed(expr.steps)])
    if isinstance(expr, Alt):
        return Alt(*[Inv(e) for e in expr.options])
    if isinstance(expr, (Opt, Plus, Star)):
        return type(expr)(Inv(expr.of))
    return expr.of if isinstance(expr, Inv) else None


def _from_seeds(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    return pairs.join(seeds, same_term(F.col("s"), F.col("n")), "left_semi")


def _narrow(df: DataFrame, s: Term | None, o: Term | None) -> DataFrame:
    df = df if s is None else df.where(_equals(F.col("s"), s))
    return df if o is None else df.where(_equals(F.col("o"), o))


def _swap(df: DataFrame) -> DataFrame:
    return df.select(F.col("o").alias("s"), F.col("s").alias("o"))


def _compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs over a shared middle node; multiplicities are kept.  A literal has no outgoing edges."""
    left = a.select("s", F.col("o").alias("m"))
    right = b.select(F.col("s").alias("m2"), "o")
    return left.join(right, _same_node(a, "m", "m2"), "inner").select("s", "o")


def _same_node(pairs: DataFrame, x: str, y: str) -> Column:
    """Equality of two nodes of pairs, which are terms or, in closures, strings."""
    return same_term(F.col(x), F.col(y)) if isinstance(pairs.schema["s"].dataType, T.StructType) else F.col(x) == F.col(y)


def _negated(graph: Graph, members: Sequence, g: str) -> DataFrame:
    name = lambda m: m.value if isinstance(m, Term) else m
    forward = [name(m) for m in members if not isinstance(m, Inv)]
    backward = [name(m.of) for m in members if isinstance(m, Inv)]
    rows = graph.scan().where(F.col("g") == g)
    parts = []
    if forward or not backward:
        parts.append(rows.where(~F.col("p").isin(forward)).select("s", "o"))
    if backward:
        parts.append(_swap(rows.where(~F.col("p").isin(backward)).select("s", "o")))
    return reduce(DataFrame.unionByName, parts)


def _zero(graph: Graph, g: str, s: Term | None, o: Term | None, seeds: DataFrame | None = None) -> DataFrame:
    """Zero-length pairs: a bound end alone, even if absent from the graph, or the seeds; otherwise every node of the graph."""
    end = s or o
    if seeds is not None:
        return _narrow(seeds.select(F.col("n").alias("s"), F.col("n").alias("o")), s, o)
    if end is not None:
        return graph.spark.range(1).select(end.col.alias("s"), end.col.alias("o"))
    rows = graph.scan().where(F.col("g") == g)
    nodes = rows.select(F.col("s").alias("n")).unionByName(rows.select(F.col("o").alias("n"))).distinct()
    return nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))


# --- closures -----------------------------------------------------------------------------------------

class _Table:
    """A scratch table that grows by whole parts; its lineage is always just files."""

    def __init__(self, spark, label: str):
        self.spark, self.label, self.parts, self.schema = spark, label, [], None

    def append(self, df: DataFrame) -> int:
        """Write ``df`` as a new part and return its row count (counted during the write)."""
        at = scratch_path(self.spark, self.label)
        observed, seen = counted(df)
        observed.write.parquet(at)
        self.schema = df.schema
        rows = rows_seen(seen, self.spark.read.schema(df.schema).parquet(at))
        if rows or not self.parts:
            self.parts.append(at)
        return rows

    def read(self, last: bool = False) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(self.parts[-1:] if last else self.parts))


def _new_pairs(found: DataFrame, known: DataFrame) -> DataFrame:
    k = known.select(F.col("s").alias("ks"), F.col("o").alias("ko"))
    return found.distinct().join(k, _same_node(found, "s", "ks") & _same_node(found, "o", "ko"), "left_anti")


def _node_key(c: Column) -> Column:
    """A term as one string; the value, which may hold anything, comes last."""
    return F.concat_ws("\u0001", c["kind"], c["dt"], c["lang"], c["value"])


def _node_of(key: Column) -> Column:
    parts = F.split(key, "\u0001", 4)
    return F.struct(parts[0].alias("kind"), parts[3].alias("value"), parts[1].alias("dt"), parts[2].alias("lang"))


def closure_of(edges: DataFrame) -> DataFrame:
    """Distinct pairs joined by one or more edges, for all nodes.

    Strongly connected components are found first, on the edges; the closure is that of the graph of components, which has no
    cycle; its pairs become pairs of nodes in the last step, which is not stored.  Pairs inside a component arise there only.
    Nodes are single strings on the way, which join faster than terms."""
    keys, (_, size) = kept(edges.select(_node_key(F.col("s")).alias("a"), _node_key(F.col("o")).alias("b")).distinct(), "edges",
                           F.col("a") != F.col("b"))
    loops = keys.where("a = b")
    found = strong_components(keys, size)
    if found is None:
        pairs = closure(keys.where("a <> b").toDF("s", "o")).toDF("a", "b") if size else loops.limit(0)
    else:
        member = stored(found, "members")
        of = lambda at, to: member.select(F.col("node").alias(at), F.col("component").alias(to))
        whole = keys.join(of("x", "ca"), F.col("a") == F.col("x"), "left").join(of("y", "cb"), F.col("b") == F.col("y"), "left")
        whole = whole.select(F.coalesce("ca", "a").alias("s"), F.coalesce("cb", "b").alias("o")).where("s <> o").distinct()
        between, (n,) = kept(whole, "condensed")
        pairs = (closure(between) if n else between).toDF("a", "b")
        pairs = pairs.unionByName(member.select(F.col("component").alias("a"), F.col("component").alias("b")).distinct())
        pairs = pairs.join(of("x", "c"), F.col("a") == F.col("c"), "left").select(F.coalesce("x", "a").alias("a"), "b")
        pairs = pairs.join(of("y", "d"), F.col("b") == F.col("d"), "left").select("a", F.coalesce("y", "b").alias("b"))
        loops = loops.join(of("x", "c"), F.col("a") == F.col("x"), "left_anti")  # at nodes of no component
    return pairs.unionByName(loops.select("a", "b")).select(_node_of(F.col("a")).alias("s"), _node_of(F.col("b")).alias("o"))


def closure(edges: DataFrame) -> DataFrame:
    """Distinct pairs joined by one or more edges, for all nodes of a graph without large cycles.

    Round k knows the pairs with a walk of 1 to 2^k - 1 steps and, in ``jumps``, those of exactly 2^k steps.
    The next round adds the jumps and every known walk followed by a jump; each walk length arises once, so a
    long chain costs log2(length) rounds and no pair twice.  Cycles end when a round finds nothing new.
    """
    spark = edges.sparkSession
    jumps, known = _Table(spark, "jumps"), _Table(spark, "closure")
    size = jumps.append(edges.select("s", "o").distinct())
    known.parts, known.schema = list(jumps.parts), jumps.schema
    step = _compose(jumps.read(), jumps.read()).distinct()
    while size:
        if not jumps.append(step):
            break
        jump = jumps.read(last=True)
        longer = jump.unionByName(_compose(known.read(), jump))
        size = known.append(_new_pairs(longer, known.read()))
        step = _compose(jump, jump).distinct()
    return known.read()


def _reach_all(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct pairs (seed, node reached from it), by a frontier of pairs: no walk from any other node is built.

    Each round is one step, so there are as many as the longest shortest walk has steps."""
    edges = stored(edges.distinct(), "edges")
    known = _Table(edges.sparkSession, "reach")
    size = known.append(_from_seeds(edges, seeds))
    while size:
        size = known.append(_new_pairs(_compose(known.read(last=True), edges), known.read()))
    return known.read()


def _reach(graph: Graph, edges: DataFrame, start: Term) -> DataFrame:
    """Nodes reachable from one node, by a frontier that only ever joins with its own edges."""
    spark = graph.spark
    edges = stored(edges, "edges")
    known = _Table(spark, "reach")
    first = edges.where(_equals(F.col("s"), start)).select(F.col("o").alias("n")).distinct()
    size = known.append(first)
    while size:
        step = (known.read(last=True).select(F.col("n").alias("m"))
                .join(edges, same_term(F.col("m"), F.col("s")), "inner").select(F.col("o").alias("n")).distinct())
        old = known.read().select(F.col("n").alias("k"))
        size = known.append(step.join(old, same_term(F.col("n"), F.col("k")), "left_anti"))
    return known.read().select(start.col.alias("s"), F.col("n").alias("o"))


def _between(graph: Graph, edges: DataFrame, start: Term, end: Term) -> DataFrame:
    """The pair (start, end) if one or more edges lead from one to the other, else nothing.

    Two frontiers grow towards each other: nodes reached from the start, and nodes that lead to the end.  Each round takes the one
    whose last step is smaller, and the search ends when a new node is on the other side, or when a side finds nothing new.  So
    only a neighbourhood of both ends is read, not all that either of them reaches."""
    spark = graph.spark
    edges = stored(edges.distinct(), "edges")
    node = lambda c: F.col(c).alias("n")
    ahead, behind = _Table(spark, "ahead"), _Table(spark, "behind")
    sizes = {True: ahead.append(edges.where(_equals(F.col("s"), start)).select(node("o")).distinct()),
             False: behind.append(spark.range(1).select(end.col.alias("n")))}
    table = {True: ahead, False: behind}
    new = True
    while sizes[new]:
        other = table[not new].read().select(F.col("n").alias("k"))
        if not table[new].read(last=True).join(other, same_term(F.col("n"), F.col("k")), "left_semi").isEmpty():
            return spark.range(1).select(start.col.alias("s"), end.col.alias("o"))
        new = sizes[True] <= sizes[False]
        tip = table[new].read(last=True).select(F.col("n").alias("m"))
        at, to = ("s", "o") if new else ("o", "s")
        step = tip.join(edges, same_term(F.col("m"), F.col(at)), "inner").select(node(to)).distinct()
        old = table[new].read().select(F.col("n").alias("k"))
        sizes[new] = table[new].append(step.join(old, same_term(F.col("n"), F.col("k")), "left_anti"))
    return spark.range(0).select(start.col.alias("s"), end.col.alias("o"))

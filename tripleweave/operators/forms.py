"""Query forms: SELECT, ASK, CONSTRUCT and DESCRIBE results as DataFrames of output strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import TERM_TYPE, Term, bnode_term, lex, native_lex, native_term, same_term
from .graph import Graph, as_graph
from .modifiers import select_star
from .paths import _Table
from .patterns import Solutions, _constant, _is_var, var

#: Repeats of one solution that a task numbers at a time.
BLOCK = 1 << 14
TASKS = 128  # at least, that share the blocks


def select_form(a: Solutions, *names: str) -> DataFrame:
    """One string column per variable; unbound is the empty string."""
    names = [var(n) for n in names] or select_star(a).vars
    return a.df.select(*[F.coalesce(native_lex(F.col(n), a.types[n]), F.lit("")).alias(n) for n in names])


def ask_form(a: Solutions) -> DataFrame:
    """One row ``result boolean``; stops at the first solution."""
    return a.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))


def _with_occurrence(a: Solutions) -> DataFrame:
    """Number equal rows 0, 1, ...: blank nodes of a template are fresh per solution, even for equal ones.

    The rows are counted (a partial aggregate) and repeated, so no window holds a group.  The numbers of a solution are dealt
    out in blocks, so that a very frequent one is not repeated in one task.
    """
    counted = a.df.groupBy(*a.vars).agg(F.count(F.lit(1)).alias("_n"))
    last = F.col("_n") - 1
    blocks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(BLOCK).cast("bigint"))))
    # a block is a short row that becomes a long one: dealt out by number, as coalescing by bytes would leave all to one task
    dealt = blocks.repartition(max(TASKS, int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *a.vars, "_from")
    return dealt.select(*a.vars, F.explode(F.sequence("_from", F.least(last, F.col("_from") + BLOCK - 1))).alias("_i"))


def construct_triples(a: Solutions, template: Sequence[tuple]) -> DataFrame:
    """Template triples as a triples DataFrame (``s, p, o, g``), each once.

    Slots are ``"?var"``, ``"_:label"`` or constants.  A triple with an unbound slot, a literal subject or a
    predicate that is no IRI is left out.
    """
    labels = any(isinstance(x, str) and x.startswith("_:") for t in template for x in t)
    df = _with_occurrence(a) if labels else a.df
    row = F.to_json(F.struct(*[F.col(v) for v in a.vars])) if a.vars else F.lit("")

    def slot(x) -> Column:
        if _is_var(x):
            return native_term(F.col(var(x)), a.types[var(x)])
        if isinstance(x, str) and x.startswith("_:"):
            return bnode_term(F.sha1(F.concat_ws("\u0001", row, F.col("_i").cast("string"), F.lit(x))))
        return _constant(x).col

    triples = [F.struct(slot(s).alias("s"), slot(p).alias("p"), slot(o).alias("o"))
               for s, p, o in template]
    # triples with a fresh node can only be equal within their solution, so they need no shuffle to be told apart
    fresh = all(any(isinstance(x, str) and x.startswith("_:") for x in t) for t in template) and all(map(_told_apart, a.types.values()))
    cells = F.array_distinct(F.array(*triples)) if fresh else F.array(*triples)
    rows = df.select(F.explode(cells).alias("t")).select("t.s", "t.p", "t.o")
    fit = F.col("s").isNotNull() & (F.col("s.kind") != "lit") & (F.col("p.kind") == "iri") & F.col("o").isNotNull()
    found = rows.where(fit).select("s", F.col("p.value").alias("p"), "o", F.lit("").alias("g"))
    return found if fresh else found.distinct()


def _told_apart(kind: T.DataType) -> bool:
    """Whether JSON, which names fresh nodes, has another text for every value of a type; it cuts the microseconds of times."""
    if isinstance(kind, T.StructType):
        return all(_told_apart(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DecimalType))


def graph_form(triples: DataFrame) -> DataFrame:
    return triples.select(lex(F.col("s")).alias("subject"), F.col("p").alias("predicate"), lex(F.col("o")).alias("object"))


def construct_form(a: Solutions, template: Sequence[tuple]) -> DataFrame:
    return graph_form(construct_triples(a, template))


def describe_triples(graph: Graph | DataFrame, resources: Solutions | Sequence[Term], name: str | None = None) -> DataFrame:
    """Outgoing triples of the resources, and of the blank nodes these lead to."""
    graph = as_graph(graph)
    about = lambda nodes: graph.about(nodes).where(F.col("g") == "").select("s", "p", "o", "g")
    if isinstance(resources, Solutions):
        start = resources.df.select(F.col(var(name)).alias("n")).where(F.col("n").isNotNull()).distinct()
    else:
        start = graph.spark.createDataFrame([(t.row,) for t in resources], T.StructType(
            [T.StructField("n", TERM_TYPE)]))
    known = _Table(graph.spark, "describe")
    size = known.append(about(start))
    while size:
        seen = known.read()
        blank = (known.read(last=True).where(F.col("o.kind") == "bnode").select(F.col("o").alias("n")).distinct()
                 .join(seen.select(F.col("s").alias("done")), same_term(F.col("n"), F.col("done"), node=True), "left_anti"))
        if blank.isEmpty():  # known from what was found, without another look at the graph
            break
        size = known.append(about(blank))
    return known.read()


def describe_form(graph: Graph | DataFrame, resources, name: str | None = None) -> DataFrame:
    return graph_form(describe_triples(graph, resources, name))


def default_query(graph: Graph | DataFrame) -> DataFrame:
    """The query used when none is given: the first 100 triples of the default graph."""
    rows = as_graph(graph).scan().where(F.col("g") == "").limit(100)
    return graph_form(rows)


def count_results(result: DataFrame, boolean: bool = False) -> DataFrame:
    """Number of rows or triples of a result; an ASK counts as 1."""
    return result.agg((F.lit(1) if boolean else F.count(F.lit(1))).cast("bigint").alias("result_count"))

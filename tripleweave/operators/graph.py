"""What patterns are matched against: a triples table, or relational tables viewed as triples.

A triples DataFrame has ``s TERM, p string, o TERM, g string`` (``g = ''`` is the default graph).  Stored
triples are best kept as parquet partitioned by ``p``: a constant predicate then prunes partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, Term, same_term

TRIPLE_COLUMNS = ["s", "p", "o", "g"]


class Graph:
    """Triples held in one DataFrame."""

    def __init__(self, triples: DataFrame):
        self.triples = triples

    @property
    def spark(self):
        return self.triples.sparkSession

    def scan(self, p: str | None = None, s: Term | None = None, o: Term | None = None) -> DataFrame:
        """All triples, or those of one predicate.  Known ends may narrow what is read; the caller still filters."""
        return self.triples if p is None else self.triples.where(F.col("p") == p)

    def about(self, nodes: DataFrame) -> DataFrame:
        """All triples whose subject is a node ``n`` of a DataFrame."""
        return self.scan().join(nodes.select("n"), same_term(F.col("s"), F.col("n"), node=True), "left_semi")

    def in_star(self, p: str) -> bool:
        """Whether patterns with predicate ``p`` may be answered by :meth:`star`."""
        return False

    def star(self, wanted: Sequence[tuple[str, Term | str]]) -> DataFrame:
        """Same-subject patterns ``(predicate, object)`` in one pass: columns ``s, o0, o1, ...``."""
        raise NotImplementedError

    def functional(self, *predicates: str) -> FunctionalGraph:
        return FunctionalGraph(self.triples, predicates)


class FunctionalGraph(Graph):
    """Triples whose listed predicates hold at most one object per subject and graph.

    A star over such predicates needs one grouped pass (partial aggregation before the shuffle) in place of
    one join per pattern.  The caller vouches for the predicates, as with a declared unique key.
    """

    def __init__(self, triples: DataFrame, predicates: Sequence[str]):
        super().__init__(triples)
        self.predicates = frozenset(predicates)

    def in_star(self, p: str) -> bool:
        return p in self.predicates

    def star(self, wanted):
        names = [p for p, _ in wanted]
        rows = self.triples.where(F.col("p").isin(names) & (F.col("g") == ""))
        held = [F.when(F.col("p") == p, F.col("o")) for p in names]
        # two objects would be two solutions: an error, never one of them dropped
        two = [F.raise_error(F.lit(f"{p} has more than one object for a subject; it is not functional")) for p in names]
        ends = [e for i, o in enumerate(held) for e in (F.max(o).alias(f"max{i}"), F.min(o).alias(f"min{i}"))]
        wide = rows.groupBy("s").agg(*ends).select("s", *[
            F.when(F.col(f"max{i}") == F.col(f"min{i}"), F.col(f"max{i}")).when(F.col(f"max{i}").isNotNull(), two[i].cast(self.triples.schema["o"].dataType))
            .alias(f"o{i}") for i in range(len(names))])
        return wide.where(reduce(lambda a, b: a & b, [F.col(f"o{i}").isNotNull() for i in range(len(names))]))


class StoredGraph(Graph):
    """Triples stored by predicate and, within one, in buckets of subjects (see :func:`..sources.ingest.store_by_subject`).

    ``k`` is the subject as one string.  A star joins its predicates bucket by bucket, without a shuffle, and a chain shuffles only
    the side that arrives by its object."""

    def __init__(self, stored: DataFrame):
        super().__init__(stored.select(*TRIPLE_COLUMNS))
        self.stored = stored

    def in_star(self, p: str) -> bool:
        return True

    def star(self, wanted):
        parts = [self.stored.where((F.col("p") == p) & (F.col("g") == "")).select("k", "s", F.col("o").alias(f"o{i}"))
                 for i, (p, _) in enumerate(wanted)]
        return reduce(lambda a, b: a.join(b.drop("s").hint("merge"), "k"), parts).select("s", *[f"o{i}" for i in range(len(parts))])


def subject_key(s: Column) -> Column:
    """A subject as one string: its kind's first letter and its value."""
    return F.concat(F.substring(s["kind"], 1, 1), s["value"])


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_sql(kind: str, value: str, dt: str = "") -> str:
    """SQL text of a term whose value is a SQL expression and whose other fields are constants."""
    return f"named_struct('kind', '{kind}', 'value', {value}, 'dt', {_text(dt)}, 'lang', '')"


class TableMap:
    """How one table becomes triples: ``urn:<cls>/<key>`` subjects, one predicate per column.

    ``literals`` maps a predicate to ``(SQL expression, datatype)``, ``refs`` maps a predicate to
    ``(column, class of the target)``.  Without a unique ``key`` the subject is a digest of the whole row and
    equal rows are one subject, as equal triples are one triple.  ``distinct_rows`` vouches, as a declared key does, that
    no two rows are equal: the table is then read without a shuffle, and only in the columns that a pattern uses.
    """

    def __init__(self, source: DataFrame | Callable[[], DataFrame], cls: str, key: str | None,
                 literals: Mapping[str, tuple[str, str]] = {}, refs: Mapping[str, tuple[str, str]] = {},
                 distinct_rows: bool = False):
        self.cls, self._source, self._keyless, self._distinct_rows = cls, source, key is None, distinct_rows
        self.subject = term_sql("iri", f"concat('urn:{cls}/', cast({key or '_key'} as string))")
        self.ranges = {RDF_TYPE: ("iri", self.class_iri)}  # what a predicate's objects can be
        self.objects = {RDF_TYPE: ("true", term_sql("iri", _text(self.class_iri)))}  # presence test and object
        for p, (value, dt) in literals.items():
            self.objects[p] = (f"{value} IS NOT NULL", term_sql("lit", f"cast({value} as string)", dt))
            self.ranges[p] = ("lit", dt)
        for p, (column, target) in refs.items():
            self.objects[p] = (f"{column} IS NOT NULL", term_sql("iri", f"concat('urn:{target}/', cast({column} as string))"))
            self.ranges[p] = ("iri", f"urn:{target}/")

    @cached_property
    def df(self) -> DataFrame:
        """The table, opened when a pattern first needs it."""
        df = self._source() if callable(self._source) else self._source
        if self._keyless:
            cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in df.columns]
            df = (df if self._distinct_rows else df.dropDuplicates()).withColumn("_key", F.md5(F.concat_ws("\u0001", *cells)))
        return df

    @property
    def class_iri(self) -> str:
        return f"urn:class/{self.cls}"

    def can_hold(self, p: str, s: Term | None, o: Term | None) -> bool:
        """Whether a triple of ``p`` with these ends can come from this table."""
        if s is not None and not (s.kind == "iri" and s.value.startswith(f"urn:{self.cls}/")):
            return False
        kind, of = self.ranges[p]
        return o is None or o.kind == kind and (o.dt == of if kind == "lit" else o.value.startswith(of))

    def triples(self, p: str) -> DataFrame:
        present, obj = self.objects[p]
        return self.df.where(present).selectExpr(f"{self.subject} AS s", f"{_text(p)} AS p", f"{obj} AS o", "'' AS g")

    def about(self, nodes: DataFrame) -> DataFrame:
        """All triples of the given subjects: rows are found by subject first, in one pass for all predicates."""
        cells = [f"CASE WHEN {present} THEN named_struct('p', {_text(p)}, 'o', {obj}) END" for p, (present, obj) in self.objects.items()]
        rows = self.df.withColumn("_s", F.expr(self.subject)).join(nodes.select("n"), same_term(F.col("_s"), F.col("n"), node=True), "left_semi")
        held = rows.select(F.col("_s").alias("s"), F.explode(F.expr(f"array({', '.join(cells)})")).alias("t")).where("t IS NOT NULL")
        return held.select("s", "t.p", "t.o", F.lit("").alias("g"))

    def star(self, names: Sequence[str]) -> DataFrame:
        present = " AND ".join(f"({self.objects[p][0]})" for p in names)
        return self.df.where(present).selectExpr(
            f"{self.subject} AS s", *[f"{self.objects[p][1]} AS o{i}" for i, p in enumerate(names)])


class TableGraph(Graph):
    """Tables viewed as triples, never materialised.

    Each predicate knows its source columns, so a pattern with a constant predicate reads only those, and a
    star on one subject is a single scan of its table instead of a self-join per pattern.
    """

    def __init__(self, maps: Sequence[TableMap]):
        self.maps = list(maps)

    @property
    def spark(self):
        return self.maps[0].df.sparkSession

    @property
    def triples(self) -> DataFrame:
        return self.scan()

    def scan(self, p=None, s=None, o=None) -> DataFrame:
        parts = [m.triples(q) for m in self.maps for q in m.objects if p in (None, q) and m.can_hold(q, s, o)]
        if not parts:
            return self.maps[0].triples(RDF_TYPE).where(F.lit(False))
        return reduce(DataFrame.unionByName, parts)

    def about(self, nodes):
        # a subject names its class: only tables that some node can come from are read, one answer per class
        of = F.coalesce(*[F.when(F.col("n.value").startswith(f"urn:{c}/"), c) for c in sorted({m.cls for m in self.maps}, key=lambda c: -len(c))])
        wanted = {r["c"] for r in nodes.where(F.col("n.kind") == "iri").select(of.alias("c")).distinct().collect()}
        parts = [m.about(nodes) for m in self.maps if m.cls in wanted]
        return reduce(DataFrame.unionByName, parts) if parts else self.scan(RDF_TYPE).where(F.lit(False))

    def in_star(self, p: str) -> bool:
        return len({m.cls for m in self.maps}) == len(self.maps)  # a subject lives in one table

    def star(self, wanted):
        names = {p for p, _ in wanted}
        homes = [m for m in self.maps if names <= set(m.objects)]
        for p, o in wanted:
            if p == RDF_TYPE and isinstance(o, Term):
                homes = [m for m in homes if m.class_iri == o.value]
        if not homes:
            nothing = self.scan(RDF_TYPE).where(F.lit(False))
            return nothing.select("s", *[F.col("o").alias(f"o{i}") for i in range(len(wanted))])
        return reduce(DataFrame.unionByName, [m.star([p for p, _ in wanted]) for m in homes])


def as_graph(g: Graph | DataFrame) -> Graph:
    return g if isinstance(g, Graph) else Graph(g)

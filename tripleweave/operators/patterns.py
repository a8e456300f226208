"""Graph patterns: a solutions DataFrame has one nullable column per variable.

``Solutions.certain`` names the variables that are bound in every row.  Joins on certain variables are
ordinary equi-joins.  A shared variable that may be unbound matches anything; those joins stay equi-joins
too, see :class:`_Compat`, so no operator here compares all pairs of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import Lit, Term, TERM_TYPE, iri_term, make, native_term, same_columns, same_term, term
from .graph import Graph, as_graph

BROADCAST_ROWS = 10_000
SALTS = 64  # tasks that share a product without a small side
BUCKETS = 1 << 16  # in which rows are counted by their sure values before a join
PAIRS = 1024  # rows of the other side that a row is compared with at most, on average over its bucket, without regard to signatures


@dataclass(frozen=True)
class Solutions:
    df: DataFrame
    certain: frozenset[str] = frozenset()
    nodes: frozenset[str] = frozenset()  # variables that cannot hold a literal
    max_rows: int | None = field(default=None)  # proven bound, e.g. an inline VALUES list

    @cached_property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields}

    @property
    def vars(self) -> list[str]:
        return list(self.types)

    @property
    def maybe(self) -> frozenset[str]:
        return frozenset(self.vars) - self.certain

    def with_df(self, df: DataFrame, **changes) -> Solutions:
        return replace(self, df=df, **changes)


def var(name: str) -> str:
    return name.removeprefix("?")


def _is_var(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def _constant(x) -> Term:
    """Plain strings are IRIs in patterns; other Python values are literals."""
    if isinstance(x, Term):
        return x
    return Term("iri", x) if isinstance(x, str) else Lit(x)


def _equals(c: Column, k: Term) -> Column:
    cond = (c["kind"] == k.kind) & (c["value"] == k.value)
    return cond & (c["dt"] == k.dt) & (c["lang"] == k.lang) if k.kind == "lit" else cond


# --- triple patterns ----------------------------------------------------------------------------------

def triple_pattern(graph: Graph | DataFrame, s, p, o, g: str = "") -> Solutions:
    """Match one pattern; ``"?x"`` is a variable, anything else a constant.  ``g``: '' default graph, an IRI, or ``"?g"``."""
    graph = as_graph(graph)
    ends = [None if _is_var(x) else _constant(x) for x in (s, o)]
    df = graph.scan(None if _is_var(p) else (p.value if isinstance(p, Term) else p), *ends)
    if _is_var(g):
        df = df.where(F.col("g") != "")
    else:
        df = df.where(F.col("g") == (g.value if isinstance(g, Term) else g))
    cells: dict[str, Column] = {}
    nodes = set()
    for position, x, c in (("s", s, F.col("s")), ("p", p, iri_term(F.col("p"), nullable=False)),
                           ("o", o, F.col("o")), ("g", g, iri_term(F.col("g"), nullable=False))):
        if not _is_var(x):
            if position in "so":
                df = df.where(_equals(c, _constant(x)))
            continue
        name = var(x)
        if name in cells:  # a repeated variable is an equality
            df = df.where(same_term(cells[name], c, node=name in nodes or position != "o"))
        else:
            cells[name] = c
        if position != "o":
            nodes.add(name)
    df = df.select(*[c.alias(n) for n, c in cells.items()]) if cells else df.select(F.lit(True).alias("_"))
    return Solutions(df, frozenset(df.columns), frozenset(nodes))


def bgp(graph: Graph | DataFrame, *patterns: tuple, g: str = "") -> Solutions:
    """Conjunction of triple patterns.  Same-subject patterns are read together where the graph can do so."""
    graph = as_graph(graph)
    groups: dict[object, list[tuple]] = {}
    for i, (s, p, o) in enumerate(patterns):
        plain = p if isinstance(p, str) else p.value
        together = g == "" and not _is_var(p) and graph.in_star(plain)
        groups.setdefault((s, "star") if together else (s, i), []).append((s, plain, o))
    parts = [_star(graph, rows) if key[1] == "star" and len(rows) > 1 else
             reduce(join, [triple_pattern(graph, *row, g) for row in rows]) for key, rows in groups.items()]
    return join_all(parts)


def _star(graph: Graph, rows: Sequence[tuple]) -> Solutions:
    subject = rows[0][0]
    df = graph.star([(p, o) for _, p, o in rows])
    cells: dict[str, Column] = {}
    if _is_var(subject):
        cells[var(subject)] = F.col("s")
    else:
        df = df.where(_equals(F.col("s"), _constant(subject)))
    for i, (_, _, o) in enumerate(rows):
        c = F.col(f"o{i}")
        if not _is_var(o):
            df = df.where(_equals(c, _constant(o)))
        elif var(o) in cells:
            df = df.where(same_term(cells[var(o)], c))
        else:
            cells[var(o)] = c
    df = df.select(*[c.alias(n) for n, c in cells.items()]) if cells else df.select(F.lit(True).alias("_"))
    return Solutions(df, frozenset(df.columns), frozenset([var(subject)] if _is_var(subject) else []))


def join_all(parts: Sequence[Solutions]) -> Solutions:
    """Join in the given order, but take a connected part before an unconnected one."""
    todo = list(parts)
    done = todo.pop(0)
    while todo:
        i = next((i for i, x in enumerate(todo) if set(x.vars) & set(done.vars)), 0)
        done = join(done, todo.pop(i))
    return done


# --- joins --------------------------------------------------------------------------------------------

def _right(name: str) -> str:
    return f"{name}__r"


def _shared(a: Solutions, b: Solutions) -> list[str]:
    return [v for v in a.vars if v in b.types]


def _same_types(a: Solutions, b: Solutions) -> tuple[Solutions, Solutions]:
    """Give shared variables one type: a native column meets a term column as the literal it stands for."""
    mixed = [v for v in _shared(a, b) if a.types[v] != b.types[v]]
    return tuple(x.with_df(x.df.withColumns({v: native_term(F.col(v), x.types[v]) for v in mixed})) if mixed else x
                 for x in (a, b))


def _same(shared: Sequence[str], a: Solutions, b: Solutions) -> Column:
    """Join condition on shared variables that are bound on both sides."""
    conds = [same_columns(v, _right(v), node=v in a.nodes or v in b.nodes) if isinstance(a.types[v], T.StructType)
             else F.expr(f"`{v}` = `{_right(v)}`") for v in shared]
    return reduce(lambda x, y: x & y, conds)


def _renamed(b: Solutions, names: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    return b.df.select(*[F.col(v).alias(_right(v)) if v in names else F.col(v) for v in b.vars], *extra)


def _hint(b: Solutions, df: DataFrame) -> DataFrame:
    """Broadcast only a side whose row bound is proven; sized tables are left to Spark's own threshold."""
    return F.broadcast(df) if b.max_rows is not None and b.max_rows <= BROADCAST_ROWS else df


def _out(a: Solutions, b: Solutions, shared: Sequence[str], merge: bool) -> list[Column]:
    cells = []
    for v in a.vars:
        fill = merge and v in shared and v not in a.certain
        cells.append(F.coalesce(F.col(v), F.col(_right(v))).alias(v) if fill else F.col(v))
    return cells + [F.col(v) for v in b.vars if v not in shared]


def join(a: Solutions, b: Solutions, hot_keys: bool = False) -> Solutions:
    """Inner join on the shared variables (bag semantics).

    ``hot_keys`` measures the keys of ``a`` first and spreads those that hold many rows, see :func:`_spread`;
    without it AQE splits skewed partitions.
    """
    a, b = _same_types(a, b)
    shared = _shared(a, b)
    if not shared:
        return cross_join(a, b)
    if all(v in a.certain and v in b.certain for v in shared):
        right = _renamed(b, shared)
        cond = _same(shared, a, b)
        if hot_keys:
            df = _spread(a, shared, right, cond, "inner")
        else:
            df = _hint(a, a.df).join(_hint(b, right), cond, "inner")
        df = df.select(*_out(a, b, shared, False))
        return Solutions(df, a.certain | b.certain, a.nodes | b.nodes)
    df = _compat_inner(a, b, shared)
    return Solutions(df, a.certain | b.certain, (a.nodes | b.nodes) - (a.maybe & b.maybe))


def _spread(a: Solutions, shared: Sequence[str], right: DataFrame, cond: Column, how: str,
            salts: int = 32, share: int = 200) -> DataFrame:
    """Join in which the hot keys of ``a`` are salted.

    A key with more than 1/``share`` of the rows is hot; there are fewer than ``share`` of them, so their list
    is bounded by construction.  Hot rows of ``a`` get a salt from the whole row, the ``b`` rows of those keys
    are repeated once per salt; all other rows carry salt 0.
    """
    key_a = F.xxhash64(*[F.col(v) for v in shared])
    key_b = F.xxhash64(*[F.col(_right(v)) for v in shared])
    counts = a.df.groupBy(key_a.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = a.df.agg(F.count(F.lit(1)).alias("total"))
    hot = counts.join(F.broadcast(total), F.col("n") * share > F.col("total"), "inner").select("k")
    hot_list = [r["k"] for r in hot.collect()]
    is_hot = lambda k: k.isin(hot_list) if hot_list else F.lit(False)
    left = a.df.withColumn("_salt", F.when(is_hot(key_a), F.pmod(F.xxhash64(*a.df.columns, F.lit(7)), F.lit(salts)))
                           .otherwise(F.lit(0)).cast("int"))
    repeat = F.when(is_hot(key_b), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(right.withColumn("_salt_r", F.explode(repeat)), cond & (F.col("_salt") == F.col("_salt_r")), how)


@dataclass(frozen=True)
class _Compat:
    """Keys of compatible rows, where some shared variables may be unbound.

    A row's signature says which of these variables it binds.  Two rows are compared on the variables that both signatures
    hold, so every row is repeated once for each signature that occurs on the other side, and rows are joined on (signature of
    ``a``, signature of ``b``, values bound on both sides): one equi-join, however many variables there are.  If some variables are
    always bound, only signatures that occur with the row's own values of these count: rows without a partner are not repeated at all,
    others seldom.  Keys hold a hash of the values, and what the hashes find is compared in full.
    """

    a: Solutions
    b: Solutions
    shared: tuple[str, ...]

    @cached_property
    def unsure(self) -> list[str]:
        return [v for v in self.shared if v not in self.a.certain or v not in self.b.certain]

    @property
    def sure(self) -> bool:
        return len(self.unsure) < len(self.shared)

    def free(self, side: Solutions) -> list[str]:
        """The variables that the rows of a side bind or leave unbound."""
        return [v for v in self.unsure if v not in side.certain]

    def signature(self, side: Solutions) -> Column:
        always = sum(1 << i for i, v in enumerate(self.unsure) if v in side.certain)
        bits = [F.when(F.col(v).isNotNull(), F.lit(1 << self.unsure.index(v)).cast("bigint")).otherwise(0) for v in self.free(side)]
        return reduce(lambda x, y: x + y, bits, F.lit(always).cast("bigint"))

    def occurring(self, side: Solutions) -> Column:
        """The signatures of a side as an array: those that occur, counted before the join, or both if only one variable is free."""
        free = self.free(side)
        if len(free) > 1:
            found = side.df.groupBy(self.signature(side).alias("_s")).agg(F.lit(1)).agg(F.array_sort(F.collect_list("_s")))
            return found.scalar()
        always = sum(1 << i for i, v in enumerate(self.unsure) if v in side.certain)
        return F.array(*[F.lit(x).cast("bigint") for x in {always, always + sum(1 << self.unsure.index(v) for v in free)}])

    def with_signatures(self, side: Solutions, rows: DataFrame) -> DataFrame:
        """``rows`` with their own signature and the array ``_all`` of those on the other side that they are to meet."""
        other = self.b if side is self.a else self.a
        rows, free = rows.withColumn("_own", self.signature(side)), self.free(other)
        if not self.sure or len(free) < 2 or _few(other, 1 << len(free)):
            return rows.withColumn("_all", self.occurring(other))
        certain = [v for v in self.shared if v not in self.unsure]
        met = other.df.groupBy(*[F.col(v).alias(f"_s_{v}") for v in certain]).agg(F.collect_set(self.signature(other)).alias("_all"))
        cond = reduce(lambda x, y: x & y, [F.col(v).eqNullSafe(F.col(f"_s_{v}")) for v in certain])
        return rows.join(met, cond, "inner").drop(*[f"_s_{v}" for v in certain])

    def bucket(self, side: Solutions) -> Column:
        return F.pmod(F.xxhash64(*[F.col(v) for v in self.shared if v not in self.unsure]), F.lit(BUCKETS)).alias("_bucket")

    def crowded(self) -> DataFrame | None:
        """The buckets of sure values whose pairs are too many to compare them all: at most ``BUCKETS`` numbers, counted now; none: None."""
        n, m = (side.df.groupBy(self.bucket(side)).agg(F.count(F.lit(1)).cast("double").alias(c)) for side, c in ((self.a, "n"), (self.b, "m")))
        found = n.join(m, "_bucket").where(F.col("n") * F.col("m") > PAIRS * (F.col("n") + F.col("m"))).select("_bucket").collect()
        return self.a.df.sparkSession.createDataFrame([tuple(r) for r in found], "_bucket long") if found else None

    def within(self, side: Solutions, buckets: DataFrame, how: str) -> Solutions:
        """The rows of a side whose bucket is (``left_semi``) or is not (``left_anti``) among the given ones."""
        held = side.df.withColumn("_in", self.bucket(side)).join(F.broadcast(buckets), F.col("_in") == F.col("_bucket"), how)
        return side.with_df(held.drop("_in"))

    def keyed(self, side: Solutions, rows: DataFrame, name: str, salts: str = "", allow_empty: bool = True) -> DataFrame:
        """``rows``, which have the shared variables of a side, repeated with the key that they must agree on.

        Pairs of signatures without a common variable (and no variable that is sure) make all their rows compatible: with
        ``salts`` such a product is dealt out, each row ``"drawn"`` to one salt or sent to ``"all"``; ``allow_empty=False`` leaves it out."""
        rows = self.with_signatures(side, rows).withColumn("_other", F.explode("_all"))
        common = F.col("_own").bitwiseAND(F.col("_other"))
        first, second = ("_own", "_other") if side is self.a else ("_other", "_own")
        cells = [F.col(first).alias("_a"), F.col(second).alias("_b")]
        if not self.sure and not allow_empty:
            rows = rows.where(common != 0)
        elif not self.sure and salts == "all":
            deal = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
            rows = rows.withColumn("_salt", F.explode(F.when(common == 0, deal).otherwise(F.array(F.lit(0).cast("bigint")))))
        elif not self.sure and salts == "drawn":
            rows = rows.withColumn("_salt", F.when(common == 0, F.pmod(F.xxhash64(*side.vars, F.lit(3)), F.lit(SALTS))).otherwise(0).cast("bigint"))
        if "_salt" in rows.columns:
            cells.append(F.col("_salt").alias("_c"))
        cells.append(F.xxhash64(*[F.when(self._held(v, common), F.col(v)) for v in self.shared]).alias("_h"))
        return rows.withColumn(name, F.struct(*cells)).drop("_own", "_all", "_other", "_salt")

    def _held(self, v: str, common: Column) -> Column:
        return common.bitwiseAND(F.lit(1 << self.unsure.index(v)).cast("bigint")) != 0 if v in self.unsure else F.lit(True)

    def compared(self, key: str) -> list[Column]:
        """The shared variables by their names on the right; null where the key leaves them out."""
        common = F.col(f"{key}._a").bitwiseAND(F.col(f"{key}._b"))
        return [F.when(self._held(v, common), F.col(v)).alias(_right(v)) for v in self.shared]

    def equal(self, left: DataFrame, x: str, y: str) -> Column:
        """Equality of two keys, field by field, and of the values that both rows bind."""
        fields = [F.col(f"{x}.{f.name}") == F.col(f"{y}.{f.name}") for f in left.schema[x].dataType.fields]
        return reduce(lambda p, q: p & q, fields + self.agree())

    def agree(self) -> list[Column]:
        """Equality of the values that both rows bind."""
        return [(F.col(v).isNull() | F.col(_right(v)).isNull() if v in self.unsure else F.lit(False)) | F.col(v).eqNullSafe(F.col(_right(v)))
                for v in self.shared]


def _few(side: Solutions, copies: int) -> bool:
    return side.max_rows is not None and side.max_rows * copies <= BROADCAST_ROWS


def _compat_inner(a: Solutions, b: Solutions, shared: Sequence[str]) -> DataFrame:
    """Inner join of compatible rows.

    Rows with the same sure values are joined by these and compared, so each is shuffled once; only where they are too many for
    that, see :meth:`_Compat.crowded`, they are repeated by signatures."""
    by = _Compat(a, b, tuple(shared))
    few_a, few_b = _few(a, 1 << len(by.free(b))), _few(b, 1 << len(by.free(a)))
    if not by.sure or few_a or few_b or max(len(by.free(a)), len(by.free(b))) < 2:
        return _compat_signed(by, few_a, few_b)
    crowded = by.crowded()
    if crowded is None:
        return _compat_compared(by)
    rest, dense = ([by.within(side, crowded, how) for side in (a, b)] for how in ("left_anti", "left_semi"))
    return _compat_compared(replace(by, a=rest[0], b=rest[1])).unionByName(_compat_signed(replace(by, a=dense[0], b=dense[1])))


def _compat_compared(by: _Compat) -> DataFrame:
    """All pairs of rows with the same sure values, those kept that agree."""
    cond = reduce(lambda p, q: p & q, by.agree())
    return by.a.df.join(_renamed(by.b, by.shared), cond, "inner").select(*_out(by.a, by.b, by.shared, True))


def _compat_signed(by: _Compat, few_a: bool = False, few_b: bool = False) -> DataFrame:
    """Rows repeated by the signatures they are to meet, joined by key."""
    a, b, shared = by.a, by.b, by.shared
    salts = ("", "") if few_a or few_b else ("drawn", "all")
    left = by.keyed(a, a.df, "_key", salts[0])
    right = by.keyed(b, b.df, "_key_r", salts[1])
    right = right.select(*[F.col(v).alias(_right(v)) if v in shared else F.col(v) for v in b.vars], "_key_r")
    left, right = F.broadcast(left) if few_a and not few_b else left, F.broadcast(right) if few_b else right
    return left.join(right, by.equal(left, "_key", "_key_r"), "inner").select(*_out(a, b, shared, True))


def _product(a: Solutions, b: Solutions, shared: Sequence[str] = (), how: str = "inner", on: Column | None = None) -> DataFrame:
    """All pairs.  A side that is small by construction is broadcast.  Otherwise the pairs are dealt out: each row of ``a``
    draws one of ``SALTS`` numbers, each row of ``b`` goes to all of them, and an equi-join on the number streams one
    side past the other, so no row count is too large and nothing unbounded is held in memory."""
    right = _renamed(b, shared)
    if b.max_rows is not None and b.max_rows <= BROADCAST_ROWS:
        df = a.df.join(F.broadcast(right), F.lit(True) if on is None else on, how)
    elif how == "inner" and a.max_rows is not None and a.max_rows <= BROADCAST_ROWS:
        df = F.broadcast(a.df).join(right, F.lit(True) if on is None else on, how)
    else:
        salted = a.df.withColumn("_salt", F.pmod(F.xxhash64(*a.df.columns, F.lit(3)), F.lit(SALTS)))
        everywhere = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        same = F.col("_salt") == F.col("_salt_r")
        df = salted.join(everywhere.hint("merge"), same if on is None else same & on, how)
    return df.select(*_out(a, b, shared, True))


def cross_join(a: Solutions, b: Solutions) -> Solutions:
    """Join without shared variables: all pairs, see :func:`_product`."""
    if _shared(a, b):
        raise ValueError("cross_join needs two sides without shared variables")
    rows = a.max_rows * b.max_rows if a.max_rows is not None and b.max_rows is not None else None
    return Solutions(_product(a, b), a.certain | b.certain, a.nodes | b.nodes, rows)


def optional(a: Solutions, b: Solutions, on: Column | None = None, hot_keys: bool = False) -> Solutions:
    """Left join; ``on`` is a FILTER inside the OPTIONAL and may use variables of both sides.  ``hot_keys`` as in :func:`join`."""
    a, b = _same_types(a, b)
    shared = _shared(a, b)
    nodes = a.nodes | (b.nodes - set(a.vars))
    if not shared:
        return Solutions(_product(a, b, shared, "left", on), a.certain, nodes)
    if all(v in a.certain and v in b.certain for v in shared):
        cond = _same(shared, a, b)
        cond = cond if on is None else cond & on
        if hot_keys:
            df = _spread(a, shared, _renamed(b, shared), cond, "left")
        else:
            df = a.df.join(_hint(b, _renamed(b, shared)), cond, "left")
        return Solutions(df.select(*_out(a, b, shared, False)), a.certain, nodes)
    matched = join(a, b)
    if on is not None:
        matched = filter_(matched, on)
        lonely = _without(a, b, shared, on)
    else:
        lonely = _compat_filter(a, b, shared, "left_anti", allow_empty=True)
    df = matched.df.unionByName(lonely, allowMissingColumns=True)
    return Solutions(df.select(*matched.vars), a.certain, frozenset())


def _hits(a: Solutions, b: Solutions, on: Column) -> DataFrame:
    """The distinct rows of ``a`` for which some compatible row of ``b`` passes ``on``, under other names."""
    # the join may fill a variable of ``a`` from ``b``: carry the row as it was, to find it again
    as_was = a.with_df(a.df.withColumns({f"_own_{v}": F.col(v) for v in a.vars}))
    hits = filter_(join(as_was, b), on)
    return hits.df.select(*[F.col(f"_own_{v}").alias(_right(v)) for v in a.vars]).distinct()


def _same_cells(names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(v).eqNullSafe(F.col(_right(v))) for v in names])


def _without(a: Solutions, b: Solutions, shared, on: Column) -> DataFrame:
    """Rows of ``a`` for which no compatible row of ``b`` passes ``on``."""
    return a.df.join(_hits(a, b, on), _same_cells(a.vars), "left_anti")


def _compat_found(a: Solutions, b: Solutions, shared: Sequence[str], allow_empty: bool) -> DataFrame:
    """The distinct values of the shared variables in ``a`` for which ``b`` has a compatible row, under other names."""
    by = _Compat(a, b, tuple(shared))
    wanted = by.keyed(a, a.df.select(*shared).distinct(), "_key", allow_empty=allow_empty)
    keys = by.keyed(b, b.df.select(*shared).distinct(), "_key_r", allow_empty=allow_empty).select("_key_r", *by.compared("_key_r"))
    if not by.sure:  # very many rows may be left with one key
        keys = keys.distinct()
    found = wanted.join(keys, by.equal(wanted, "_key", "_key_r"), "left_semi")
    return found.select(*[F.col(v).alias(_right(v)) for v in shared]).distinct()


def _compat_filter(a: Solutions, b: Solutions, shared: Sequence[str], how: str, allow_empty: bool) -> DataFrame:
    """Rows of ``a`` with (``left_semi``) or without (``left_anti``) a compatible row in ``b``."""
    return a.df.join(_compat_found(a, b, shared, allow_empty), _same_cells(shared), how)


def _compat_marked(a: Solutions, b: Solutions, shared: Sequence[str], allow_empty: bool) -> DataFrame:
    """``a`` with ``_hit``: whether ``b`` has a compatible row."""
    found = _compat_found(a, b, shared, allow_empty).withColumn("_hit", F.lit(True))
    return a.df.join(found, _same_cells(shared), "left").select(*a.vars, F.coalesce("_hit", F.lit(False)).alias("_hit"))


# --- set-like operators -------------------------------------------------------------------------------

def union(a: Solutions, b: Solutions) -> Solutions:
    """Bag union; variables of one side only are unbound on the other."""
    a, b = _same_types(a, b)
    df = a.df.unionByName(b.df, allowMissingColumns=True)
    both = frozenset(v for v in df.columns if all(v in x.nodes or v not in x.types for x in (a, b)))
    rows = a.max_rows + b.max_rows if a.max_rows is not None and b.max_rows is not None else None
    return Solutions(df, a.certain & b.certain, both, rows)


def _semi(a: Solutions, b: Solutions, how: str) -> Solutions:
    a, b = _same_types(a, b)
    shared = _shared(a, b)
    if not shared:
        some = b.df.limit(1).select(F.lit(True).alias("_some"))
        return a.with_df(a.df.join(F.broadcast(some), F.col("_some"), how))
    if all(v in a.certain and v in b.certain for v in shared):
        right = b.df.select(*[F.col(v).alias(_right(v)) for v in shared])
        cond = _same(shared, a, b)
        return a.with_df(a.df.join(_hint(b, right), cond, how))
    return a.with_df(_compat_filter(a, b, shared, how, allow_empty=True))


def exists(a: Solutions, b: Solutions, on: Column | None = None) -> Solutions:
    """FILTER EXISTS.  ``on`` is a filter inside the pattern that also uses variables of ``a``."""
    return _semi(a, b, "left_semi") if on is None else _semi_on(a, b, on, "left_semi")


def not_exists(a: Solutions, b: Solutions, on: Column | None = None) -> Solutions:
    return _semi(a, b, "left_anti") if on is None else _semi_on(a, b, on, "left_anti")


def _semi_on(a: Solutions, b: Solutions, on: Column, how: str) -> Solutions:
    a, b = _same_types(a, b)
    shared = _shared(a, b)
    if not shared or not all(v in a.certain and v in b.certain for v in shared):
        return a.with_df(a.df.join(_hits(a, b, on), _same_cells(a.vars), how))
    cond = _same(shared, a, b)
    return a.with_df(a.df.join(_renamed(b, shared), cond & on, how))


def exists_value(a: Solutions, b: Solutions, name: str) -> Solutions:
    """EXISTS as an expression: a boolean variable instead of a filter."""
    a, b = _same_types(a, b)
    shared = _shared(a, b)
    if not shared:
        some = b.df.limit(1).select(F.lit(True).alias("_found"))
        df = a.df.join(F.broadcast(some), F.col("_found"), "left").select(*a.vars, F.col("_found").isNotNull().alias(name))
        return Solutions(df, a.certain | {name}, a.nodes, a.max_rows)
    if not all(v in a.certain and v in b.certain for v in shared):
        df = _compat_marked(a, b, shared, True).withColumnRenamed("_hit", name)
        return Solutions(df, a.certain | {name}, a.nodes, a.max_rows)
    keys = b.df.select(*[F.col(v).alias(_right(v)) for v in shared]).distinct().withColumn("_found", F.lit(True))
    cond = _same(shared, a, b)
    df = a.df.join(keys, cond, "left").select(*a.vars, F.col("_found").isNotNull().alias(name))
    return Solutions(df, a.certain | {name}, a.nodes, a.max_rows)


def minus(a: Solutions, b: Solutions) -> Solutions:
    """Remove rows with a compatible row in ``b`` that shares at least one bound variable."""
    a, b = _same_types(a, b)
    shared = _shared(a, b)
    if not shared:
        return a
    if all(v in a.certain and v in b.certain for v in shared):
        return _semi(a, b, "left_anti")
    return a.with_df(_compat_filter(a, b, shared, "left_anti", allow_empty=False))


# --- row-wise operators -------------------------------------------------------------------------------

def filter_(a: Solutions, cond: Column) -> Solutions:
    """Keep rows whose condition is true; an error is NULL and drops the row."""
    return a.with_df(a.df.where(cond))


def filter_bound(a: Solutions, *names: str) -> Solutions:
    """FILTER(BOUND(?x) && ...): the variables are certain afterwards."""
    names = [var(n) for n in names]
    df = a.df.where(reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in names]))
    return a.with_df(df, certain=a.certain | set(names))


def with_terms(df: DataFrame, exprs: dict) -> DataFrame:
    """Add columns for expressions.  The value of a computed term is first put into a column of its own, since the
    term mentions it twice (is it bound, and what is it) and Spark would compute it twice.
    """
    first, then = {}, {}
    for name, x in exprs.items():
        c = term(x)
        v = vars(c).get("view")
        if v is None or isinstance(x, Term):
            then[name] = c
            continue
        first[f"_v_{name}"] = v.value
        fields = {"dt": v.dt, "lang": v.lang}
        for f, field_value in fields.items():
            if isinstance(field_value, Column):
                first[f"_{f}_{name}"] = field_value
        cells = [F.col(f"_{f}_{name}") if isinstance(x, Column) else F.lit(x) for f, x in fields.items()]
        value = F.col(f"_v_{name}")
        then[name] = F.when(value.isNotNull(), make(F.lit(v.kind), value, *cells))
    return (df.withColumns(first) if first else df).withColumns(then).drop(*first)


def bind(a: Solutions, name: str, expr, certain: bool = False) -> Solutions:
    """BIND(expr AS ?name); an error leaves the variable unbound."""
    name = var(name)
    if name in a.types:
        raise ValueError(f"?{name} is already in scope")
    return a.with_df(with_terms(a.df, {name: expr}), certain=a.certain | {name} if certain else a.certain)


def values(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> Solutions:
    """Inline rows of constants; ``None`` is UNDEF."""
    names = [var(n) for n in names]
    cells = [tuple(None if x is None else (x if isinstance(x, Term) else Lit(x)).row for x in r) for r in rows]
    schema = T.StructType([T.StructField(n, TERM_TYPE) for n in names])
    df = spark.createDataFrame(cells, schema)
    certain = frozenset(n for i, n in enumerate(names) if all(r[i] is not None for r in cells))
    return Solutions(df, certain, max_rows=len(cells))


def dataset(triples: DataFrame, from_: Sequence[str] = (), from_named: Sequence[str] = ()) -> DataFrame:
    """FROM merges graphs into the default graph, FROM NAMED chooses the visible named graphs."""
    if not from_ and not from_named:
        return triples
    columns = ["s", "p", "o", "g"]
    parts = []
    if from_:
        merged = triples.where(F.col("g").isin(list(from_))).withColumn("g", F.lit(""))
        parts.append(merged.select(*columns).dropDuplicates(columns))
    if from_named:
        parts.append(triples.where(F.col("g").isin(list(from_named))).select(*columns))
    return reduce(DataFrame.unionByName, parts)

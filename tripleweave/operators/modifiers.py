"""Solution modifiers: projection, DISTINCT, ORDER BY, LIMIT and OFFSET."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import TERM_TYPE, sort_keys
from ..session import in_order
from .patterns import Solutions, var, with_terms


SHORT = 50_000  # rows up to the end of a slice that Spark may take in one task


def project(a: Solutions, *names: str, **exprs) -> Solutions:
    """SELECT of variables in the given order, then ``name=expression`` columns (``(expr AS ?name)``)."""
    names = [var(n) for n in names]
    cells = [F.col(n) if n in a.types else F.lit(None).cast(TERM_TYPE).alias(n) for n in names]
    df = with_terms(a.df, {f"_e_{n}": e for n, e in exprs.items()}) if exprs else a.df
    cells += [F.col(f"_e_{n}").alias(n) for n in exprs]
    keep = set(names)
    return Solutions(df.select(*cells), a.certain & keep, a.nodes & keep, a.max_rows)


def select_star(a: Solutions) -> Solutions:
    """All visible variables; names starting with ``_`` are internal (unnamed positions)."""
    return project(a, *[v for v in a.vars if not v.startswith("_")])


def subselect(a: Solutions, *names: str) -> Solutions:
    """A nested SELECT: only the projected variables reach the outer pattern."""
    return project(a, *names)


def distinct(a: Solutions) -> Solutions:
    return a.with_df(a.df.distinct())


def reduced(a: Solutions) -> Solutions:
    """REDUCED permits duplicates to stay; keeping them avoids a shuffle."""
    return a


@dataclass(frozen=True)
class Desc:
    key: object


def desc(key) -> Desc:
    return Desc(key)


def order_by(a: Solutions, *keys, keep: Sequence[str] | None = None) -> Solutions:
    """ORDER BY variables, expressions, or ``desc(...)`` of either.  ``keep`` names the variables that are selected: the others,
    unless they are keys, are not computed, and no row carries them through the sort.

    Keys are computed once per row, in columns of their own, not at every comparison.  Terms are taken apart before and put together
    after the sort: fields that are constant then drop out of the keys and are not shuffled.  Rows with equal keys are
    ordered by a hash of the row: the sort's range partitioning can then divide a value that very many rows share,
    and a following LIMIT always returns the same rows.
    """
    kept = a.vars if keep is None else [var(v) for v in keep]
    terms = [v for v, t in a.types.items() if isinstance(t, T.StructType) and t.fieldNames() == TERM_TYPE.fieldNames()]
    apart = {v: [f"_{f}_of_{v}" for f in TERM_TYPE.fieldNames()] if v in terms else [v] for v in a.vars}
    together = {v: F.struct(*[F.col(c).alias(f) for c, f in zip(apart[v], TERM_TYPE.fieldNames())]) for v in terms}
    fields = a.df.select(*[F.col(v)[f].alias(c) if v in together else F.col(v) for v in a.vars for c, f in zip(apart[v], TERM_TYPE.fieldNames())])
    whole = fields.withColumns({v: F.when(F.col(apart[v][0]).isNotNull(), t) for v, t in together.items()})  # for keys that are expressions
    cells, order = {}, []
    for key in keys:
        down, k = (True, key.key) if isinstance(key, Desc) else (False, key)
        if not isinstance(k, str):
            parts = sort_keys(k, a.df.select(k.alias("k")).schema["k"].dataType)
        elif (v := var(k)) in together:
            parts = [*sort_keys(together[v], TERM_TYPE)[:-3], *apart[v][1:]]  # value, datatype and language are there
        else:
            parts = sort_keys(F.col(v), a.types[v])
        for part in parts:
            name = part if isinstance(part, str) else f"_order{len(cells)}"
            if name is not part:
                cells[name] = part
            order.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first())
    cells["_tie"] = F.xxhash64(*[F.col(c) for v in kept for c in apart[v]])
    keyed = whole.withColumns(cells).select(*fields.columns, *cells).orderBy(*order, "_tie")
    cells = [F.when(F.col(apart[v][0]).isNotNull(), together[v]).alias(v) if v in together else F.col(v) for v in kept]
    return project(a.with_df(keyed.select(*cells)), *kept)


def slice_(a: Solutions, limit: int | None = None, offset: int = 0) -> Solutions:
    """OFFSET and LIMIT, in the order that the rows have.

    Short slices from the start are Spark's own.  Others are cut where the rows lie: the sorted rows are kept in a checkpoint, their
    numbers by partition are counted, and each partition keeps its share, so no task sees more than its own rows."""
    if limit is None and not offset:
        return a
    if limit is not None and offset + limit <= SHORT:
        return a.with_df((a.df.offset(offset) if offset else a.df).limit(limit), max_rows=limit)
    rows = in_order(a.df)
    at = F.monotonically_increasing_id()  # the partition, and the row's place in it
    numbered = rows.withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit((1 << 33) - 1))})
    shares, start = [], 0
    for part, n in sorted(tuple(r) for r in numbered.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        low, high = max(0, offset - start), n if limit is None else min(n, offset + limit - start)
        if low < high:
            shares.append((part, low, high))
        start += n
    # one short row per partition, on the driver as partitions are
    shares = a.df.sparkSession.createDataFrame(shares, "_of long, _low long, _high long")
    cut = numbered.join(F.broadcast(shares), (F.col("_part") == F.col("_of")) & (F.col("_row") >= F.col("_low")) & (F.col("_row") < F.col("_high")))
    return a.with_df(cut.select(*a.vars), max_rows=limit)

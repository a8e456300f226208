"""GROUP BY, HAVING and the SPARQL aggregates.

Every aggregate here is partial before the shuffle, so a hot group costs one row per task; DISTINCT
aggregates shuffle on (group, value) first, SUM and AVG on (group, term), since ``1`` and ``1.0`` are two terms of one value.
GROUP_CONCAT joins blocks of sorted members first, then the blocks of a group.  Unbound and erroneous members are ignored unless
``strict_errors`` is set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import (
    DECIMAL, DECIMAL_RANK, FLOAT_RANK, INTEGER_RANK, decimal_text, double_text, exact_num, literal_term, native_lex, num,
    numeric_rank, rank_dt, sort_keys, term,
)
from .patterns import Solutions, var, with_terms
from .ranges import RangePairs


BLOCK_BITS = 12  # a block of GROUP_CONCAT holds up to 4,096 distinct members


@dataclass(frozen=True)
class Agg:
    kind: str
    arg: object = None
    distinct: bool = False
    sep: str = " "


def count(x, distinct: bool = False) -> Agg:
    return Agg("count", x, distinct)


def count_distinct(x) -> Agg:
    return Agg("count", x, True)


def count_star(distinct: bool = False) -> Agg:
    return Agg("count_star", None, distinct)


def sum_(x, distinct: bool = False) -> Agg:
    return Agg("sum", x, distinct)


def avg(x, distinct: bool = False) -> Agg:
    return Agg("avg", x, distinct)


def min_(x) -> Agg:
    return Agg("min", x)


def max_(x) -> Agg:
    return Agg("max", x)


def sample(x) -> Agg:
    return Agg("sample", x)


def group_concat(x, sep: str = " ", distinct: bool = False) -> Agg:
    return Agg("group_concat", x, distinct, sep)


def group(a: Solutions, by=(), having: Column | None = None, strict_errors: bool = False, **aggs: Agg) -> Solutions:
    """GROUP BY ``by`` (variable names, or ``(name, expression)`` pairs) with the named aggregates.

    An empty ``by`` is the implicit single group, which exists on empty input too.  ``having`` sees the results.
    """
    names = []
    for key in by:
        if isinstance(key, tuple):
            a = a.with_df(with_terms(a.df, {key[0]: key[1]}))
            names.append(key[0])
        else:
            names.append(var(key))
    if isinstance(a, RangePairs) and not strict_errors:
        a, aggs = _of_ranges(a, names, aggs)
    apart = {name: agg for name, agg in aggs.items() if _own_pass(a, agg)}
    parts = [_concatenated(a, names, name, agg) if agg.kind == "group_concat" else _by_term(a, names, name, agg, strict_errors)
             for name, agg in apart.items()]
    if len(apart) < len(aggs) or not aggs:
        work: dict[str, Column] = {}  # inputs of the aggregates, computed once per row
        cells = [_aggregate(a, agg, strict_errors, work).alias(name) for name, agg in aggs.items() if name not in apart]
        rows = a.df.withColumns(work) if work else a.df
        parts.insert(0, rows.groupBy(*names).agg(*cells) if cells else rows.select(*names).distinct())
    df = reduce(lambda x, y: _side_by_side(x, y, names), parts).select(*names, *aggs)
    if having is not None:
        df = df.where(having)
    sure = {n for n, g in aggs.items() if g.kind.startswith("count") or g.kind == "group_concat"}
    if not strict_errors:
        sure |= {n for n, g in aggs.items() if g.kind in ("sum", "avg")}
    return Solutions(df, (a.certain & set(names)) | sure, a.nodes & set(names), None if names else 1)


def _of_ranges(a: RangePairs, names: list[str], aggs: dict[str, Agg]) -> tuple[Solutions, dict[str, Agg]]:
    """The ranges with what they hold in place of their pairs, and the same aggregates over these, if that can tell them."""
    if not a.sortable or not set(names) <= set(a.b.vars):
        return a, aggs
    told = {("count_star", None): sum_("_n"), ("min", var(a.x)): min_("_first"), ("max", var(a.x)): max_("_last")}
    keys = {name: (g.kind, var(g.arg) if isinstance(g.arg, str) else g.arg) for name, g in aggs.items()}
    if any(aggs[name].distinct or not isinstance(key[1], str | None) or key not in told for name, key in keys.items()):
        return a, aggs
    found = {name: told[key] for name, key in keys.items()}
    return a.with_df(a.places()), found


def _side_by_side(x: DataFrame, y: DataFrame, names: list[str]) -> DataFrame:
    """Aggregates of the same groups in one row; without groups both have one row."""
    if not names:
        return x.join(F.broadcast(y))
    y = y.withColumnsRenamed({n: f"_{n}_y" for n in names})
    same = reduce(lambda p, q: p & q, [F.col(n).eqNullSafe(F.col(f"_{n}_y")) for n in names])
    return x.join(y, same).drop(*[f"_{n}_y" for n in names])


def _own_pass(a: Solutions, agg: Agg) -> bool:
    """Whether an aggregate has a grouping of its own below that by the group."""
    if agg.kind == "group_concat":
        return True
    return agg.kind in ("sum", "avg") and agg.distinct and isinstance(_argument(a, agg.arg)[1], T.StructType)


def _by_term(a: Solutions, names: list[str], name: str, agg: Agg, strict: bool) -> DataFrame:
    """SUM or AVG over the distinct terms of each group."""
    c, _ = _argument(a, agg.arg)
    terms = a.df.select(*names, c.alias("_member")).distinct()
    return group(Solutions(terms, a.certain & set(names)), names, strict_errors=strict, **{name: Agg(agg.kind, "_member")}).df


def _concatenated(a: Solutions, names: list[str], name: str, agg: Agg) -> DataFrame:
    """GROUP_CONCAT of members in text order.

    Equal members are counted first.  The distinct ones are range sorted and cut into blocks as they lie; each block of a group
    is joined to a text, and a group is joined from the texts of its blocks, so no task holds all members of a group one by one."""
    v = native_lex(*_argument(a, agg.arg))
    members = a.df.select(*names, v.alias("_m")).groupBy(*names, "_m").agg(F.count(F.lit(1)).alias("_n"))
    laid = members.repartitionByRange(*names, "_m").sortWithinPartitions(*names, "_m")
    laid = laid.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    again = F.lit(1) if agg.distinct else F.col("_n")
    text = F.concat("_m", F.repeat(F.concat(F.lit(agg.sep), F.col("_m")), (again - 1).cast("int")))
    pieces = F.array_sort(F.collect_list(F.when(F.col("_m").isNotNull(), F.struct("_m", text.alias("text")))))
    blocks = laid.groupBy(*names, "_block").agg(F.count("_m").alias("_held"), F.array_join(pieces["text"], agg.sep).alias("_text"))
    some = F.when(F.col("_held") > 0, F.struct("_block", "_text"))  # a block of unbound members is no empty text
    return blocks.groupBy(*names).agg(F.array_join(F.array_sort(F.collect_list(some))["_text"], agg.sep).alias(name))


def _argument(a: Solutions, x) -> tuple[Column, T.DataType]:
    if isinstance(x, str):
        return F.col(var(x)), a.types[var(x)]
    c = term(x)
    return c, a.df.select(c.alias("c")).schema["c"].dataType


def _keep(work: dict[str, Column], c: Column) -> Column:
    name = f"_in{len(work)}"
    work[name] = c
    return F.col(name)


def _aggregate(a: Solutions, agg: Agg, strict: bool, work: dict[str, Column]) -> Column:
    if agg.kind == "count_star":
        # a multi-column count skips rows with a NULL, a struct of the columns does not
        return F.countDistinct(F.struct(*a.vars)) if agg.distinct else F.count(F.lit(1))
    c, kind = _argument(a, agg.arg)
    if agg.kind == "count":
        return F.countDistinct(c) if agg.distinct else F.count(c)
    if agg.kind == "sample":
        return F.any_value(c, True)
    is_term = isinstance(kind, T.StructType)
    known = c
    if agg.kind in ("min", "max"):
        fn = F.min if agg.kind == "min" else F.max
        if is_term:
            keys = [k.alias(f"k{i}") for i, k in enumerate(sort_keys(c, kind))]
            out = fn(_keep(work, F.when(c.isNotNull(), F.struct(*keys, c.alias("t")))))["t"]
        else:
            out = fn(c)
    elif is_term:
        known = _keep(work, num(c))
        out = _numeric_term(_keep(work, exact_num(c)), known, _keep(work, numeric_rank(c)), agg)
    else:
        out = _numeric_native(c, kind, agg)
    return F.when(F.count(F.lit(1)) == F.count(known), out) if strict else out


def _numeric_native(c: Column, kind: T.DataType, agg: Agg) -> Column:
    total = F.sum_distinct(c) if agg.distinct else F.sum(c)
    if agg.kind == "sum":
        return F.coalesce(total, F.lit(0).cast(kind))
    mean = total / F.nullif(F.countDistinct(c), F.lit(0)) if agg.distinct else F.avg(c)
    return F.coalesce(mean, F.lit(0).cast(kind if isinstance(kind, T.DecimalType) else "double"))


def _numeric_term(exact: Column, approx: Column, rank: Column, agg: Agg) -> Column:
    """SUM and AVG of terms: exact while all members are integers or decimals, else floating."""
    top = F.coalesce(F.max(F.when(approx.isNotNull(), rank)), F.lit(INTEGER_RANK))
    # a sum beyond the type is unbound, the sum of no numbers is 0
    exact_sum = F.when(F.count(exact) > 0, F.try_sum(exact).try_cast(DECIMAL)).otherwise(F.lit(0).cast(DECIMAL))
    float_sum = F.coalesce(F.try_sum(F.when(rank >= FLOAT_RANK, approx)), F.lit(0.0)) + exact_sum.cast("double")
    if agg.kind == "sum":
        value = F.when(top <= DECIMAL_RANK, decimal_text(exact_sum)).otherwise(double_text(float_sum))
        return literal_term(value, rank_dt(top))
    n = F.nullif(F.count(approx), F.lit(0))
    mean = F.try_divide(exact_sum, n.cast("decimal(19,0)")).try_cast(DECIMAL)  # 18 fractional digits
    value = F.when(top <= DECIMAL_RANK, decimal_text(mean)).otherwise(double_text(float_sum / n.cast("double")))
    empty = literal_term(F.lit("0"), "xsd:integer")
    return F.when(n.isNull(), empty).otherwise(literal_term(value, rank_dt(F.greatest(top, F.lit(DECIMAL_RANK)))))

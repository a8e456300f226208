"""Theta joins on ranges: rows of one side meet the rows of the other whose bounds their number lies within.

The numbers of the one side are divided into buckets of about equal counts.  A row of the other side goes to the buckets that its
range touches and to no others, so the join is an equi-join on the bucket with the range as a further condition; no pair of rows
beyond neighbouring buckets is ever made.

Aggregates of the pairs by variables of the ranges (how many numbers a range holds, and the least and greatest of them) need no pairs:
the numbers and the ends of the ranges are sorted once, bucket by bucket, and each end learns how many numbers lie before it and which
are next to it.
"""

from __future__ import annotations

import operator
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import instant, num
from ..session import stored
from .patterns import Solutions, _hint, _shared, var

BUCKETS = 1024  # at least; four per shuffle partition on larger clusters
TASKS = 64  # at least, that share the buckets
ABOVE, BELOW = {">": operator.gt, ">=": operator.ge}, {"<": operator.lt, "<=": operator.le}


def number(a: Solutions, x: str | Column) -> Column:
    """A variable or expression as a double: a number, or for a date the seconds since 1970.  The conversion keeps the order, so it
    may choose buckets; the exact comparison is the caller's condition.  Null for anything else."""
    c = F.col(var(x)) if isinstance(x, str) else x
    kind = a.df.select(c.alias("c")).schema["c"].dataType
    if isinstance(kind, T.StructType):
        return F.coalesce(num(c).cast("double"), F.unix_micros(instant(c)) / 1e6)
    return F.unix_micros(c.cast("timestamp")) / 1e6 if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else c.cast("double")


def _array(values: list[float]) -> str:
    """SQL of an array of doubles: one expression, where a column for each number would take as many calls."""
    return "array(" + ", ".join("double('Infinity')" if v == float("inf") else "double('-Infinity')" if v == float("-inf") else f"{v!r}D" for v in values) + ")"


def _bounds(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Up to buckets - 1 values that divide a column into parts of about equal counts; found by a distributed sketch."""
    shares = _array([i / buckets for i in range(1, buckets)])
    found = df.agg(F.expr(f"percentile_approx({column}, {shares}, {4 * buckets})")).first()[0] if buckets > 1 else None
    return sorted(set(found or []))


def _bucket(value: Column, bounds: list[float]) -> Column:
    """Number of bounds at or below a value, by binary search."""
    steps = max(1, len(bounds)).bit_length()
    table = F.expr(_array([*bounds, *[float("inf")] * ((1 << steps) - 1 - len(bounds))]))
    found = F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(steps))]), F.lit(0), lambda at, step: at + F.when(
        F.get(table, at + step - 1) <= value, step).otherwise(0))
    return F.least(found, F.lit(len(bounds)))  # infinity passes the filling of the table too


class RangePairs(Solutions):
    """The pairs of a range join.  They are planned when ``df`` is asked for; ``places`` tells of each range what it holds instead."""

    def __init__(self, a: Solutions, b: Solutions, x: str | Column, ends: dict[str, str | Column], on: Column | tuple[str, str] | None,
                 buckets: int):
        super().__init__(None, a.certain | b.certain, a.nodes | b.nodes)
        vars(self).pop("df")
        vars(self).update(a=a, b=b, x=x, ends=ends, on=on, buckets=buckets)

    def with_df(self, df: DataFrame, **changes) -> Solutions:
        return Solutions(df, **{"certain": self.certain, "nodes": self.nodes, **changes})

    @cached_property
    def types(self) -> dict[str, T.DataType]:
        return {**self.a.types, **self.b.types}

    @cached_property
    def _right(self) -> DataFrame:
        """Rows whose range may hold a number, with its ends as doubles; kept, as all ways read them more than once."""
        right = stored(self.b.df.withColumns({name: number(self.b, e) for name, e in self.ends.items()}), "range-right")
        right = right.where(reduce(lambda c, d: c & d, [_usable(name) for name in self.ends]))
        return right.where(F.col("_low") <= F.col("_high")) if len(self.ends) == 2 else right

    def _compared(self) -> list[Column]:
        """``on`` as conditions."""
        if not isinstance(self.on, tuple):
            return [] if self.on is None else [self.on]
        ends = [self.ends.get(name) for name in ("_low", "_high")]
        return [(ABOVE | BELOW)[op](_cell(self.x), _cell(e)) for op, e in zip(self.on, ends) if e is not None]

    @cached_property
    def df(self) -> DataFrame:
        spark, right = self.a.df.sparkSession, self._right
        # both sides are kept with their numbers: the bounds are taken from the one, and no condition on a number is turned into one on
        # all the expressions that it comes from
        left = stored(self.a.df.withColumn("_x", number(self.a, self.x)), "range-left").where(_usable("_x"))
        bounds = _bounds(left, "_x", self.buckets)
        left = left.withColumn("_bucket", _bucket(F.col("_x"), bounds))
        touched = {name: _bucket(F.col(name), bounds) for name in self.ends}
        right = right.withColumn("_bucket_r", F.explode(F.sequence(touched.get("_low", F.lit(0)), touched.get("_high", F.lit(len(bounds))))))
        cond = F.col("_bucket") == F.col("_bucket_r")
        if "_low" in self.ends:
            cond = cond & (F.col("_low") <= F.col("_x"))
        if "_high" in self.ends:
            cond = cond & (F.col("_x") <= F.col("_high"))
        cond = reduce(lambda c, d: c & d, self._compared(), cond)
        # few bytes make very many pairs: the buckets are dealt out by number, as coalescing by bytes would leave them to few tasks
        tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        left, right = left.repartition(tasks, "_bucket"), right.repartition(tasks, "_bucket_r")
        return left.join(_hint(self.b, right), cond, "inner").select(*self.a.vars, *self.b.vars)

    @property
    def sortable(self) -> bool:
        """Whether the order of native columns alone tells which pairs there are."""
        cells = [self.x, *self.ends.values()]
        if not isinstance(self.on, tuple) or len(cells) < 3 or any(isinstance(c, Column) for c in cells):
            return False
        kinds = {self.types[var(c)] for c in cells}
        return len(kinds) == 1 and isinstance(kinds.pop(), (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))

    def places(self) -> DataFrame:
        """The rows of ``b`` that have a partner, with ``_n`` partners, the least (``_first``) and the greatest (``_last``) of their numbers."""
        x, low, high = (var(c) for c in (self.x, self.ends["_low"], self.ends["_high"]))
        after = {"_low": self.on[0] == ">", "_high": self.on[1] == "<="}  # does the end lie behind the numbers that equal it?
        # equal numbers and equal ends are one row each; of one value, ends before it (0), the numbers (1), ends behind it (2)
        side = {name: 2 if behind else 0 for name, behind in after.items()}
        rows = self.a.df.select(F.col(x).alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_k")).withColumn("_side", F.lit(1))
        both = [self._right.select(F.col(c).alias("_v"), F.lit(0).cast("long").alias("_k"), F.lit(side[name]).alias("_side"))
                for name, c in (("_low", low), ("_high", high))]
        rows = rows.unionByName(reduce(DataFrame.unionByName, both).distinct())
        rows = stored(rows.withColumn("_d", number(Solutions(rows), "_v")), "range-places").where(_usable("_d"))
        rows = rows.withColumn("_bucket", _bucket(F.col("_d"), _bounds(rows, "_d", self.buckets)))
        value = F.when(F.col("_side") == 1, F.col("_v"))
        # a row a bucket: numbers in the buckets before, and the nearest numbers on either side
        sums = rows.groupBy("_bucket").agg(F.sum("_k").alias("_k"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        before, behind = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_bucket"), F.desc("_bucket")))
        sums = sums.select("_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.max("_hi").over(before).alias("_hi"),
                           F.min("_lo").over(behind).alias("_lo"))
        inside = Window.partitionBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        up, down = inside.orderBy("_v", "_side"), inside.orderBy(F.desc("_v"), F.desc("_side"))
        met = rows.withColumns({"_c": F.sum("_k").over(up), "_last": F.max(value).over(up), "_first": F.min(value).over(down)})
        met = met.where("_side <> 1").join(F.broadcast(sums), "_bucket").select(
            "_v", "_side", (F.col("_c") + F.col("_before")).alias("_c"), F.coalesce("_last", "_hi").alias("_last"), F.coalesce("_first", "_lo").alias("_first"))
        met = stored(met, "range-met")
        ends = {name: met.where(F.col("_side") == side[name]) for name in side}
        lows = ends["_low"].select(F.col("_v").alias("_l"), F.col("_c").alias("_cl"), "_first")
        highs = ends["_high"].select(F.col("_v").alias("_h"), F.col("_c").alias("_ch"), "_last")
        found = self._right.join(lows, F.col(low) == F.col("_l")).join(highs, F.col(high) == F.col("_h"))
        return found.withColumn("_n", F.col("_ch") - F.col("_cl")).where("_n > 0").select(*self.b.vars, "_n", "_first", "_last")


def _usable(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def _cell(c: str | Column) -> Column:
    return F.col(var(c)) if isinstance(c, str) else c


def range_join(a: Solutions, b: Solutions, x: str | Column, low: str | Column | None = None, high: str | Column | None = None,
               on: Column | tuple[str, str] | None = None, buckets: int | None = None) -> Solutions:
    """Pairs of rows without a shared variable where ``low <= x <= high`` and ``on`` holds.

    ``x`` is a number or date over ``a``, ``low`` and ``high`` are over ``b``; one of these may be left out, and then a row of ``b``
    goes to all buckets on one side of it, as its partners do.  Strict or exact comparisons are given as ``on`` besides: as a condition,
    or as the two operators by which ``x`` meets ``low`` and ``high`` as they are, like ``(">", "<=")``.  With operators on native
    columns of one type, grouping by variables of ``b`` takes the counts, least and greatest numbers from the sorted numbers and
    makes no pairs.  Rows whose numbers are unbound or NaN have no partner."""
    if _shared(a, b):
        raise ValueError("range_join needs two sides without shared variables; join these first and filter")
    if low is None and high is None:
        raise ValueError("range_join needs a bound; cross_join has none")
    if isinstance(on, tuple) and (on[0] not in ABOVE or on[1] not in BELOW):
        raise ValueError("x meets low by > or >= and high by < or <=")
    if isinstance(on, tuple) and any(isinstance({**a.types, **b.types}[var(c)], T.StructType) for c in (x, low, high) if isinstance(c, str)):
        raise ValueError("operators compare native columns; terms have no order of their own")
    wanted = buckets or max(BUCKETS, 4 * int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = {name: e for name, e in (("_low", low), ("_high", high)) if e is not None}
    return RangePairs(a, b, x, ends, on, wanted)

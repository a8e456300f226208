import operator
import random
from decimal import Decimal as D

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tripleweave.functions import scalars as X
from tripleweave.functions.terms import IRI, RDF_TYPE, TERM_DDL, Lit, Term
from tripleweave.operators import aggregates as agg
from tripleweave.operators import modifiers
from tripleweave.operators import patterns as pt
from tripleweave.operators.diff import assign_graph, diff_added, diff_changed, diff_removed, graph_stats, merge_tagged
from tripleweave.operators.forms import ask_form, construct_form, construct_triples, describe_form, select_form
from tripleweave.operators.graph import FunctionalGraph, TableGraph, TableMap
from tripleweave.operators.modifiers import desc, order_by, project, slice_
from tripleweave.operators.patterns import bgp, bind, filter_, join, minus, not_exists, optional, triple_pattern, union, values
from tripleweave.operators.paths import Inv, Seq
from tripleweave.operators.ranges import range_join
from tripleweave.plans import catalog, catalog_patterns
from tripleweave.plans.catalog_results import _lines_in_order
from tripleweave.plans.registry import QUERIES, Tables
from tripleweave.sources.ingest import open_by_subject, store_by_subject


assert catalog.LOADED


def triples(spark, *rows):
    cells = [(IRI(s).row, p, (o if isinstance(o, Term) else IRI(o)).row, g) for s, p, o, g in ((*r, "")[:4] for r in rows)]
    return spark.createDataFrame(cells, f"s {TERM_DDL}, p string, o {TERM_DDL}, g string")


@pytest.fixture(scope="module")
def people(spark):
    return triples(spark, ("a", RDF_TYPE, "P"), ("b", RDF_TYPE, "P"), ("a", "knows", "b"), ("b", "knows", "b"), ("a", "name", Lit("A")),
                   ("a", "age", Lit(5)), ("b", "age", Lit("5", "xsd:decimal")), ("a", "knows", "c", "g1"), ("c", "name", Lit("C", lang="en"), "g2"))


def test_triple_patterns(people, rows):
    show = lambda a, *n: rows(select_form(a, *n))
    assert show(triple_pattern(people, "?s", "knows", "?o"), "s", "o") == [("a", "b"), ("b", "b")]
    assert show(triple_pattern(people, "?x", "knows", "?x")) == [("b",)]
    assert show(triple_pattern(people, "a", "?p", "b")) == [("knows",)]
    assert show(triple_pattern(people, "?s", "age", 5)) == [("a",)]  # identity, not value
    assert show(triple_pattern(people, "?s", "knows", "?o", "?g"), "s", "o", "g") == [("a", "c", "g1")]
    assert show(triple_pattern(people, "?s", "?p", "?o", "g2"), "s", "p", "o") == [("c", "name", "C")]
    assert triple_pattern(people, "?s", "name", Lit("C")).df.isEmpty()


def test_bgp(people, rows):
    a = bgp(people, ("?x", "knows", "?y"), ("?y", RDF_TYPE, "P"), ("?x", "name", "?n"))
    assert rows(select_form(a, "x", "y", "n")) == [("a", "b", "A")]
    assert a.certain == {"x", "y", "n"} and a.nodes >= {"x", "y"}


def test_star_plan_agrees_with_joins(people, rows):
    patterns = [("?s", RDF_TYPE, "P"), ("?s", "age", "?a"), ("?s", "name", "?n")]
    plain = rows(select_form(bgp(people, *patterns), "s", "a", "n"))
    fast = bgp(FunctionalGraph(people, ["age", "name", RDF_TYPE]), *patterns)
    assert rows(select_form(fast, "s", "a", "n")) == plain == [("a", "5", "A")]
    assert "Join" not in fast.df._jdf.queryExecution().optimizedPlan().toString()


def test_compat_join(spark, rows):
    a = values(spark, ["k", "v"], [(1, None), (2, "x")])
    b = values(spark, ["k", "v"], [(1, "p"), (2, "y"), (2, None)])
    assert rows(select_form(optional(a, b))) == [("1", "p"), ("2", "x")]
    assert rows(select_form(join(a, b))) == [("1", "p"), ("2", "x")]


def brute(a, b, how, on=lambda row: True, k=2):
    """SPARQL joins on tuples of (shared..., own) by comparing all pairs."""
    def merge(x, y):
        if any(p is not None and q is not None and p != q for p, q in zip(x[:k], y[:k])):
            return None
        return tuple(p if p is not None else q for p, q in zip(x[:k], y[:k])) + (x[k], y[k])
    out = []
    for x in a:
        found = [m for y in b if (m := merge(x, y)) and on(m)]
        if how in ("inner", "left"):
            out += found or ([x[:k] + (x[k], None)] if how == "left" else [])
        elif how == "minus":
            if not any(merge(x, y) and any(p is not None and q is not None for p, q in zip(x[:k], y[:k])) for y in b):
                out.append(x)
        elif bool(found) == (how == "semi"):
            out.append(x)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,left_gaps,right_gaps", [(1, True, True), (2, True, False), (3, False, True), (4, True, True), (5, False, False)])
def test_compatible_mappings_against_brute_force(spark, seed, left_gaps, right_gaps):
    rnd = random.Random(seed)
    pick = lambda gaps: rnd.choice(["x", "y", "z", None] if gaps else ["x", "y", "z"])
    # one shared variable without gaps on the left in some seeds, none in others: both plans are exercised
    left = [(pick(left_gaps), pick(left_gaps and seed != 2), f"l{i}") for i in range(9)]
    right = [(pick(right_gaps), pick(right_gaps), f"r{i}") for i in range(8)]
    a, b = values(spark, ["u", "v", "l"], left), values(spark, ["u", "v", "r"], right)
    back = lambda s, *n: sorted((tuple(None if c is None else c["value"] for c in r) for r in s.df.select(*n).collect()), key=repr)
    assert back(join(a, b), "u", "v", "l", "r") == brute(left, right, "inner")
    assert back(optional(a, b), "u", "v", "l", "r") == brute(left, right, "left")
    assert back(minus(a, b), "u", "v", "l") == brute(left, right, "minus")
    assert back(pt.exists(a, b), "u", "v", "l") == brute(left, right, "semi")
    assert back(not_exists(a, b), "u", "v", "l") == brute(left, right, "anti")
    on = X.in_("?r", "r1", "r3", "r6")
    assert back(optional(a, b, on), "u", "v", "l", "r") == brute(left, right, "left", on=lambda m: m[3] in ("r1", "r3", "r6"))


@pytest.mark.parametrize("seed", [1, 2])
def test_many_unsure_variables(spark, seed):
    """Six shared variables that both sides may leave unbound; in one seed no variable is sure, in the other one always is."""
    rnd, names = random.Random(seed), [f"v{i}" for i in range(6)]
    pick = lambda i: "x" if seed == 2 and i == 0 else rnd.choice(["x", "x", "y", None, None])
    left = [tuple(map(pick, range(6))) + (f"l{i}",) for i in range(14)] * 2
    right = [tuple(map(pick, range(6))) + (f"r{i}",) for i in range(13)]
    right.append((None,) * 6 + ("none",) if seed != 2 else ("x",) + (None,) * 5 + ("none",))
    a, b = values(spark, [*names, "l"], left), values(spark, [*names, "r"], right)
    unbounded = lambda s: pt.Solutions(s.df, s.certain)  # without the bound of VALUES the product is dealt out
    back = lambda s, *n: sorted((tuple(None if c is None else c["value"] for c in r) for r in s.df.select(*n).collect()), key=repr)
    for x, y in ((a, b), (unbounded(a), unbounded(b)))[:3 - seed]:
        assert back(join(x, y), *names, "l", "r") == brute(left, right, "inner", k=6)
        assert back(optional(x, y), *names, "l", "r") == brute(left, right, "left", k=6)
        assert back(minus(x, y), *names, "l") == brute(left, right, "minus", k=6)
        assert back(pt.exists(x, y), *names, "l") == brute(left, right, "semi", k=6)
        assert back(not_exists(x, y), *names, "l") == brute(left, right, "anti", k=6)
        assert pt.exists_value(x, y, "hit").df.where("hit").count() == len(brute(left, right, "semi", k=6))


def six_unsure(spark):
    """One row of ``a`` and eight of ``b`` for each of 40 keys; every one of 64 signatures occurs on either side."""
    cell = lambda x, i: F.when(F.shiftright(x, i) % 2 == 1, F.struct(F.lit("lit").alias("kind"), F.lit("x").alias("value"), F.lit("").alias("dt"), F.lit("").alias("lang")))
    side = lambda n, k: pt.Solutions(spark.range(n).select(k(F.col("id")).alias("k"), *[cell(F.col("id"), i).alias(f"v{i}") for i in range(6)], F.col("id").alias(f"id{n}")),
                                     frozenset(["k", f"id{n}"]))
    return side(40 * 64, lambda x: x), side(40 * 64 * 8, lambda x: F.floor(x / 8))


def test_signatures_count_by_sure_values(spark):
    """Rows were repeated for each of the 64 signatures of the other side, whatever their key."""
    a, b = six_unsure(spark)
    by = pt._Compat(a, b, tuple(pt._shared(a, b)))
    assert by.keyed(b, b.df, "_key").count() == b.df.count()
    assert by.keyed(a, a.df, "_key").count() <= 8 * a.df.count()


def test_compat_join_by_sure_values(spark):
    a, b = six_unsure(spark)
    by = pt._Compat(a, b, tuple(pt._shared(a, b)))
    row = by.keyed(b, b.df, "_key").schema["_key"].dataType
    assert all(f.dataType.typeName() == "long" for f in row.fields)  # keys held a copy of every value
    assert join(a, b).df.count() == b.df.count() and minus(a, b).df.isEmpty()


def test_compat_join_shuffles_each_row_once(spark):
    """Every row was shuffled to learn the signatures it is to meet, and again once for each of them."""
    a, b = six_unsure(spark)
    plan = join(a, b).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "explode" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("pairs", [0, 2, 1024])
def test_compat_join_of_crowded_values(spark, monkeypatch, pairs):
    """One sure value on very many rows of both sides is joined by signatures, the others by comparison; nulls and copies of rows stay."""
    monkeypatch.setattr(pt, "PAIRS", pairs)
    rnd, names = random.Random(pairs), ["k", "v0", "v1", "v2"]
    row = lambda key: (key, *(rnd.choice(["x", "y", None]) for _ in range(3)))
    left = [row(k) + (f"l{i}",) for i, k in enumerate(["hot"] * 12 + ["a", "b", "c", "c", "d"])] * 2
    right = [row(k) + (f"r{i}",) for i, k in enumerate(["hot"] * 15 + ["a", "a", "b", "c", "e"])]
    a, b = values(spark, [*names, "l"], left), values(spark, [*names, "r"], right)
    a, b = (pt.Solutions(s.df, s.certain) for s in (a, b))  # without the bound of VALUES
    plan = join(a, b).df._jdf.queryExecution().executedPlan().toString()
    assert ("explode" in plan) == (pairs < 1024)
    got = sorted((tuple(None if c is None else c["value"] for c in r) for r in join(a, b).df.select(*names, "l", "r").collect()), key=repr)
    assert got == brute(left, right, "inner", k=4)


def test_join_is_one_equi_join(spark):
    a = values(spark, ["k", "v"], [(1, None), (2, "x")])
    b = values(spark, ["k", "v"], [(1, "p"), (2, None)])
    plan = join(a, b).df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("buckets", [None, 3])
def test_range_join(spark, buckets):
    rnd = random.Random(4)
    num = lambda: rnd.choice([rnd.uniform(-50, 50), rnd.randrange(-5, 5), 3])
    left = [(float(num()), i) for i in range(150)] + [(None, 998), (float("nan"), 999), (float("inf"), 997)]
    right = [(float(x := num()), float(x + rnd.choice([-1, 0, 0.5, 30])), i) for i in range(60)] + [(None, 1.0, 98), (0.0, None, 97), (float("-inf"), 2.0, 96)]
    a = pt.Solutions(spark.createDataFrame(left, "x double, l int"), frozenset(["l"]))
    b = pt.Solutions(spark.createDataFrame(right, "low double, high double, r int"), frozenset(["r"]))
    pairs = lambda s: sorted((r["l"], r["r"]) for r in s.df.collect())
    ok = lambda v: v is not None and v == v
    both = range_join(a, b, "?x", "?low", "?high", buckets=buckets)
    assert pairs(both) == sorted((i, j) for x, i in left for lo, hi, j in right if ok(x) and ok(lo) and ok(hi) and lo <= x <= hi)
    less = range_join(a, b, "?x", low="?low", on=F.col("x") > F.col("low"), buckets=buckets)
    assert pairs(less) == sorted((i, j) for x, i in left for lo, _, j in right if ok(x) and ok(lo) and lo < x)
    upper = range_join(a, b, "?x", high="?high", buckets=buckets)
    assert pairs(upper) == sorted((i, j) for x, i in left for _, hi, j in right if ok(x) and ok(hi) and x <= hi)
    plan = both.df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert range_join(pt.Solutions(a.df.where("false")), b, "?x", "?low").df.isEmpty()
    with pytest.raises(ValueError):
        range_join(a, b, "?x")


@pytest.fixture
def sides(monkeypatch):
    """The two sides of every range join of the checked queries."""
    seen = []
    monkeypatch.setattr(catalog_patterns, "range_join", lambda a, b, *args, **options: (seen.append((a, b)), range_join(a, b, *args, **options))[1])
    return seen


def test_range_join_reads_numbers_once_a_row(spark, tmp_path, sides):
    """Terms were read as numbers once for every pair."""
    spark.sql("SELECT id AS c_custkey, 'n' AS c_name, 10.0D * id AS c_acctbal, 's' AS c_mktsegment, 1L AS c_nationkey FROM range(3)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, 0L AS o_custkey, 'O' AS o_orderstatus, cast(id AS double) AS o_totalprice, timestamp_ntz'2000-01-01' AS o_orderdate, 'p' AS o_orderpriority FROM range(1000)").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["range_join"](spark, str(tmp_path)).collect())
    assert got == [("urn:customer/0", 500, 1.0, 500.0), ("urn:customer/1", 500, 201.0, 700.0), ("urn:customer/2", 500, 401.0, 900.0)]
    (a, b), = sides
    assert {a.types["amount"].typeName(), b.types["from"].typeName(), b.types["to"].typeName()} == {"decimal"}
    pairs = range_join(a, b, "?amount", "?from", "?to").df._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count("RepartitionByExpression") == 2  # coalescing by bytes left all pairs to few tasks


@pytest.mark.parametrize("on, buckets", [((">", "<="), None), ((">=", "<"), 3), ((">=", "<="), None), ((">", "<"), 3)])
def test_range_groups_make_no_pairs(spark, on, buckets):
    """Counts, least and greatest numbers of ranges come from the sorted numbers: ties, nulls, repeated and empty ranges, ends beyond all numbers."""
    rnd = random.Random(8)
    num = lambda: D(rnd.choice([rnd.randrange(-300, 300), rnd.randrange(-20, 20), 7])) / 10
    left = [(num(), i) for i in range(150)] + [(None, 998)]
    ranges = [(x := num(), x + rnd.choice([-1, 0, 0, 1, 30])) for _ in range(40)]
    right = [(*r, i % 30) for i, r in enumerate(ranges + ranges[:9])] + [(None, D(1), 90), (D(0), None, 91), (D(-99), D(99), 92), (D(50), D(99), 93), (D(3), D(4), None)]
    a = pt.Solutions(spark.createDataFrame(left, "x decimal(38,18), l int"), frozenset(["l"]))
    b = pt.Solutions(spark.createDataFrame(right, "low decimal(38,18), high decimal(38,18), r int"))
    ops = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
    held = {}
    for lo, hi, r in right:
        if lo is not None and hi is not None:
            held.setdefault(r, []).extend(x for x, _ in left if x is not None and ops[on[0]](x, lo) and ops[on[1]](x, hi))
    want = sorted(((r, len(xs), min(xs), max(xs)) for r, xs in held.items() if xs), key=repr)
    asked = dict(n=agg.count_star(), least=agg.min_("x"), most=agg.max_("?x"))
    made = lambda a, b, by=("r",), **aggs: (both := range_join(a, b, "?x", "?low", "?high", on=on, buckets=buckets), agg.group(both, by, **aggs or asked))
    both, got = made(a, b)
    assert sorted((tuple(r) for r in got.df.collect()), key=repr) == want and "df" not in vars(both)
    total = (sum(w[1] for w in want), min(w[2] for w in want), max(w[3] for w in want))
    assert tuple(made(a, b, ())[1].df.first()) == total
    assert both.df.count() == total[0]  # the pairs themselves, when they are asked for
    none = lambda s: pt.Solutions(s.df.where("false"), s.certain)
    for x, y in ((none(a), b), (a, none(b))):
        assert made(x, y)[1].df.isEmpty() and tuple(made(x, y, ())[1].df.first()) == (0, None, None)
    # what the order of the numbers does not tell is taken from the pairs
    spread = made(a, b, lines=agg.count_distinct("l"), n=agg.count_star())[1].df
    assert {(r["r"], r["n"]) for r in spread.collect()} == {w[:2] for w in want}
    assert sum(r["n"] for r in made(a, b, ("r", "l"))[1].df.collect()) == total[0]
    assert tuple(r["n"] for r in agg.group(filter_(both, F.col("x") == 7), [], n=agg.count_star()).df.collect()) == (
        both.df.where("x = 7").count(),)
    with pytest.raises(ValueError):
        range_join(a, b, "?x", "?low", "?high", on=("<", "<="))
    with pytest.raises(ValueError):
        range_join(values(spark, ["x"], [(1,)]), b, "?x", "?low", "?high", on=on)


def test_range_join_query_makes_no_pairs(spark, tmp_path):
    """Every order within a customer's band was made a row: the pairs grew with the square of the tables."""
    spark.sql("SELECT id AS c_custkey, 'n' AS c_name, 10.0D * (id % 2) AS c_acctbal, 's' AS c_mktsegment, 1L AS c_nationkey FROM range(4)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, 0L AS o_custkey, 'O' AS o_orderstatus, cast(id % 1000 AS double) AS o_totalprice, timestamp_ntz'2000-01-01' AS o_orderdate, 'p' AS o_orderpriority FROM range(3000)").write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["range_join"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket_r" not in plan and "explode" not in plan.lower()
    assert sorted(tuple(r) for r in df.collect()) == [(f"urn:customer/{i}", 1500, 1.0 + 200 * (i % 2), 500.0 + 200 * (i % 2)) for i in range(4)]


def test_range_join_dates_meets_groups(spark, tmp_path, sides):
    """Every line item met every order of its day."""
    day = "timestamp_ntz'2000-01-01' + make_dt_interval(cast(id % 2 AS int))"
    spark.sql(f"SELECT id AS o_orderkey, 0L AS o_custkey, 'O' AS o_orderstatus, 1.0D AS o_totalprice, {day} AS o_orderdate, concat('p', id % 3) AS o_orderpriority FROM range(60)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(f"SELECT id AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, 1.0D AS l_quantity, 1.0D AS l_extendedprice, 0.0D AS l_discount, 0.0D AS l_tax, 'R' AS l_returnflag, 'O' AS l_linestatus, {day} + make_dt_interval(0, 5) AS l_shipdate FROM range(100)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in QUERIES["range_join_dates"](spark, str(tmp_path)).collect())
    assert got == [(f"p{i}", "R", 1000) for i in range(3)]
    (a, b), = sides
    assert (a.df.count(), b.df.count()) == (2, 6)


def test_stored_star_has_no_exchange(spark, tmp_path, rows):
    t = triples(spark, *[(f"s{i}", p, Lit(f"{p}{i % 7}")) for i in range(40) for p in ("a", "b", "c") if (i + len(p)) % 5],
                *[(f"s{i}", "next", f"s{i + 1}") for i in range(40)], ("s3", "a", Lit("second")), ("s3", "a", Lit("other"), "g"))
    star = [("?s", "a", "?x"), ("?s", "b", "?y"), ("?s", "c", "?z")]
    kept = store_by_subject(t, str(tmp_path / "t"), 4)
    plan = lambda a: a.df._jdf.queryExecution().executedPlan().toString()
    a = bgp(kept, *star)
    assert "Exchange" not in plan(a) and rows(select_form(a)) == rows(select_form(bgp(t, *star)))
    chain = [*star, ("?s", "next", "?n"), ("?n", "a", "?w")]
    again = open_by_subject(spark, str(tmp_path / "t"), 4)
    for graph in (kept, again):
        assert rows(select_form(bgp(graph, *chain))) == rows(select_form(bgp(t, *chain)))
        assert rows(select_form(bgp(graph, ("s3", "a", "?x"), ("s3", "b", "?y")))) == rows(select_form(bgp(t, ("s3", "a", "?x"), ("s3", "b", "?y"))))
        assert rows(select_form(triple_pattern(graph, "?s", "a", "?x", "g"))) == [("s3", "other")]


def test_sort_carries_what_is_selected(spark, tmp_path):
    """Digests of subjects, keys of other types and constant fields of terms went through the sort, whoever asked for them."""
    spark.sql("SELECT id AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, 1.0D AS l_quantity, 1.0D AS l_extendedprice, 0.0D AS l_discount, 0.0D AS l_tax, 'R' AS l_returnflag, 'O' AS l_linestatus, timestamp_ntz'2000-01-01' AS l_shipdate FROM range(9)").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = _lines_in_order(Tables(spark, str(tmp_path))).df._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan
    keys = next(line for line in plan.splitlines() if "rangepartitioning" in line)
    assert keys.count("ASC NULLS FIRST") == 9  # instant and text, order, number as double, decimal and text, part, supplier, tie


def test_order_by_mixed_terms(spark):
    """Unbound variables, nodes, numbers and text in one column, ties, expressions of terms, native columns and a selection."""
    xs = ["10", "9", "x", "", None]
    a = values(spark, ["x", "y", "z"], [(x if i % 2 or x in ("x", "", None) else int(x), y, f"z{i}{j}") for i, x in enumerate(xs) for j, y in enumerate(["b", None, "a"])] * 2)
    back = lambda s: [tuple(None if c is None else (c["value"], c["dt"]) for c in r) for r in s.df.collect()]
    got = back(order_by(a, "x", desc("y"), X.str_("?z")))
    assert sorted(got, key=repr) == sorted(back(a), key=repr)
    assert [r[0] and r[0][0] for r in got[::6]] == [None, "", "9", "x", "10"]
    for block in (got[i:i + 6] for i in range(0, 30, 6)):
        assert len({r[0] for r in block}) == 1 and [r[1] and r[1][0] for r in block] == ["b", "b", "a", "a", None, None]
    some = order_by(a, "x", desc("y"), X.str_("?z"), keep=["y"])
    assert some.vars == ["y"] and [r[0] for r in back(some)] == [r[1] for r in got]
    native = a.with_df(a.df.withColumn("n", F.length(F.col("z.value")) + F.coalesce(F.length("y.value"), F.lit(0))))
    assert [r["n"] for r in order_by(native, "n", "z", keep=["n", "z"]).df.collect()] == [3] * 10 + [4] * 20


def test_slices(spark):
    rng = spark.range(0, 5000, 1, 7).selectExpr("cast(id * 7919 % 5000 AS int) AS x", "id % 3 AS y")
    ordered = order_by(pt.Solutions(rng, frozenset(["x", "y"])), "x")
    take = lambda **k: [r["x"] for r in slice_(ordered, **k).df.collect()]
    want = list(range(5000))
    modifiers_short = modifiers.SHORT
    try:
        modifiers.SHORT = 10
        for limit, offset in ((None, 0), (None, 4321), (20, 0), (5, 2), (100, 4950), (0, 50), (3000, 1234), (None, 6000), (9999, 0)):
            assert take(limit=limit, offset=offset) == want[offset:None if limit is None else offset + limit], (limit, offset)
        plan = slice_(ordered, offset=100).df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CollectLimit" not in plan
    finally:
        modifiers.SHORT = modifiers_short


def test_long_slices_are_top_rows(spark):
    """A slice of 30,000 rows sorted and kept all rows."""
    a = pt.Solutions(spark.range(0, 60000, 1, 7).selectExpr("cast(id * 7919 % 60000 AS int) AS x"), frozenset(["x"]))
    cut = slice_(order_by(a, "x"), limit=30_000, offset=450).df
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert [r["x"] for r in cut.collect()] == list(range(450, 30_450))


def test_group_concat_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(agg, "BLOCK_BITS", 3)
    rnd = random.Random(8)
    cells = [(rnd.choice("abc"), rnd.choice([None, "", "x", "é", *[f"m{i}" for i in range(60)]])) for _ in range(600)] + [("only", None), ("d", "")]
    a = values(spark, ["k", "v"], cells)
    got = {r["k"]["value"]: (r["all"], r["some"], r["n"]) for r in agg.group(
        a, ["k"], all=agg.group_concat("v", sep=", "), some=agg.group_concat("v", distinct=True), n=agg.count_star()).df.collect()}
    for k in {k for k, _ in cells}:
        mine = sorted(v for x, v in cells if x == k and v is not None)
        assert got[k] == (", ".join(mine), " ".join(sorted(set(mine))), sum(x == k for x, _ in cells))
    empty = agg.group(a.with_df(a.df.where("false")), all=agg.group_concat("v"), n=agg.count_star()).df.collect()
    assert [tuple(r) for r in empty] == [("", 0)]


def test_distinct_sums_are_by_term(spark):
    one = [(k, x) for k in "ab" for x in (Lit("1", "xsd:integer"), Lit("1.0", "xsd:decimal"), Lit("1", "xsd:integer"), Lit("01", "xsd:integer"))]
    a = values(spark, ["k", "v"], [*one, ("b", Lit(5)), ("c", None), ("d", Lit("text"))])
    df = agg.group(a, ["k"], s=agg.sum_("v", distinct=True), m=agg.avg("v", distinct=True), n=agg.count_distinct("v"), t=agg.sum_("v")).df
    got = {r["k"]["value"]: tuple(r[c] and (r[c] if c == "n" else float(r[c]["value"])) for c in "smnt") for r in df.collect()}
    assert got == {"a": (3.0, 1.0, 3, 4.0), "b": (8.0, 2.0, 4, 9.0), "c": (0.0, 0.0, 0, 0.0), "d": (0.0, 0.0, 1, 0.0)}
    whole = agg.group(a, s=agg.sum_("v", distinct=True), n=agg.count_star()).df.first()
    assert float(whole["s"]["value"]) == 8.0 and whole["n"] == 11
    strict = agg.group(a, ["k"], strict_errors=True, s=agg.sum_("v", distinct=True)).df.collect()
    assert {r["k"]["value"]: r["s"] is None for r in strict} == {"a": False, "b": False, "c": True, "d": True}


def test_hot_keys_keep_all_rows(spark, rows):
    """A third of the left rows share one key; two keys have no partner."""
    left = spark.range(3000).selectExpr("named_struct('kind','iri','value',if(id % 3 = 0, 'hub', concat('n', id % 50)),'dt','','lang','') k", "id")
    right = spark.range(48).selectExpr("named_struct('kind','iri','value',if(id = 47, 'hub', concat('n', id)),'dt','','lang','') k", "id r")
    a, b = pt.Solutions(left, frozenset(["k", "id"])), pt.Solutions(right, frozenset(["k", "r"]))
    assert rows(join(a, b, hot_keys=True).df.select("id", "r")) == rows(join(a, b).df.select("id", "r"))
    assert rows(optional(a, b, hot_keys=True).df.select("id", "r")) == rows(optional(a, b).df.select("id", "r"))


def test_products_have_no_limit(spark, rows):
    a, b = values(spark, ["x"], [(1,), (2,)]), values(spark, ["y"], [(3,), (4,)])
    assert len(rows(select_form(join(a, b)))) == 4
    big = pt.Solutions(spark.range(300).select("id"), frozenset(["id"]))
    other = pt.Solutions(spark.range(400).selectExpr("id AS z"), frozenset(["z"]))
    pairs = pt.cross_join(big, other).df
    assert pairs.count() == pairs.distinct().count() == 120_000
    assert pt.cross_join(a, big).df.count() == 600
    left = optional(big, other, F.col("id") == F.col("z") - 200).df
    assert left.count() == 300 and left.where("z is null").count() == 100


def test_exists_on_unsure_variables(spark, rows):
    a = values(spark, ["x", "y"], [(1, None), (2, 7), (3, 8), (None, None)])
    b = values(spark, ["y", "z"], [(7, 1), (None, 5)])
    ask = lambda q: rows(select_form(q, "x", "y"))
    on = X.gt("?z", "?x")
    assert ask(pt.exists(a, b, on)) == [("1", ""), ("2", "7"), ("3", "8")]
    assert ask(not_exists(a, b, on)) == [("", "")]
    only = values(spark, ["y", "z"], [(7, 9)])
    assert ask(pt.exists(a, only, on)) == [("1", ""), ("2", "7")]
    marked = rows(pt.exists_value(a, only, "hit").df.select(F.col("x.value"), "hit"))
    assert marked == sorted([("1", True), ("2", True), ("3", False), (None, True)], key=repr)


def test_minus_and_not_exists_differ(spark, rows):
    a = values(spark, ["x"], [(1,), (2,)])
    b = values(spark, ["y"], [(1,)])
    assert len(rows(minus(a, b).df)) == 2  # no shared variable: nothing is removed
    assert len(rows(not_exists(a, b).df)) == 0
    unbound = values(spark, ["x", "y"], [(None, 1)])
    assert len(rows(minus(a, unbound).df)) == 2  # shared, but never bound on both sides


def test_union_bind_values(spark, rows):
    a = values(spark, ["x"], [(1,)])
    b = values(spark, ["y"], [("s",), (None,)])
    u = union(a, b)
    assert rows(select_form(u, "x", "y")) == [("", ""), ("", "s"), ("1", "")] and u.certain == frozenset()
    with pytest.raises(ValueError):
        bind(a, "x", Lit(1))
    assert rows(select_form(bind(a, "z", X.divide("?x", 0)))) == [("1", "")]  # an error leaves it unbound
    native = pt.Solutions(spark.range(3).selectExpr("id as x"), frozenset("x"))
    assert rows(select_form(join(native, a))) == [("1",)]  # a native column meets a term as its literal


def test_dataset(people, rows):
    d = pt.dataset(people, from_=["g1", "g2"])
    assert rows(select_form(triple_pattern(d, "?s", "?p", "?o"), "s", "p")) == [("a", "knows"), ("c", "name")]
    named = pt.dataset(people, from_named=["g1"])
    assert triple_pattern(named, "?s", "?p", "?o").df.isEmpty()
    assert triple_pattern(named, "?s", "?p", "?o", "?g").df.count() == 1


def test_forms(spark, people, rows):
    knows = triple_pattern(people, "?s", "knows", "?o")
    assert ask_form(knows).first()[0] is True
    assert ask_form(triple_pattern(people, "?s", "nothing", "?o")).first()[0] is False
    mixed = values(spark, ["a", "b"], [(IRI("u"), 1), (Lit("text"), 2), (IRI("u"), None), (IRI("u"), 1)])
    assert rows(construct_form(mixed, [("?a", "p", "?b")])) == [("u", "p", "1")]
    fresh = construct_triples(values(spark, ["a"], [("x",), ("x",), ("y",)]), [("_:n", "p", "?a"), ("_:n", "q", "_:m")])
    assert fresh.count() == 6 and fresh.select("s").distinct().count() == 3
    quoted = values(spark, ["t"], [(Term("triple", "<<a b c>>"),), (Term("bnode", "x"),)])
    assert rows(select_form(quoted)) == [("<<a b c>>",), ("_:x",)]


def test_describe_follows_blank_nodes(spark, rows):
    b = lambda x: Term("bnode", x)
    t = triples(spark, ("a", "p", b("x")), ("c", "p", Lit("no")))
    extra = spark.createDataFrame([(b("x").row, "q", b("y").row, ""), (b("y").row, "r", b("x").row, ""), (b("z").row, "r", Lit("no").row, "")], t.schema)
    assert [r[1] for r in rows(describe_form(t.unionByName(extra), [IRI("a")]))] == ["q", "r", "p"]


def test_describe_reads_tables_of_its_nodes(spark, rows):
    """Every predicate of every table was scanned, whatever the resources were."""
    read = []
    table = lambda name, cells: lambda: (read.append(name), spark.sql(cells))[1]
    g = TableGraph([TableMap(table("a", "SELECT id, if(id = 1, NULL, 'x') AS t, id AS r FROM range(4)"), "a", "id", {"t": ("t", "xsd:string")}, {"r": ("r", "b")}),
                    TableMap(table("b", "SELECT id FROM range(2)"), "b", "id")])
    read.clear()
    found = rows(describe_form(g, [IRI("urn:a/1"), IRI("urn:a/2"), IRI("urn:c/1"), IRI("urn:a/9")]))
    assert found == sorted([("urn:a/1", RDF_TYPE, "urn:class/a"), ("urn:a/1", "r", "urn:b/1"), ("urn:a/2", RDF_TYPE, "urn:class/a"),
                            ("urn:a/2", "r", "urn:b/2"), ("urn:a/2", "t", "x")], key=repr)
    assert "b" not in read[1:]  # the first table opened tells the session
    assert rows(describe_form(g, [IRI("urn:c/1")])) == []


def test_fresh_nodes_need_no_shuffle_and_many_tasks(spark):
    """One task made all the nodes of a frequent solution, and a shuffle told them apart."""
    a = pt.Solutions(spark.sql("SELECT named_struct('kind', 'iri', 'value', 'x', 'dt', '', 'lang', '') AS v FROM range(100000)"), frozenset(["v"]), frozenset(["v"]))
    q = construct_triples(a, [("_:n", "p", "?v"), ("_:n", "p", IRI("x")), ("?v", "q", "_:n")])
    assert q.count() == q.distinct().count() == 200000  # the first two are one triple
    assert q.rdd.getNumPartitions() >= 64
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    mixed = construct_triples(a, [("_:n", "p", "?v"), ("?v", "q", IRI("x"))])
    assert mixed.count() == 100001


def test_fresh_terms_are_dealt_out(spark, tmp_path):
    """One scan task held three keys for every row of a small file."""
    spark.sql("SELECT id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size, 1.0D AS p_retailprice FROM range(50)").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["fn_fresh_terms"](spark, str(tmp_path))
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [(50, 50, 50, 50, True, True)]


@pytest.mark.parametrize("name", ["store_triples", "optional"])
def test_queries_bound_the_memory_of_a_task(spark, name):
    """Tasks took 64 MB of a shuffle, which can be more than a GB of terms."""
    held = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    for key in held:
        spark.conf.unset(key)
    with pytest.raises(AnalysisException):
        QUERIES[name](spark, "/none").count()
    assert [spark.conf.get(key, None) for key in held] == [str(16 << 20), "200"]


def test_versions(spark, rows):
    base = [("s1", RDF_TYPE, "S"), ("s1", "name", Lit("one")), ("s1", "kv", Lit("220", "xsd:integer"))]
    old = triples(spark, *base, ("s2", RDF_TYPE, "S"), ("s2", "name", Lit("two")), ("s3", RDF_TYPE, "S"), ("s3", "name", Lit("three")), ("s3", "kv", Lit(1)))
    new = triples(spark, *base[:2], ("s1", "kv", Lit("220.0", "xsd:decimal")), ("s4", RDF_TYPE, "S"), ("s4", "name", Lit("four")), ("s3", RDF_TYPE, "S"),
                  ("s3", "name", Lit("three")), ("s3", "kv", Lit(2)))
    q = assign_graph(old, "g:old").unionByName(assign_graph(new, "g:new"))
    assert rows(select_form(diff_removed(q, "g:old", "g:new", "S", "name"), "entity", "name")) == [("s2", "two")]
    assert rows(select_form(diff_added(q, "g:old", "g:new", "S", "name"), "entity", "name")) == [("s4", "four")]
    changed = diff_changed(q, "g:old", "g:new", "kv", "name")  # 220 and 220.0 are the same value
    assert rows(select_form(changed, "entity", "name", "old", "new")) == [("s3", "three", "1", "2")]
    plan = changed.df._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan.split("Relation", 1)[0]  # the triples were read into a table of versions
    assert rows(select_form(diff_changed(q, "g:old", "g:new", Seq(Inv("kv"), "kv")), "entity", "old", "new")) == []
    merged = merge_tagged(q, [("g:old", "before"), ("g:new", "after")], "S", "name")
    assert len(rows(merged.df)) == 6 and project(merged, "scenario").df.distinct().count() == 2
    assert rows(graph_stats(q)) == [("g:new", 8), ("g:old", 8)]


def test_distinct_rows_need_no_shuffle(spark, rows):
    source = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    maps = [TableMap(source, "row", None, {"urn:v": ("v", "xsd:string")}, distinct_rows=vouched) for vouched in (False, True)]
    safe, quick = [m.triples("urn:v") for m in maps]
    assert rows(safe) == rows(quick)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan(safe) and "Aggregate" not in plan(quick)
    assert "w#" not in plan(quick.select("o")).splitlines()[0]

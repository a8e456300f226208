import random

import pytest

from tripleweave.functions.terms import IRI, TERM_DDL, Lit
from tripleweave.operators import paths
from tripleweave.operators.components import strong_components
from tripleweave.operators.forms import select_form
from tripleweave.operators.paths import Alt, Inv, Neg, Opt, Plus, Seq, Star, path
from tripleweave.operators.patterns import values


def edges(spark, *pairs, p="e"):
    return spark.createDataFrame([(IRI(a).row, p, IRI(b).row, "") for a, b in pairs], f"s {TERM_DDL}, p string, o {TERM_DDL}, g string")


def reach(pairs, star=False):
    nodes = {x for e in pairs for x in e}
    out = {(n, n) for n in nodes} if star else set()
    for n in nodes:
        todo, seen = [n], set()
        while todo:
            for a, b in pairs:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        out |= {(n, m) for m in seen}
    return sorted(out)


CHAIN = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
LOOP = [("x", "x"), ("x", "y")]
DENSE = sorted({(f"d{random.Random(i).randrange(12)}", f"d{random.Random(i + 99).randrange(12)}") for i in range(25)})


@pytest.mark.parametrize("pairs", [CHAIN, CYCLE, LOOP, DENSE, CYCLE + LOOP + CHAIN[:5]])
def test_closures(spark, rows, pairs):
    g = edges(spark, *pairs)
    assert rows(select_form(path(g, "?x", Plus("e"), "?y"), "x", "y")) == reach(pairs)
    assert rows(select_form(path(g, "?x", Star("e"), "?y"), "x", "y")) == reach(pairs, star=True)


@pytest.mark.parametrize("pairs,node", [(CHAIN, "n03"), (CYCLE, "b"), (LOOP, "x"), (DENSE, DENSE[0][0])])
def test_bound_ends(spark, rows, pairs, node):
    g = edges(spark, *pairs)
    plus = reach(pairs)
    assert rows(select_form(path(g, IRI(node), Plus("e"), "?y"))) == [(b,) for a, b in plus if a == node]
    assert rows(select_form(path(g, "?x", Plus("e"), IRI(node)))) == [(a,) for a, b in plus if b == node]
    star = sorted({b for a, b in plus if a == node} | {node})
    assert rows(select_form(path(g, IRI(node), Star("e"), "?y"))) == [(b,) for b in star]


def test_zero_length(spark, rows):
    g = edges(spark, ("a", "b"))
    assert rows(select_form(path(g, IRI("gone"), Star("e"), "?y"))) == [("gone",)]
    assert path(g, IRI("gone"), Plus("e"), "?y").df.isEmpty()
    assert rows(select_form(path(g, "?x", Opt("e"), "?y"), "x", "y")) == [("a", "a"), ("a", "b"), ("b", "b")]
    assert path(g, IRI("a"), Star("e"), IRI("b")).df.count() == 1
    assert rows(select_form(path(g, "?x", Star("e"), "?x"))) == [("a",), ("b",)]


def test_sequences_and_alternatives_keep_duplicates(spark, rows):
    g = edges(spark, ("a", "b"), ("a", "c"), ("b", "z"), ("c", "z"))
    assert rows(select_form(path(g, "?x", Seq("e", "e"), "?y"), "x", "y")) == [("a", "z"), ("a", "z")]
    assert len(rows(select_form(path(g, "?x", Alt("e", "e"), "?y")))) == 8
    assert rows(select_form(path(g, "?x", Seq("e", Inv("e")), IRI("a")), "x")) == [("a",), ("a",)]
    assert rows(select_form(path(g, IRI("z"), Plus(Inv("e")), "?y"))) == [("a",), ("b",), ("c",)]


def test_negated(spark, rows):
    g = edges(spark, ("a", "b")).unionByName(edges(spark, ("a", "c"), p="f")).unionByName(edges(spark, ("d", "a"), p="h"))
    assert rows(select_form(path(g, IRI("a"), Neg("e"), "?y"))) == [("c",)]
    assert rows(select_form(path(g, IRI("a"), Neg("e", Inv("f")), "?y"))) == [("c",), ("d",)]
    assert rows(select_form(path(g, IRI("a"), Neg(Inv("f")), "?y"))) == [("d",)]


def test_literals_end_a_path(spark, rows):
    g = edges(spark, ("a", "b"))
    lit = spark.createDataFrame([(IRI("b").row, "e", Lit("a").row, "")], g.schema)
    assert rows(select_form(path(g.unionByName(lit), "?x", Plus("e"), "?y"), "x", "y")) == [("a", "a"), ("a", "b"), ("b", "a")]


def bag(pairs, expr):
    """The (s, o) pairs of a path by definition, with their multiplicities."""
    if isinstance(expr, str):
        return list(pairs)
    if isinstance(expr, Inv):
        return [(b, a) for a, b in bag(pairs, expr.of)]
    if isinstance(expr, Alt):
        return [x for e in expr.options for x in bag(pairs, e)]
    if isinstance(expr, Seq):
        out = bag(pairs, expr.steps[0])
        for e in expr.steps[1:]:
            out = [(a, d) for a, b in out for c, d in bag(pairs, e) if b == c]
        return out
    zero = {(n, n) for e in pairs for n in e}
    if isinstance(expr, Opt):
        return sorted(set(bag(pairs, expr.of)) | zero)
    found = set(reach(sorted(set(bag(pairs, expr.of)))))
    return sorted(found | zero if isinstance(expr, Star) else found)


@pytest.mark.parametrize("expr", [
    Star("e"), Seq("e", Star("e")), Seq(Inv("e"), Plus("e"), "e"), Inv(Seq("e", Plus(Inv("e")))),
    Alt(Inv(Star("e")), Seq("e", Opt(Plus("e")))), Plus(Seq("e", "e"))], ids=str)
def test_closures_start_from_what_is_bound(spark, rows, expr):
    pairs = CYCLE + LOOP + CHAIN[:4]
    g, want = edges(spark, *pairs), sorted(bag(pairs, expr))
    assert rows(select_form(path(g, "?x", expr, "?y"), "x", "y")) == want
    assert rows(select_form(path(g, "?x", expr, IRI("c")), "x")) == [(a,) for a, b in want if b == "c"]
    seeds = values(spark, ["x", "w"], [(IRI("a"), 1), (IRI("n01"), 2), (IRI("n01"), 3), (IRI("absent"), 4), (None, 5)])
    got = path(g, "?x", expr, "?y", seeds=seeds)
    assert rows(select_form(got, "x", "y")) == [x for x in want if x[0] in ("a", "n01")]


def test_seeds_bind_the_start(spark):
    with pytest.raises(ValueError, match="seeds"):
        path(edges(spark, *LOOP), "?x", Plus("e"), "?y", seeds=values(spark, ["z"], [(IRI("x"),)]))


def strong(pairs):
    """Components of two or more nodes, by the brute closure."""
    known = set(reach(pairs))
    nodes = {x for e in pairs for x in e}
    groups = {frozenset(y for y in nodes if y == x or ((x, y) in known and (y, x) in known)) for x in nodes}
    return sorted(sorted(g) for g in groups if len(g) > 1)


def graph_of(seed):
    """Rings, trees into them, chains between them, dense parts and loops, over few names."""
    rnd = random.Random(seed)
    names = [f"n{i:02}" for i in range(rnd.choice([8, 20, 30]))]
    kind = seed % 4
    if kind == 0:  # every node has one edge out
        pairs = [(x, rnd.choice(names)) for x in names]
    elif kind == 1:
        pairs = [(x, rnd.choice(names)) for x in names for _ in range(rnd.choice([0, 1, 1, 2]))]
    elif kind == 2:  # a long chain with shortcuts back
        pairs = list(zip(names, names[1:])) + [(names[j], names[i]) for i, j in (sorted(rnd.sample(range(len(names)), 2)) for _ in range(2))]
    else:
        pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(3 * len(names))]
    return sorted(set(pairs))


@pytest.mark.parametrize("seed", range(4))
def test_strong_components(spark, seed):
    pairs = graph_of(seed)
    found = {}
    components = strong_components(spark.createDataFrame(pairs, "a string, b string"))
    for r in components.collect() if components is not None else []:
        found.setdefault(r["component"], []).append(r["node"])
    assert sorted(sorted(g) for g in found.values()) == strong(pairs)
    assert all(c in g for c, g in found.items())


@pytest.mark.parametrize("seed", [1])
def test_closures_of_mixed_graphs(spark, rows, seed):
    pairs = graph_of(seed)
    assert rows(select_form(path(edges(spark, *pairs), "?x", Plus("e"), "?y"), "x", "y")) == reach(pairs)


def test_no_pair_inside_a_component_is_stored(spark, rows, monkeypatch):
    ring = [(f"r{i:03}", f"r{(i + 1) % 60:03}") for i in range(60)] + [("r000", "out")]
    stored_rows = []
    append, keep = paths._Table.append, paths.stored
    monkeypatch.setattr(paths._Table, "append", lambda self, df: stored_rows.append(append(self, df)) or stored_rows[-1])
    monkeypatch.setattr(paths, "stored", lambda df, label: [stored_rows.append((t := keep(df, label)).count()), t][1])
    assert path(edges(spark, *ring), "?x", Plus("e"), "?y").df.count() == 60 * 61
    assert max(stored_rows) <= 61


def test_both_ends_bound_read_a_neighbourhood(spark, monkeypatch):
    """From the start everything is reached, but only few nodes lead to the end."""
    wide = [("s", f"a{i}") for i in range(50)] + [(f"a{i}", f"b{i}_{j}") for i in range(50) for j in range(4)]
    wide += [("b7_1", "m"), ("m", "t"), ("x", "t")] + [(f"b{i}_0", f"c{i}") for i in range(50)] + [(f"c{i}", f"d{i}") for i in range(50)]
    g = edges(spark, *wide)
    read = []
    append = paths._Table.append
    monkeypatch.setattr(paths._Table, "append", lambda self, df: read.append(append(self, df)) or read[-1])
    ask = lambda a, b, kind=Plus: not path(g, IRI(a), kind("e"), IRI(b)).df.isEmpty()
    assert ask("s", "t") and sum(read) < 120
    read.clear()
    assert not ask("s", "x") and sum(read) < 60
    assert not ask("t", "s") and not ask("s", "s") and ask("s", "s", Star) and not ask("gone", "t") and ask("x", "t")
    ring = edges(spark, *CYCLE)
    assert not path(ring, IRI("a"), Plus("e"), IRI("a")).df.isEmpty() and not path(ring, IRI("a"), Star("e"), IRI("d")).df.isEmpty()
    assert path(ring, IRI("d"), Plus("e"), IRI("a")).df.isEmpty()

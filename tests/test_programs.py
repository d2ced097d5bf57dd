"""The imperative language, Datalog, fixpoints and SQL rewrites on literal rows."""

import math
import random
import statistics

import pytest

from tidewater.functions.convert import convert
from tidewater.operators import joins, windows
from tidewater.plans import datalog, recursion, sqlfront
from tidewater.plans.engine import Engine
from tidewater.plans.programs import Interpreter, LanguageError

#: A graph by rule, with cycles, and vertices 20 to 22 apart from the rest.
EDGES = sorted({(i, (3 * i + 2) % 19) for i in range(0, 19, 2)} | {(i, i + 4) for i in (1, 6, 13)} | {(20, 21), (21, 20), (21, 22)})
#: Boxes: number, dock, tons, carrier.
BOXES = [(n, "NSE"[n * n % 3], float(n * 37 % 23) / 2, ["sail", "rail", "road"][n % 4 % 3]) for n in range(11, 25)]


def walked(start):
    found, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for y in (b for a, b in EDGES if a == x):
            if y not in found:
                found.add(y)
                todo.append(y)
    return found


@pytest.fixture(scope="module")
def relations(spark):
    return {
        "boxes": spark.createDataFrame(BOXES, "box long, dock string, tons double, carrier string"),
        "edges": spark.createDataFrame(EDGES, "src long, dst long"),
    }


def rows(spark, relations, program, out="X"):
    return sorted(tuple(r) for r in Interpreter(spark, relations).run(program)[out].collect())


def by_dock():
    return {d: [b for b in BOXES if b[1] == d] for d in sorted({b[1] for b in BOXES})}


def test_comprehension(spark, relations):
    want = sorted(b[0] for b in BOXES if b[2] > 6)[:3]
    assert rows(spark, relations, "B = scan(boxes); X = [from B where tons > 6 emit box order by box limit 3];") == [(x,) for x in want]


def test_group_by_and_deviation(spark, relations):
    got = rows(spark, relations, "B = scan(boxes); X = [from B emit dock, count(*) as n, stdev(tons) as s];")
    want = [(d, len(bs), statistics.pstdev(b[2] for b in bs)) for d, bs in by_dock().items()]
    assert [r[:2] for r in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_recursion(spark, relations):
    got = rows(spark, relations, "E = scan(edges); S = [6 as id]; do R = [id] <- S + [from R, E where R.id = E.src emit E.dst as id]; until convergence;", "R")
    assert got == [(x,) for x in sorted(walked([6]))] and len(got) > 4


def test_stateful_and_uda(spark, relations):
    got = rows(spark, relations, "APPLY run(x) { [0.0 as t]; [t + x]; t; }; B = scan(boxes); X = [from B emit box, run(tons) as r];")
    assert got == [(b[0], sum(x[2] for x in BOXES[: i + 1])) for i, b in enumerate(BOXES)]
    got = rows(spark, relations, "UDA m(x) { [0 as n, 0.0 as t]; [n + 1, t + x]; t / n; }; B = scan(boxes); X = [from B emit dock, m(tons) as a];")
    assert [(d, round(a, 9)) for d, a in got] == [(d, round(statistics.fmean(b[2] for b in bs), 9)) for d, bs in by_dock().items()]


def test_unknown_names_are_errors(spark, relations):
    with pytest.raises(LanguageError):
        rows(spark, relations, "B = scan(boxes); X = [from B emit nothing];")
    with pytest.raises(LanguageError):
        rows(spark, relations, "B = scan(boxes); X = [from B, B emit box];")


def test_sums_of_nothing(spark, relations):
    assert rows(spark, relations, "B = scan(boxes); X = [from B where tons > 1000 emit sum(tons) as s, stdev(tons) as d];") == [(0.0, 0.0)]


def test_datalog(spark, relations):
    got = datalog.run(spark, "Path(x,y) :- E(x,y).\nPath(x,z) :- Path(x,y), E(y,z).\nK(y) :- E(6,y).\nS(x) :- E(x,x).", {"E": relations["edges"]})
    starts = {a for a, _ in EDGES}
    assert {tuple(r) for r in got["Path"].collect()} == {(a, y) for a in starts for b in (b for s, b in EDGES if s == a) for y in walked([b])}
    assert {r[0] for r in got["K"].collect()} == {b for a, b in EDGES if a == 6} and {r[0] for r in got["S"].collect()} == {a for a, b in EDGES if a == b}


def test_datalog_leaves_quoted_text(spark):
    names = spark.createDataFrame([("x", 1), ("y", 2)], "a string, b long")
    assert [tuple(r) for r in datalog.run(spark, "Q(x, n) :- N(x, n), x = 'x'.", {"N": names})["Q"].collect()] == [("x", 1)]


def test_limits_raise(spark, relations):
    text = "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 30) SELECT * FROM t"
    assert Engine(spark).query(text).count() == 30
    with pytest.raises(recursion.Unfinished):
        Engine(spark).query(text, max_iterations=5)
    with pytest.raises(recursion.Unfinished):
        datalog.run(spark, "P(x,y) :- E(x,y).\nP(x,z) :- P(x,y), E(y,z).", {"E": relations["edges"]}, max_iterations=1)
    step = lambda w: w.select((w.id + 1).alias("id"))
    with pytest.raises(recursion.Unfinished):
        recursion.union_fixpoint(spark.range(1), step, max_iterations=3)


def test_sql_rewrites():
    assert sqlfront.implicit_groups("SELECT a, f(b) AS c, SUM(d) x FROM t WHERE e ORDER BY a").split() == "SELECT a, f(b) AS c, SUM(d) x FROM t WHERE e GROUP BY a, f(b) ORDER BY a".split()
    assert sqlfront.implicit_groups("SELECT SUM(d) FROM t") == "SELECT SUM(d) FROM t"
    r = sqlfront.recursive("WITH RECURSIVE c (a) AS (SELECT f(1) UNION SELECT a + 1 FROM c WHERE (a < 3)) SELECT * FROM c")
    assert (r.name, r.columns, r.operator, r.final) == ("c", ["a"], "union", "SELECT * FROM c") and r.step.endswith("(a < 3)")


def test_unregistered_function(spark):
    with pytest.raises(ValueError, match="not registered"):
        Engine(spark).get_udf("f")


def test_fixpoints(spark, relations):
    assert {r.id for r in recursion.reachable(relations["edges"], spark.range(20, 21)).collect()} == {20, 21, 22}
    both = [(a, b) for x, y in EDGES for a, b in ((x, y), (y, x))]
    root = {v: v for e in EDGES for v in e}
    for _ in root:
        for a, b in both:
            root[a] = min(root[a], root[b])
    assert {r.id: r.root for r in recursion.connected(relations["edges"]).collect()} == root


@pytest.mark.parametrize("local_edges", [10**6, 0])
def test_shortest_paths(spark, relations, local_edges):
    costs = {e: 1 + (e[0] * 7 + e[1]) % 5 for e in EDGES}
    least = {0: 0.0}
    for _ in EDGES:
        for (a, b), w in costs.items():
            if a in least and least[a] + w < least.get(b, math.inf):
                least[b] = least[a] + w
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in costs.items()], "src long, dst long, cost long")
    assert {r.id: r.cost for r in recursion.shortest_paths(edges, spark.range(1), local_edges=local_edges).collect()} == least


def test_negative_cycles_are_errors(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, -3.0)], "src long, dst long, cost double")
    with pytest.raises(Exception, match="negative cost"):
        recursion.shortest_paths(edges, spark.range(1)).collect()


def test_kmeans_against_plain_steps(spark):
    r = random.Random(12)
    points = [(i, r.gauss(c, 0.3), r.gauss(-c, 0.3)) for i, c in enumerate([0, 4, 9] * 8)]
    got = {x.id: x["cluster"] for x in recursion.kmeans(spark.createDataFrame(points, "id long, x double, y double"), "id", ["x", "y"], 3).collect()}
    assert len(got) == 24
    of = {c: [p for p in points if got[p[0]] == c] for c in set(got.values())}
    centre = {c: [statistics.fmean(p[k] for p in ps) for k in (1, 2)] for c, ps in of.items()}
    for p in points:  # no point is nearer to another centre than to its own
        assert min(centre, key=lambda c: sum((a - b) ** 2 for a, b in zip(p[1:], centre[c]))) == got[p[0]]


def test_lambda(spark):
    df = spark.range(5).select(convert("lambda a: a * 2 + 1 if a > 2 else -a", ["id"]).alias("v"))
    assert [r.v for r in df.collect()] == [0, -1, -2, 7, 9]


def test_asof_and_nulls(spark):
    marks, times = [4, 9, 9, 15, 30], [3, 4, 10, 16, 17, 40, None]
    left = spark.createDataFrame([(t, f"l{i}") for i, t in enumerate(times)], "k long, l string")
    right = spark.createDataFrame([(m, 100 * m) for m in sorted(set(marks))], "k long, r long")
    before = lambda t, exact=True: max((m for m in marks if m < t or exact and m == t), default=None)
    times_100 = lambda m: None if m is None else 100 * m
    want = lambda f: {f"l{i}": None if t is None else times_100(f(t)) for i, t in enumerate(times)}
    assert {r.l: r.r for r in joins.merge_asof(left, right, "k").collect()} == want(before)
    assert {r.l: r.r for r in joins.merge_asof(left, right, "k", allow_exact=False).collect()} == want(lambda t: before(t, False))
    near = {r.l: r.r for r in joins.merge_asof(left, right, "k", direction="nearest").collect()}
    assert near == want(lambda t: min(marks, key=lambda m: (abs(m - t), m)))


def test_top_k_is_not_a_full_sort(spark):
    plan = windows.nlargest(spark.range(1000).toDF("k"), 3, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filter_reaches_the_scan(spark):
    df = Engine(spark, "/root/testdata/sf0.001").query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan

"""Registered queries and the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import aggregates, scalar, ufuncs
from tidewater.operators import arrays, frame, joins, relational, stats, windows
from tidewater.operators.bag import Bag
from tidewater.plans import recursion
from tidewater.plans.engine import Engine
from tidewater.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the engine's SQL; the oracle's text where it differs."""
    QUERIES[name] = lambda spark, d: Engine(spark, d).query(text)
    ORACLE_SQL[name] = oracle or text


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.load(spark, d, name)


# SQL -------------------------------------------------------------------------------------------------

FLAGSHIP = """
SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'HOUSEHOLD' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < DATE '1998-03-21' AND l_shipdate > DATE '1996-03-21'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
_sql("sql_q3", FLAGSHIP)
_sql(
    "sql_q1",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
  ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '117' DAY
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
_sql(
    "sql_q5",
    """SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'AMERICA' AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-01-01' + INTERVAL '1' YEAR
GROUP BY n_name ORDER BY revenue DESC""",
)
_Q6 = """SELECT l_discount, ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1995-01-01' + INTERVAL '1' YEAR AND l_discount >= 0.05 AND l_discount <= 0.075 AND l_quantity < 24"""
_sql("sql_q6_implicit_group", _Q6, _Q6 + " GROUP BY l_discount")
_sql(
    "sql_q10",
    """SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-01-01' + INTERVAL '3' MONTH
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
_sql("sql_merge", "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_totalprice FROM orders, lineitem WHERE o_orderkey = l_orderkey ORDER BY l_orderkey, l_linenumber LIMIT 10")
_sql("sql1a", "SELECT l_orderkey, l_linenumber, l_shipdate, c_custkey, o_orderdate FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey ORDER BY l_orderkey, l_shipdate, c_custkey, l_linenumber LIMIT 10")
_sql("sql3a", "SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
_Q5A = "SELECT l_extendedprice, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders, lineitem WHERE l_orderkey = o_orderkey AND o_orderdate >= DATE '1995-01-01'"
_sql("sql5a_implicit_group", _Q5A + " ORDER BY revenue DESC, l_extendedprice LIMIT 10", _Q5A + " GROUP BY l_extendedprice ORDER BY revenue DESC, l_extendedprice LIMIT 10")
_sql("sql_test", "SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders, lineitem WHERE l_orderkey = o_orderkey GROUP BY l_orderkey ORDER BY revenue, l_orderkey LIMIT 5")
_sql("sql_test_2", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount = 0.05")
_sql("sql_benchmark", "SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey, c_mktsegment")
_sql("sql_predicates", "SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 10 AND 40) AND p_brand <> 'Brand#11' AND (p_type LIKE '%A%' OR p_size > 45)")
_sql("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS qty FROM lineitem")
_sql("sql_nested", "SELECT o_custkey, n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > (SELECT AVG(m) FROM (SELECT COUNT(*) AS m FROM orders GROUP BY o_custkey) u)")
_sql("sql_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS class FROM orders")
_sql("sql_having", "SELECT c_nationkey, COUNT(*) AS n, ROUND(MAX(c_acctbal) - MIN(c_acctbal), 2) AS spread FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 5")
_sql("sql_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")

_PATHS = """WITH RECURSIVE cte_paths (src, target, distance, lvl) AS (
  SELECT src, target, distance, CAST(1 AS BIGINT) FROM distances WHERE src = 1
  UNION SELECT p.src, d.target, p.distance + d.distance, p.lvl + 1 FROM cte_paths p, distances d WHERE p.target = d.src AND d.target > d.src)
SELECT src, target, distance, lvl FROM cte_paths"""


@_query("sql_recursive_paths", _PATHS.replace("WITH RECURSIVE cte_paths", f"WITH RECURSIVE distances AS ({tables.DISTANCES_SQL}), cte_paths"))
def _paths(spark, d):
    e = Engine(spark, d)
    e.register_table("distances", tables.distances(_t(spark, d, "nation")))
    return e.query(_PATHS)


_TREE = """WITH RECURSIVE tree (custkey, nation, lvl) AS (
  SELECT c_custkey, c_nationkey, CAST(1 AS BIGINT) FROM customer WHERE c_custkey <= 3
  UNION SELECT c.c_custkey, c.c_nationkey, t.lvl + 1 FROM tree t, customer c WHERE c.c_custkey = 2 * t.custkey + 1)
SELECT lvl, COUNT(*) AS n, MAX(custkey) AS top FROM tree GROUP BY lvl"""
_sql("sql_recursive_tree", _TREE)


@_query("udf_quantile", "SELECT ROUND(quantile_cont(l_quantity, 0.25), 6) AS q FROM lineitem WHERE l_discount > 0.05")
def _udf_quantile(spark, d):
    e = Engine(spark, d)
    e.register_udf(lambda s: round(float(s.quantile(0.25)), 6), [1], "q double", "lower_quartile")
    return e.query("SELECT lower_quartile(l_quantity) FROM lineitem WHERE l_discount > 0.05")


@_query("udf_linear_fit", "SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope, ROUND(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def _udf_linear(spark, d):
    """As sums in one pass: what the Python function computes needs no single task."""
    b = arrays.lstsq(_t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.range(1).select(F.lit(round(float(b[1]), 4)).alias("slope"), F.lit(round(float(b[0]), 2)).alias("intercept"))


@_query("udf_two_frames", "SELECT CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders")
def _udf_two(spark, d):
    e = Engine(spark, d)
    e.register_udf(lambda a, b: (len(a), round(float(b.sum()), 2)), [2, 1], "n long, total double", "summary")
    return e.query("SELECT summary(o_orderkey, o_custkey, o_totalprice) FROM orders")


@_query("udf_kmeans")
def _udf_kmeans(spark, d):
    return recursion.kmeans(_t(spark, d, "customer"), "c_custkey", ["c_acctbal"], 4)


@_query("udf_knn")
def _udf_knn(spark, d):
    """Confusion counts of a 1-nearest-neighbour guess of the segment by account balance, by as-of join."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    train, test = c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 2 = 1")
    near = joins.merge_asof(test, train.select("c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("guess")), "c_acctbal", "c_nationkey", ["guess"], "nearest")
    return near.groupBy("c_mktsegment", "guess").agg(F.count(F.lit(1)).alias("n"))


@_query("udf_conjugate_gradient")
def _udf_cg(spark, d):
    def cg(s1, s2):
        import numpy as np

        a = np.array([[float((s1 * s1).sum()), float(s1.sum())], [float(s1.sum()), float(len(s1))]])
        b = np.array([float((s1 * s2).sum()), float(s2.sum())])
        x, r = np.zeros(2), b.copy()
        p = r.copy()
        for _ in range(10):
            if r @ r < 1e-12:
                break
            step = (r @ r) / (p @ a @ p)
            x, old = x + step * p, r @ r
            r = r - step * (a @ p)
            p = r + (r @ r) / old * p
        return tuple(map(float, x))

    e = Engine(spark, d)
    e.register_udf(cg, [1, 1], "slope double, intercept double", "conjugate_gradient")
    return e.query("SELECT conjugate_gradient(o_orderkey, o_totalprice) FROM orders")


# Relational algebra -----------------------------------------------------------------------------------


@_query("ra_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _union(spark, d):
    return relational.union(_t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select("s_nationkey"))


@_query("ra_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _union_all(spark, d):
    return relational.union_all(_t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select("s_nationkey"))


@_query("ra_intersection", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _intersection(spark, d):
    return relational.intersection(_t(spark, d, "orders").select(F.col("o_custkey").alias("k")), _t(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey"))


@_query("ra_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _difference(spark, d):
    return relational.difference(_t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select("o_custkey"))


@_query("ra_cross", "SELECT r_name, n_name FROM region, nation")
def _cross(spark, d):
    return relational.cross_product(_t(spark, d, "region").select("r_name"), _t(spark, d, "nation").select("n_name"))


@_query("ra_theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _theta(spark, d):
    a, b = (_t(spark, d, "nation").select(F.col("n_nationkey").alias(n), F.col("n_regionkey").alias(n + "r")) for n in "xy")
    return relational.join(a, b, (F.col("xr") == F.col("yr")) & (F.col("x") < F.col("y")), ["x", "y"])


@_query("ra_nary_join", "SELECT s_suppkey, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def _nary(spark, d):
    s, n, r = (_t(spark, d, x) for x in ("supplier", "nation", "region"))
    return relational.nary_join([s, n, r], [F.col("s_nationkey") == F.col("n_nationkey"), F.col("n_regionkey") == F.col("r_regionkey")], ["s_suppkey", "n_name", "r_name"])


@_query("ra_apply_project", "SELECT DISTINCT CAST(p_size * 2 AS BIGINT) AS twice, p_brand AS brand FROM part")
def _project(spark, d):
    return relational.project(relational.apply(_t(spark, d, "part"), twice=F.col("p_size").cast("long") * 2, brand="p_brand"), "twice", "brand")


@_query("ra_group_by", "SELECT l_suppkey, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(STDDEV_POP(l_quantity), 6) AS dev FROM lineitem GROUP BY l_suppkey")
def _group(spark, d):
    return relational.group_by(_t(spark, d, "lineitem"), ["l_suppkey"], n=F.count(F.lit(1)), qty=F.round(aggregates.total("l_quantity"), 2), dev=F.round(aggregates.stdev("l_quantity"), 6))


@_query("ra_stateful_apply", "SELECT event_id, COUNT(*) OVER w AS seen, ROUND(SUM(value) OVER w, 4) AS running, MAX(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _stateful(spark, d):
    out = relational.stateful_apply(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], {"seen": F.count(F.lit(1)), "running": F.sum("value"), "top": F.max("value")})
    return out.select("event_id", "seen", F.round("running", 4).alias("running"), "top")


@_query("ra_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _topk(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@_query("ra_hypercube_join", "SELECT COUNT(*) AS n FROM nation a, nation b, nation c WHERE (2 * a.n_nationkey + 1) % 25 = b.n_nationkey AND (2 * b.n_nationkey + 1) % 25 = c.n_nationkey")
def _hypercube(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), ((2 * F.col("n_nationkey") + 1) % 25).alias("m"))
    r = relational.hypercube_shuffle(n.toDF("a", "b"), {"a": 0, "b": 1}, [2, 2])
    s = relational.hypercube_shuffle(n.toDF("b", "c"), {"b": 1}, [2, 2])
    t = n.toDF("c", "e").select("c")
    return r.join(s, ["cell_", "b"]).join(t, "c").agg(F.count(F.lit(1)).alias("n"))


@_query("ra_empty_and_singleton", "SELECT CAST(1 AS INTEGER) AS one")
def _single(spark, d):
    return relational.singleton(spark).select(F.lit(1).alias("one")).union(relational.empty(spark, "one int"))


@_query("ra_decomposable_uda", "SELECT l_suppkey, ROUND(SUM(l_extendedprice * l_discount) / SUM(l_extendedprice), 8) AS weighted FROM lineitem GROUP BY l_suppkey")
def _decomposable(spark, d):
    out = aggregates.decomposable(_t(spark, d, "lineitem"), ["l_suppkey"], {"a": F.sum(F.col("l_extendedprice") * F.col("l_discount")), "b": F.sum("l_extendedprice")}, {"a": F.sum("a"), "b": F.sum("b")}, {"weighted": F.round(F.col("a") / F.col("b"), 8)})
    return out


@_query("ra_uda_fold", "SELECT user_id, CAST(MAX(value) - MIN(value) AS DOUBLE) AS spread FROM events GROUP BY user_id")
def _uda(spark, d):
    init = F.struct(F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"))
    return aggregates.fold(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], init, lambda s, r: F.struct(F.greatest(s.hi, r.value).alias("hi"), F.least(s.lo, r.value).alias("lo")), lambda s: s.hi - s.lo, "spread", ["value"])


@_query("ra_lexmin", "SELECT o_custkey, MIN(o_orderpriority) AS p, MIN(CASE WHEN o_orderpriority = m THEN o_orderkey END) AS k FROM (SELECT *, MIN(o_orderpriority) OVER (PARTITION BY o_custkey) AS m FROM orders) t GROUP BY o_custkey")
def _lexmin(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(aggregates.lexmin("o_orderpriority", "o_orderkey").alias("l")).select("o_custkey", F.col("l.o_orderpriority").alias("p"), F.col("l.o_orderkey").alias("k"))


_EDGES = f"edges AS ({tables.DISTANCES_SQL})"


@_query("ra_reachable", f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT e.target FROM r, edges e WHERE e.src = r.id) SELECT id FROM r")
def _reachable(spark, d):
    return recursion.reachable(tables.distances(_t(spark, d, "nation")), spark.range(1, 2), "src", "target")


@_query("ra_shortest_paths", f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS cost UNION SELECT e.target, r.cost + e.distance FROM r, edges e WHERE e.src = r.id AND r.cost < 40) SELECT id, CAST(MIN(cost) AS DOUBLE) AS cost FROM r GROUP BY id")
def _shortest(spark, d):
    return recursion.shortest_paths(tables.distances(_t(spark, d, "nation")), spark.range(1, 2), "src", "target", "distance")


@_query("ra_connected", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(0 AS BIGINT) AS root FROM nation")
def _connected(spark, d):
    return recursion.connected(tables.distances(_t(spark, d, "nation")), "src", "target")


@_query("ra_pagerank")
def _pagerank(spark, d):
    return recursion.pagerank(tables.distances(_t(spark, d, "nation")), _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")), src="src", dst="target")


@_query("ra_sigma_clipping")
def _sigma(spark, d):
    return recursion.sigma_clip(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 2.0)


@_query("ra_count_filter", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 10")
def _count_filter(spark, d):
    return recursion.count_filter(_t(spark, d, "orders"), ["o_custkey"], 10)


# Functions --------------------------------------------------------------------------------------------


@_query(
    "fn_arithmetic",
    "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS plus, l_partkey - l_suppkey AS minus, l_partkey * l_linenumber AS times, ROUND(l_partkey / (l_suppkey + 1), 8) AS divide, CAST(TRUNC(l_partkey / (l_suppkey + 1)) AS BIGINT) AS idivide, ((l_suppkey - l_partkey) % 7 + 7) % 7 AS mod, -l_partkey AS neg, CASE WHEN l_linenumber = 1 THEN -1.0 ELSE ROUND(l_partkey / (l_linenumber - 1), 8) END AS safe FROM lineitem",
)
def _arithmetic(spark, d):
    c = F.col
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") + c("l_suppkey")).alias("plus"), (c("l_partkey") - c("l_suppkey")).alias("minus"), (c("l_partkey") * c("l_linenumber")).alias("times"), F.round(scalar.divide("l_partkey", c("l_suppkey") + 1), 8).alias("divide"), scalar.idivide("l_partkey", c("l_suppkey") + 1).alias("idivide"), scalar.mod(c("l_suppkey") - c("l_partkey"), 7).alias("mod"), (-c("l_partkey")).alias("neg"), F.round(scalar.safe_div("l_partkey", c("l_linenumber") - 1, -1.0), 8).alias("safe"))


@_query(
    "fn_math",
    "SELECT o_orderkey, ABS(o_totalprice - 150000) AS fabs, CEIL(o_totalprice) AS fceil, FLOOR(o_totalprice) AS ffloor, ROUND(COS(o_totalprice), 6) AS fcos, ROUND(SIN(o_totalprice), 6) AS fsin, ROUND(LN(o_totalprice), 8) AS flog, ROUND(SQRT(o_totalprice), 8) AS fsqrt, ROUND(POW(o_totalprice, 0.5), 8) AS fpow, ROUND(TAN(o_totalprice / 1000000), 8) AS ftan, LEAST(o_totalprice, 100000.0) AS lesser, GREATEST(o_totalprice, 100000.0) AS greater FROM orders",
)
def _math(spark, d):
    p = F.col("o_totalprice")
    return _t(spark, d, "orders").select("o_orderkey", F.abs(p - 150000).alias("fabs"), scalar.ceil(p).alias("fceil"), scalar.floor(p).alias("ffloor"), F.round(F.cos(p), 6).alias("fcos"), F.round(F.sin(p), 6).alias("fsin"), F.round(F.ln(p), 8).alias("flog"), F.round(F.sqrt(p), 8).alias("fsqrt"), F.round(F.pow(p, F.lit(0.5)), 8).alias("fpow"), F.round(F.tan(p / 1000000), 8).alias("ftan"), scalar.least(p, 100000.0).alias("lesser"), scalar.greatest(p, 100000.0).alias("greater"))


@_query(
    "fn_strings",
    "SELECT p_partkey, p_name || '/' || p_brand AS joined, SUBSTRING(p_name, 2, 4) AS part_, LEFT(p_name, 3) AS head_, RIGHT(p_name, 3) AS tail_, CAST(LENGTH(p_name) AS INTEGER) AS len_, md5(p_name) AS md5_ FROM part",
)
def _strings(spark, d):
    n = F.col("p_name")
    return _t(spark, d, "part").select("p_partkey", F.concat(n, F.lit("/"), "p_brand").alias("joined"), scalar.substr(n, 1, 5).alias("part_"), scalar.head(n, 3).alias("head_"), scalar.tail(n, 3).alias("tail_"), F.length(n).alias("len_"), F.md5(n).alias("md5_"))


@_query("fn_md5_long")
def _md5(spark, d):
    return _t(spark, d, "part").select("p_partkey", scalar.md5_long("p_name").alias("h"))


@_query("fn_dates", "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m, CAST(DAY(o_orderdate) AS INTEGER) AS dd FROM orders")
def _dates(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("dd"))


@_query("fn_split", "SELECT p_partkey, UNNEST(string_split(p_type, ' ')) AS piece FROM part")
def _split(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.explode(scalar.split("p_type", " ")).alias("piece"))


@_query("fn_sequence", "SELECT s_suppkey, UNNEST(range(s_nationkey)) AS n FROM supplier")
def _sequence(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", F.explode(scalar.sequence("s_nationkey")).alias("n"))


@_query("fn_ngram", "SELECT n_nationkey, SUBSTRING(n_name, CAST(i AS BIGINT), 3) AS gram FROM nation, range(1, 100) t(i) WHERE i <= LENGTH(n_name) - 2")
def _ngram(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", F.explode(scalar.ngram("n_name", 3)).alias("gram"))


@_query("fn_bitset")
def _bitset(spark, d):
    return _t(spark, d, "region").select("r_regionkey", F.posexplode(scalar.bitset("r_name")).alias("pos", "bit"))


@_query(
    "fn_ufuncs",
    "SELECT l_orderkey, l_linenumber, ROUND(EXP(l_discount), 8) AS e, ROUND(LOG10(l_quantity), 8) AS l10, ROUND(LOG2(l_quantity), 8) AS l2, ROUND(CBRT(l_quantity), 8) AS cb, ROUND(ATAN2(l_tax, l_discount + 1), 8) AS at2, ROUND(DEGREES(l_tax), 8) AS deg, ROUND(SQRT(l_tax * l_tax + l_discount * l_discount), 8) AS hyp, ROUND(TANH(l_tax), 8) AS th, CAST(SIGN(l_quantity - 25) AS DOUBLE) AS sg FROM lineitem",
)
def _ufuncs(spark, d):
    u, c = ufuncs.apply, F.col
    r = lambda x, n: F.round(x, 8).alias(n)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(u("exp", "l_discount"), "e"), r(u("log10", "l_quantity"), "l10"), r(u("log2", "l_quantity"), "l2"), r(u("cbrt", "l_quantity"), "cb"), r(u("arctan2", "l_tax", c("l_discount") + 1), "at2"), r(u("degrees", "l_tax"), "deg"), r(u("hypot", "l_tax", "l_discount"), "hyp"), r(u("tanh", "l_tax"), "th"), u("sign", c("l_quantity") - 25).alias("sg"))


# Frames: joins ----------------------------------------------------------------------------------------

for _how, _kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

    @_query(f"df_merge_{_how}", f"SELECT c.c_custkey AS c_custkey, o_orderkey, o_custkey, c_mktsegment FROM (SELECT * FROM customer WHERE c_acctbal > 0) c {_kind} (SELECT * FROM orders WHERE o_totalprice > 100000) o ON c_custkey = o_custkey")
    def _merge(spark, d, how=_how):
        return joins.merge(_t(spark, d, "customer").filter("c_acctbal > 0"), _t(spark, d, "orders").filter("o_totalprice > 100000"), how, left_on="c_custkey", right_on="o_custkey").select("c_custkey", "o_orderkey", "o_custkey", "c_mktsegment")


@_query("df_merge_indicator", "SELECT COALESCE(c_nationkey, s_nationkey) AS k, CASE WHEN s_nationkey IS NULL THEN 'left_only' WHEN c_nationkey IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON c_nationkey = s_nationkey")
def _indicator(spark, d):
    a = _t(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    return joins.merge(a, _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct(), "outer", on="k", indicator="side")


@_query("df_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _semi(spark, d):
    o = _t(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi(_t(spark, d, "customer").select("c_custkey"), o, ["c_custkey"])


@_query("df_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _anti(spark, d):
    li = _t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.anti(_t(spark, d, "part").select("p_partkey"), li, ["p_partkey"])


def _views(spark, d, kind):
    return _t(spark, d, "events").filter(F.col("event_type") == kind)


_TYPES = "(SELECT event_type FROM events GROUP BY event_type ORDER BY event_type LIMIT 1)"


def _asof(spark, d, **options):
    e = _t(spark, d, "events")
    first = e.agg(F.min("event_type").alias("m"))
    left = e.join(F.broadcast(first), F.col("event_type") == F.col("m")).select("event_id", "user_id", "ts")  # one row
    right = e.join(F.broadcast(first), F.col("event_type") != F.col("m")).groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    return joins.merge_asof(left, right, "ts", "user_id", ["v"], **options)


_AL = f"(SELECT event_id, user_id, ts FROM events WHERE event_type = {_TYPES})"
_AR = f"(SELECT user_id, ts, MAX(value) AS v FROM events WHERE event_type <> {_TYPES} GROUP BY user_id, ts)"


@_query("df_asof_backward", f"SELECT l.event_id, l.user_id, l.ts, r.v FROM {_AL} l ASOF LEFT JOIN {_AR} r ON l.user_id = r.user_id AND l.ts >= r.ts")
def _asof_b(spark, d):
    return _asof(spark, d)


@_query("df_asof_strict", f"SELECT l.event_id, l.user_id, l.ts, r.v FROM {_AL} l ASOF LEFT JOIN {_AR} r ON l.user_id = r.user_id AND l.ts > r.ts")
def _asof_s(spark, d):
    return _asof(spark, d, allow_exact=False)


@_query("df_asof_forward", f"SELECT l.event_id, l.user_id, l.ts, r.v FROM {_AL} l ASOF LEFT JOIN {_AR} r ON l.user_id = r.user_id AND l.ts <= r.ts")
def _asof_f(spark, d):
    return _asof(spark, d, direction="forward")


@_query("df_asof_tolerance", f"SELECT l.event_id, l.user_id, l.ts, CASE WHEN l.ts - r.ts <= INTERVAL 1 HOUR THEN r.v END AS v FROM {_AL} l ASOF LEFT JOIN {_AR} r ON l.user_id = r.user_id AND l.ts >= r.ts")
def _asof_t(spark, d):
    return _asof(spark, d, tolerance=3600)


@_query("df_asof_ungrouped", "SELECT a.o_orderkey, a.o_totalprice, b.c_acctbal FROM orders a ASOF LEFT JOIN (SELECT DISTINCT c_acctbal FROM customer) b ON a.o_totalprice >= b.c_acctbal")
def _asof_u(spark, d):
    right = _t(spark, d, "customer").select(F.col("c_acctbal").alias("o_totalprice"), "c_acctbal").distinct()
    return joins.merge_asof(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), right, "o_totalprice")


@_query("df_interval_join", "SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_retailprice BETWEEN s_acctbal AND s_acctbal + 50")
def _interval(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 50).alias("hi"))
    return joins.interval_join(_t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", s, "lo", "hi", 50.0).select("p_partkey", "s_suppkey")


@_query("df_range_routed_join", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_orderdate < DATE '1996-01-01'")
def _routed(spark, d):
    o = _t(spark, d, "orders").filter("o_orderdate < DATE '1996-01-01'").select("o_orderkey", "o_totalprice")
    return joins.range_routed_join(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", o, "o_orderkey").select("l_orderkey", "l_linenumber", "o_totalprice")


@_query("df_concat", "SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _concat(spark, d):
    return joins.concat([_t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))])


@_query("df_combine_first", "SELECT COALESCE(s_suppkey, c_custkey) AS k, COALESCE(s_acctbal, c_acctbal) AS bal FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def _combine(spark, d):
    return joins.combine_first(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "k")


# Frames: rows -----------------------------------------------------------------------------------------


@_query("df_rowwise", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS w, CASE WHEN o_totalprice > 100000 THEN 0.0 ELSE o_totalprice END AS m, CAST(o_orderstatus IN ('F', 'O') AS BOOLEAN) AS i, o_totalprice BETWEEN 50000 AND 100000 AS b, LEAST(GREATEST(o_totalprice, 50000.0), 100000.0) AS c, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS r, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS mp FROM orders")
def _rowwise(spark, d):
    big = F.col("o_totalprice") > 100000
    return _t(spark, d, "orders").select("o_orderkey", frame.where("o_totalprice", big).alias("w"), frame.mask("o_totalprice", big, 0.0).alias("m"), frame.isin("o_orderstatus", ["F", "O"]).alias("i"), frame.between("o_totalprice", 50000, 100000).alias("b"), frame.clip("o_totalprice", 50000.0, 100000.0).alias("c"), frame.replace("o_orderstatus", {"F": "done", "O": "open"}).alias("r"), frame.map_values("o_orderstatus", {"F": 1, "O": 2}).alias("mp"))


@_query("df_dt", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(quarter(ts) AS INTEGER) AS q, CAST(weekofyear(ts) AS INTEGER) AS w, dayname(ts) AS dn, monthname(ts) AS mn, CAST(day(last_day(ts)) AS INTEGER) AS dim, date_trunc('hour', ts) AS fl FROM events")
def _dt(spark, d):
    f = frame.dt
    return _t(spark, d, "events").select("event_id", f("ts", "hour").alias("h"), f("ts", "minute").alias("mi"), f("ts", "dayofyear").alias("doy"), f("ts", "weekday").alias("dow"), f("ts", "quarter").alias("q"), f("ts", "week").alias("w"), f("ts", "day_name").alias("dn"), f("ts", "month_name").alias("mn"), f("ts", "days_in_month").alias("dim"), frame.dt_floor("ts", "hour").alias("fl"))


@_query("df_str", "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, CAST(length(p_name) AS INTEGER) AS le, starts_with(p_brand, 'Brand#1') AS sw, CAST(instr(p_type, 'A') - 1 AS INTEGER) AS fi, replace(p_name, 'a', 'X') AS rp, reverse(p_name) AS rv, repeat(p_brand, 2) AS rt, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS zf FROM part")
def _str(spark, d):
    t = frame.text
    p = _t(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    return p.select("p_partkey", t("p_name", "lower").alias("lo"), t("p_name", "upper").alias("up"), t("p_name", "len").alias("le"), t("p_brand", "startswith", "Brand#1").alias("sw"), t("p_type", "find", "A").alias("fi"), t("p_name", "replace", "a", "X").alias("rp"), t("p_name", "reverse").alias("rv"), t("p_brand", "repeat", 2).alias("rt"), t("k", "zfill", 8).alias("zf"))


@_query("df_melt", "SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem) UNPIVOT (value FOR variable IN (l_tax, l_discount))")
def _melt(spark, d):
    return frame.melt(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@_query("df_pivot", "SELECT o_custkey, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o FROM orders GROUP BY o_custkey".replace("SUM(CASE", "NULLIF(COUNT(CASE").replace("END) AS", "END), 0) AS"))
def _pivot(spark, d):
    out = frame.pivot_table(_t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", "count", ["F", "O"])
    return out.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"))


@_query("df_explode", "SELECT vec_id, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(x), 4) AS s FROM (SELECT vec_id, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id")
def _explode(spark, d):
    return frame.explode(_t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("s"))


@_query("df_dummies", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O FROM orders")
def _dummies(spark, d):
    return frame.get_dummies(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


@_query("df_categorical", "SELECT o_orderkey, CAST(DENSE_RANK() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def _categorical(spark, d):
    return frame.codes(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")


@_query("df_drop_duplicates", "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _dropdup(spark, d):
    return stats.drop_duplicates(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@_query("df_fill", "SELECT event_id, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f, FIRST_VALUE(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM (SELECT *, CASE WHEN value > 50 THEN value END AS v FROM events)")
def _fill(spark, d):
    e = _t(spark, d, "events").withColumn("v", F.when(F.col("value") > 50, F.col("value")))
    return e.select("event_id", frame.ffill("v", ["user_id"], ["ts", "event_id"]).alias("f"), frame.bfill("v", ["user_id"], ["ts", "event_id"]).alias("b"))


# Frames: reductions -----------------------------------------------------------------------------------


@_query("df_reductions", "SELECT ROUND(SUM(l_quantity), 2) AS s, MIN(l_quantity) AS mi, MAX(l_quantity) AS ma, COUNT(l_quantity) AS n, ROUND(AVG(l_quantity), 6) AS a, ROUND(VAR_SAMP(l_quantity), 6) AS v, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(STDDEV_SAMP(l_quantity) / SQRT(COUNT(l_quantity)), 8) AS sem, COUNT(DISTINCT l_suppkey) AS nu, bool_or(l_tax > 0.07) AS an, bool_and(l_tax >= 0) AS al FROM lineitem")
def _reductions(spark, d):
    n, q = stats.BY_NAME, "l_quantity"
    li = _t(spark, d, "lineitem").withColumns({"x": F.col("l_tax") > 0.07, "y": F.col("l_tax") >= 0})
    return li.agg(F.round(n["sum"](q), 2).alias("s"), n["min"](q).alias("mi"), n["max"](q).alias("ma"), n["count"](q).alias("n"), F.round(n["mean"](q), 6).alias("a"), F.round(n["var"](q), 6).alias("v"), F.round(n["std"](q), 6).alias("sd"), F.round(n["sem"](q), 8).alias("sem"), n["nunique"]("l_suppkey").alias("nu"), n["any"]("x").alias("an"), n["all"]("y").alias("al"))


@_query("df_groupby", "SELECT l_suppkey, ROUND(SUM(l_tax), 4) AS l_tax_sum, ROUND(AVG(l_quantity), 6) AS l_quantity_mean, MIN(l_quantity) AS l_quantity_min, MAX(l_quantity) AS l_quantity_max, COUNT(DISTINCT l_partkey) AS l_partkey_nunique, ROUND(VAR_SAMP(l_quantity), 6) AS l_quantity_var, MEDIAN(l_quantity) AS l_quantity_median FROM lineitem GROUP BY l_suppkey")
def _groupby(spark, d):
    out = stats.reduce(_t(spark, d, "lineitem"), {"l_tax": "sum", "l_quantity": ["mean", "min", "max", "var", "median"], "l_partkey": "nunique"}, ["l_suppkey"])
    return out.withColumns({"l_tax_sum": F.round("l_tax_sum", 4), "l_quantity_mean": F.round("l_quantity_mean", 6), "l_quantity_var": F.round("l_quantity_var", 6)})


@_query("df_groupby_first_last", "SELECT user_id, arg_min(value, event_id) AS f, arg_max(value, event_id) AS l FROM events GROUP BY user_id")
def _first_last(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(stats.first("value", "event_id").alias("f"), stats.last("value", "event_id").alias("l"))


@_query("df_idx", "SELECT o_custkey, MIN(CASE WHEN o_totalprice = mx THEN o_orderkey END) AS imax, MIN(CASE WHEN o_totalprice = mn THEN o_orderkey END) AS imin FROM (SELECT *, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS mx, MIN(o_totalprice) OVER (PARTITION BY o_custkey) AS mn FROM orders) GROUP BY o_custkey")
def _idx(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(stats.idxmax("o_totalprice", "o_orderkey").alias("imax"), stats.idxmin("o_totalprice", "o_orderkey").alias("imin"))


@_query("df_mode", "SELECT l_quantity, n FROM (SELECT l_quantity, COUNT(*) AS n, MAX(COUNT(*)) OVER () AS m FROM lineitem GROUP BY l_quantity) WHERE n = m")
def _mode(spark, d):
    return stats.mode(_t(spark, d, "lineitem"), "l_quantity")


@_query("df_quantiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY l_returnflag".replace("quantile_cont(l_extendedprice, 0.1)", "ROUND(quantile_cont(l_extendedprice, 0.1), 4)").replace("quantile_cont(l_extendedprice, 0.5)", "ROUND(quantile_cont(l_extendedprice, 0.5), 4)").replace("quantile_cont(l_extendedprice, 0.9)", "ROUND(quantile_cont(l_extendedprice, 0.9), 4)"))
def _quantiles(spark, d):
    q = lambda x: F.round(stats.quantile("l_extendedprice", x), 4)
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"))


@_query("df_describe", "SELECT 'l_quantity' AS column, COUNT(l_quantity) AS count, ROUND(AVG(l_quantity), 6) AS mean, ROUND(STDDEV_SAMP(l_quantity), 6) AS std, MIN(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, MAX(l_quantity) AS max FROM lineitem")
def _describe(spark, d):
    return stats.describe(_t(spark, d, "lineitem"), ["l_quantity"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@_query("df_corr", "SELECT ROUND(CORR(l_quantity, l_extendedprice), 8) AS c, ROUND(COVAR_SAMP(l_quantity, l_extendedprice), 4) AS v FROM lineitem")
def _corr(spark, d):
    m = stats.pairs(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).filter("x = 'l_quantity' and y = 'l_extendedprice'").select(F.round("value", 8).alias("c"))
    v = stats.pairs(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "cov").filter("x = 'l_quantity' and y = 'l_extendedprice'").select(F.round("value", 4).alias("v"))
    return m.crossJoin(v)  # one row each


@_query("df_value_counts", "SELECT event_type, user_id, COUNT(*) AS count FROM events GROUP BY event_type, user_id")
def _vc(spark, d):
    return stats.value_counts(_t(spark, d, "events"), "user_id", ["event_type"])


@_query("df_group_transform", "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice AS below FROM orders")
def _transform(spark, d):
    return stats.group_transform(_t(spark, d, "orders"), ["o_custkey"], "o_totalprice", "max", "m").select("o_orderkey", (F.col("m") - F.col("o_totalprice")).alias("below"))


@_query("df_group_apply", "SELECT c_nationkey, ROUND(MAX(c_acctbal) - MIN(c_acctbal), 4) AS spread FROM customer GROUP BY c_nationkey")
def _group_apply(spark, d):
    def spread(p):
        import pandas as pd

        return pd.DataFrame({"c_nationkey": [p.c_nationkey.iloc[0]], "spread": [round(float(p.c_acctbal.max() - p.c_acctbal.min()), 4)]})

    return stats.group_apply(_t(spark, d, "customer").select("c_nationkey", "c_acctbal"), ["c_nationkey"], spread, "c_nationkey int, spread double")


@_query("df_nunique_approx")
def _approx(spark, d):
    return _t(spark, d, "lineitem").agg(stats.nunique_approx("l_partkey").alias("approx"), F.count_distinct("l_partkey").alias("exact"))


@_query("df_tests", "SELECT ROUND((a1 - a2) / SQRT(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t FROM (SELECT AVG(l_quantity) FILTER (l_returnflag = 'R') AS a1, AVG(l_quantity) FILTER (l_returnflag <> 'R') AS a2, VAR_SAMP(l_quantity) FILTER (l_returnflag = 'R') AS v1, VAR_SAMP(l_quantity) FILTER (l_returnflag <> 'R') AS v2, CAST(COUNT(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS n1, CAST(COUNT(*) FILTER (l_returnflag <> 'R') AS DOUBLE) AS n2 FROM lineitem)")
def _tests(spark, d):
    r = F.col("l_returnflag") == "R"
    return _t(spark, d, "lineitem").agg(F.round(stats.ttest_ind(F.when(r, F.col("l_quantity")), F.when(~r, F.col("l_quantity"))), 6).alias("t"))


@_query("df_f_oneway", "SELECT ROUND(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) AS f FROM (SELECT COUNT(*) AS k, SUM(n) AS n, SUM(s) AS s, SUM(q) AS q, SUM(s * s / n) AS b FROM (SELECT COUNT(*) AS n, SUM(l_quantity) AS s, SUM(l_quantity * l_quantity) AS q FROM lineitem GROUP BY l_returnflag))")
def _anova(spark, d):
    return stats.f_oneway(_t(spark, d, "lineitem"), "l_returnflag", "l_quantity").select(F.round("f", 6).alias("f"))


# Frames: windows --------------------------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY ts, event_id"


@_query("df_cumulative", f"SELECT event_id, ROUND(SUM(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS cs, MAX(value) OVER (w ROWS UNBOUNDED PRECEDING) AS cx, MIN(value) OVER (w ROWS UNBOUNDED PRECEDING) AS cn, ROW_NUMBER() OVER w - 1 AS cc, LAG(value, 2) OVER w AS sh, ROUND(value - LAG(value) OVER w, 6) AS df FROM events WINDOW w AS ({_W})".replace("(w ROWS UNBOUNDED PRECEDING)", f"({_W} ROWS UNBOUNDED PRECEDING)"))
def _cumulative(spark, d):
    p, o = ["user_id"], ["ts", "event_id"]
    c = lambda how: stats.cumulative("value", how, p, o)
    return _t(spark, d, "events").select("event_id", F.round(c("sum"), 4).alias("cs"), c("max").alias("cx"), c("min").alias("cn"), c("count").cast("long").alias("cc"), windows.shift("value", p, o, 2).alias("sh"), F.round(windows.diff("value", p, o), 6).alias("df"))


@_query("df_rolling", f"SELECT event_id, CASE WHEN COUNT(value) OVER r >= 5 THEN ROUND(SUM(value) OVER r, 4) END AS s, CASE WHEN COUNT(value) OVER r >= 5 THEN ROUND(AVG(value) OVER r, 4) END AS m, CASE WHEN COUNT(value) OVER r >= 5 THEN MIN(value) OVER r END AS mi, CASE WHEN COUNT(value) OVER r >= 5 THEN MAX(value) OVER r END AS ma, CASE WHEN COUNT(value) OVER r >= 5 THEN ROUND(STDDEV_SAMP(value) OVER r, 4) END AS sd, CASE WHEN COUNT(value) OVER r >= 5 THEN ROUND(MEDIAN(value) OVER r, 4) END AS med FROM events WINDOW r AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _rolling(spark, d):
    r = windows.Rolling(["user_id"], ["ts", "event_id"], rows=5)
    return _t(spark, d, "events").select("event_id", F.round(r.sum("value"), 4).alias("s"), F.round(r.mean("value"), 4).alias("m"), r.min("value").alias("mi"), r.max("value").alias("ma"), F.round(r.std("value"), 4).alias("sd"), F.round(r.median("value"), 4).alias("med"))


@_query("df_rolling_time", "SELECT event_id, COUNT(value) OVER r AS n, ROUND(SUM(value) OVER r, 4) AS s FROM events WINDOW r AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def _rolling_time(spark, d):
    r = windows.Rolling(["user_id"], ["ts"], seconds=86400)
    return _t(spark, d, "events").select("event_id", r.count("value").alias("n"), F.round(r.sum("value"), 4).alias("s"))


@_query("df_resample", "WITH b AS (SELECT date_trunc('hour', ts) AS ts, COUNT(*) AS n, ROUND(SUM(value), 4) AS s, arg_min(value, event_id) AS o, MAX(value) AS h FROM events GROUP BY 1) SELECT g.ts, n, s, o, h FROM (SELECT UNNEST(generate_series((SELECT MIN(ts) FROM b), (SELECT MAX(ts) FROM b), INTERVAL 1 HOUR)) AS ts) g LEFT JOIN b ON g.ts = b.ts")
def _resample(spark, d):
    return windows.resample(_t(spark, d, "events"), "ts", "1 hour", {"n": F.count(F.lit(1)), "s": F.round(F.sum("value"), 4), "o": stats.first("value", "event_id"), "h": F.max("value")})


@_query("df_first_last_span", "SELECT event_id FROM events WHERE ts < (SELECT MIN(ts) FROM events) + INTERVAL 1 DAY UNION ALL SELECT event_id FROM events WHERE ts > (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY")
def _spans(spark, d):
    e = _t(spark, d, "events").select("event_id", "ts")
    return windows.first_span(e, "ts", "1 day").select("event_id").union(windows.last_span(e, "ts", "1 day").select("event_id"))


@_query("df_nlargest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def _nlargest(spark, d):
    return windows.nlargest(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), 15, ["c_acctbal"], ["c_custkey"])


# Bags and arrays --------------------------------------------------------------------------------------


@_query("bag_pluck_frequencies", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS value, COUNT(*) AS count FROM events GROUP BY 1")
def _pluck(spark, d):
    e = _t(spark, d, "events").select(F.from_json("props", "k long").alias("p"))
    return Bag(e).pluck("k").frequencies()


@_query("bag_words", "SELECT w AS key, COUNT(*) AS value FROM (SELECT UNNEST(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def _words(spark, d):
    return Bag(_t(spark, d, "documents"), "text").map(lambda v: F.split(v, r"\s+")).flatten().filter(lambda v: v != "").foldby(lambda v: v, lambda v: F.count(v))


@_query("bag_reductions", "SELECT ROUND(SUM(value), 4) AS s, ROUND(AVG(value), 6) AS m, ROUND(VAR_POP(value), 6) AS v, ROUND(STDDEV_POP(value), 6) AS sd FROM events")
def _bag_reductions(spark, d):
    b = Bag(_t(spark, d, "events"), "value")
    s, m, v, sd = b.sum(), b.mean(), b.var(), b.std()
    parts = [x.select(F.round("value", n).alias(a)) for x, a, n in ((s, "s", 4), (m, "m", 6), (v, "v", 6), (sd, "sd", 6))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])  # one row each


@_query("bag_topk_distinct", "SELECT value FROM (SELECT DISTINCT l_quantity AS value FROM lineitem) ORDER BY value DESC LIMIT 10")
def _bag_topk(spark, d):
    return Bag(_t(spark, d, "lineitem"), "l_quantity").distinct().topk(10)


_LONG = "(SELECT vec_id AS i, UNNEST(range(len(embedding))) AS j, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings)"


@_query("arr_axis_reductions", f"SELECT j, ROUND(SUM(v), 4) AS sum, ROUND(AVG(v), 6) AS mean, ROUND(VAR_POP(v), 6) AS var, MIN(v) AS min, MAX(v) AS max FROM {_LONG} GROUP BY j")
def _axis(spark, d):
    a = arrays.from_vectors(_t(spark, d, "embeddings"), "vec_id", "embedding")
    out = arrays.reduce(a, ["sum", "mean", "var", "min", "max"], "i")
    return out.withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 6), "var": F.round("var", 6)})


@_query("arr_gram", f"SELECT a.j AS i, b.j AS j, ROUND(SUM(a.v * b.v), 4) AS v FROM {_LONG} a, {_LONG} b WHERE a.i = b.i GROUP BY a.j, b.j")
def _gram(spark, d):
    return arrays.gram(_t(spark, d, "embeddings"), "embedding", 64).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("v", 4).alias("v"))


@_query("arr_histogram", "SELECT CAST(b AS INTEGER) AS bin, COUNT(o_totalprice) AS n FROM (SELECT unnest(range(0, 20)) AS b) LEFT JOIN orders ON o_totalprice BETWEEN 0 AND 600000 AND LEAST(FLOOR((o_totalprice - 0) * 20 / 600000), 19) = b GROUP BY b")
def _histogram(spark, d):
    return arrays.histogram(_t(spark, d, "orders").select(F.col("o_totalprice").alias("v")), 20, 0.0, 600000.0)


@_query("arr_argmax", f"SELECT i, MIN(j) AS argmax FROM (SELECT *, MAX(v) OVER (PARTITION BY i) AS m FROM {_LONG}) WHERE v = m GROUP BY i")
def _argmax(spark, d):
    return arrays.arg(arrays.from_vectors(_t(spark, d, "embeddings"), "vec_id", "embedding"), "max", "j")


@_query("arr_cumsum_diff", f"SELECT i, j, ROUND(SUM(v) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING), 6) AS v FROM {_LONG}")
def _cumsum(spark, d):
    return arrays.cumulate(arrays.from_vectors(_t(spark, d, "embeddings"), "vec_id", "embedding"), "sum", "j").withColumn("v", F.round("v", 6))


@_query("arr_matmul", "SELECT a.n_regionkey AS i, CAST(b.s_nationkey % 5 AS BIGINT) AS j, ROUND(SUM(b.s_acctbal), 2) AS v FROM nation a, supplier b WHERE a.n_nationkey = b.s_nationkey GROUP BY 1, 2".replace("a.n_regionkey AS i", "CAST(a.n_regionkey AS BIGINT) AS i"))
def _matmul(spark, d):
    a = _t(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("i"), F.col("n_nationkey").cast("long").alias("j"), F.lit(1.0).alias("v"))
    b = _t(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("i"), (F.col("s_nationkey") % 5).cast("long").alias("j"), F.col("s_acctbal").alias("v"))
    return arrays.matmul(a, b).withColumn("v", F.round("v", 2))


@_query("arr_unique", "SELECT l_discount AS v, COUNT(*) AS n FROM lineitem GROUP BY l_discount")
def _unique(spark, d):
    return arrays.unique(_t(spark, d, "lineitem").select(F.col("l_discount").alias("v")))


# Sources and sinks ------------------------------------------------------------------------------------


def _roundtrip(kind: str):
    def run(spark, d):
        import uuid

        from tidewater.sources import io

        src = _t(spark, d, "customer")
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            recursion.settle(spark.range(1))
            base = spark.sparkContext.getCheckpointDir()
        path = f"{base}/io-{kind}-{uuid.uuid4().hex}"
        schema = ", ".join(f"{n} {t}" for n, t in src.dtypes)
        if kind == "csv":
            io.to_csv(src, path, sep="|")
            return io.read_csv(spark, path, schema, sep="|")
        if kind == "json":
            io.to_json(src, path)
            return io.read_json(spark, path, schema)
        if kind == "orc":
            io.to_orc(src, path)
            return io.read_orc(spark, path)
        io.to_parquet(src, path, ["c_mktsegment"])
        return io.read_parquet(spark, path, src.columns, [("c_custkey", ">=", 0)])

    return run


for _kind in ("csv", "json", "orc", "parquet"):
    QUERIES[f"io_{_kind}"] = _roundtrip(_kind)
    ORACLE_SQL[f"io_{_kind}"] = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).query(FLAGSHIP)



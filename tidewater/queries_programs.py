"""Registered queries in the imperative language and in Datalog."""

from __future__ import annotations

from tidewater.functions.convert import convert
from tidewater.plans import datalog
from tidewater.plans.programs import Interpreter
from tidewater.queries import ORACLE_SQL, QUERIES, _query, _t
from tidewater.sources import tables


def _program(name: str, text: str, oracle: str, out: str = "X") -> None:
    def run(spark, d):
        relations = {t: _t(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
        relations["distances"] = tables.distances(relations["nation"])
        return Interpreter(spark, relations).run(text)[out]

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle


_program("ml_comprehension", "P = scan(part); X = [from P where p_size > 25 and not (p_brand = 'Brand#11') emit p_partkey, p_size % 7 as m, p_size // 4 as q, substr(p_name, 0, 3) as s];", "SELECT p_partkey, CAST(p_size % 7 AS BIGINT) AS m, CAST(p_size // 4 AS BIGINT) AS q, SUBSTRING(p_name, 1, 3) AS s FROM part WHERE p_size > 25 AND NOT p_brand = 'Brand#11'")
_program("ml_select_groups", "O = scan(orders); C = scan(customer); X = select C.c_nationkey as k, count(*) as n, max(O.o_totalprice) - min(O.o_totalprice) as spread from O, C where O.o_custkey = C.c_custkey;", "SELECT c_nationkey AS k, COUNT(*) AS n, MAX(o_totalprice) - MIN(o_totalprice) AS spread FROM orders, customer WHERE o_custkey = c_custkey GROUP BY c_nationkey")
_program("ml_set_operations", "C = [from scan(customer) as T emit c_nationkey as k]; S = [from scan(supplier) as T emit s_nationkey as k]; X = union(intersect(C, S), diff(C, S)) + [-1 as k];", "SELECT DISTINCT c_nationkey AS k FROM customer UNION ALL SELECT -1".replace("c_nationkey AS k", "CAST(c_nationkey AS BIGINT) AS k"))
_program("ml_join_unbox", "L = scan(lineitem); O = scan(orders); M = [from O emit avg(o_totalprice) as m]; J = join(L, l_orderkey, O, o_orderkey); X = [from J where o_totalprice > *M.m emit l_orderkey, count(*) as n];", "SELECT l_orderkey, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) GROUP BY l_orderkey")
_program("ml_functions", "DEF disc(p, d): p * (1 - d); CONST rate: 2; L = scan(lineitem); X = [from L emit l_orderkey, l_linenumber, disc(l_extendedprice, l_discount) * rate as v, case when l_quantity > 25 then 'big' else 'small' end as size];", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * 2 AS v, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size FROM lineitem")
_program("ml_uda", "UDA spread(v) { [0.0 - 1000000.0 as hi, 1000000.0 as lo]; [greater(hi, v), lesser(lo, v)]; hi - lo; }; E = scan(events); X = [from E emit user_id, spread(value) as s];", "SELECT user_id, MAX(value) - MIN(value) AS s FROM events GROUP BY user_id")
_program("ml_do_while", "N = [1 as i, 1 as f]; do N = [from N emit i + 1 as i, f * (i + 1) as f]; C = [from N emit i < 10]; while C;", "SELECT CAST(10 AS BIGINT) AS i, CAST(3628800 AS BIGINT) AS f", "N")
_EDGES = f"edges AS ({tables.DISTANCES_SQL})"
_program("ml_recursion", "E = scan(distances); S = [1 as id]; do R = [id] <- S + [from R, E where R.id = E.src emit E.target as id]; until convergence;", f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT e.target FROM r, edges e WHERE e.src = r.id) SELECT id FROM r", "R")
_program("ml_recursion_min", "E = scan(distances); S = [1 as id, 0 as cost]; do R = [id, min(cost)] <- S + [from R, E where R.id = E.src emit E.target as id, R.cost + E.distance as cost]; until convergence;", f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS cost UNION SELECT e.target, r.cost + e.distance FROM r, edges e WHERE e.src = r.id AND r.cost < 40) SELECT id, CAST(MIN(cost) AS BIGINT) AS cost FROM r GROUP BY id", "R")


@_query("dl_paths", f"WITH RECURSIVE {_EDGES}, p AS (SELECT src, target FROM edges UNION SELECT p.src, e.target FROM p, edges e WHERE p.target = e.src) SELECT src AS c0, COUNT(DISTINCT target) AS c1 FROM p WHERE src > 3 GROUP BY src")
def _datalog(spark, d):
    rules = "Path(x, y) :- E(x, y, _).\nPath(x, z) :- Path(x, y), E(y, z, _).\nN(x, COUNT(y)) :- Path(x, y), x > 3."
    return datalog.run(spark, rules, {"E": tables.distances(_t(spark, d, "nation"))})["N"]


@_query("fn_lambda", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN FLOOR(o_totalprice) * 2 ELSE ABS(o_totalprice - 1) END AS v FROM orders")
def _lambda(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", convert("lambda p: floor(p) * 2 if p > 100000 else abs(p - 1)", ["o_totalprice"]).alias("v"))


# Further operators ----------------------------------------------------------------------------------------


@_query("ra_sparse_index")
def _sparse(spark, d):
    from tidewater.operators import joins

    _, index = joins.sparse_index(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4)
    return joins.merge_boundaries(index)


@_query("df_resample_ohlc", "SELECT user_id, date_trunc('day', ts) AS ts, arg_min(value, event_id) AS open, MAX(value) AS high, MIN(value) AS low, arg_max(value, event_id) AS close FROM events GROUP BY ALL")
def _ohlc(spark, d):
    from tidewater.operators import windows

    return windows.resample(_t(spark, d, "events"), "ts", "1 day", windows.ohlc("value", "event_id"), ["user_id"], empty=False)


@_query("arr_einsum", f"SELECT a.src AS i, b.target AS k, CAST(SUM(a.distance * b.distance) AS DOUBLE) AS v FROM ({tables.DISTANCES_SQL}) a, ({tables.DISTANCES_SQL}) b WHERE a.target = b.src GROUP BY a.src, b.target")
def _einsum(spark, d):
    from pyspark.sql import functions as F

    from tidewater.operators import arrays_more

    m = tables.distances(_t(spark, d, "nation")).select(F.col("src").alias("i"), F.col("target").alias("j"), F.col("distance").cast("double").alias("v"))
    return arrays_more.einsum("ij,jk->ik", m, m)


@_query("arr_percentile", "SELECT q, ROUND(quantile_cont(o_totalprice, p), 4) AS v FROM orders, (VALUES (10.0::DOUBLE, 0.1), (50.0::DOUBLE, 0.5), (99.0::DOUBLE, 0.99)) t(q, p) GROUP BY q, p".replace("quantile_cont(o_totalprice, p)", "CASE q WHEN 10 THEN quantile_cont(o_totalprice, 0.1) WHEN 50 THEN quantile_cont(o_totalprice, 0.5) ELSE quantile_cont(o_totalprice, 0.99) END"))
def _percentile(spark, d):
    from pyspark.sql import functions as F

    from tidewater.operators import arrays_more

    return arrays_more.percentile(_t(spark, d, "orders").select(F.col("o_totalprice").alias("v")), [10.0, 50.0, 99.0]).withColumn("v", F.round("v", 4))


@_query("df_normality")
def _normality(spark, d):
    from tidewater.operators import arrays_more

    return _t(spark, d, "orders").agg(arrays_more.skewtest("o_totalprice").alias("skew"), arrays_more.kurtosistest("o_totalprice").alias("kurtosis"), arrays_more.normaltest("o_totalprice").alias("k2"))


@_query("df_groupby_unique", "SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS o_orderstatus_unique FROM orders GROUP BY o_custkey".replace("list_sort(list(DISTINCT o_orderstatus))", "array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',')"))
def _group_unique(spark, d):
    from pyspark.sql import functions as F

    from tidewater.operators import stats

    return stats.reduce(_t(spark, d, "orders"), {"o_orderstatus": "unique"}, ["o_custkey"]).withColumn("o_orderstatus_unique", F.array_join("o_orderstatus_unique", ","))

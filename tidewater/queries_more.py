"""Further registered queries: elementwise functions, windows, groups, frames, bags, arrays, sources, tasks, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import ufuncs
from tidewater.operators import arrays, arrays_more, frame, joins, neighbours, relational, stats, windows
from tidewater.operators.bag import Bag, zip_bags
from tidewater.plans import recursion, tasks
from tidewater.plans.engine import Engine
from tidewater.plans.programs import Interpreter, LanguageError
from tidewater.queries import ORACLE_SQL, QUERIES, _query, _t
from tidewater.queries_programs import _program
from tidewater.sources import io, tables

#: What the names that are registered anew below stood for.
QUERIES_BEFORE = dict(QUERIES)

# Elementwise functions ------------------------------------------------------------------------------

_X, _Y, _K, _B = "(CAST(p_size AS DOUBLE) - 25.5) / 28", "p_retailprice / 1000", "p_size", "(p_partkey % 7)"
#: name, arguments, DuckDB's expression of x in (-0.9, 0.9), y > 0, k in 1..50, b in 0..6.
_UNARY = {
    "abs": ("x", "abs(x)"), "absolute": ("x", "abs(x)"), "fabs": ("x", "abs(x)"), "negative": ("x", "-x"), "positive": ("x", "x"), "sqrt": ("y", "sqrt(y)"), "square": ("x", "x * x"), "cbrt": ("x", "cbrt(x)"), "reciprocal": ("y", "1 / y"), "sign": ("x", "sign(x)"),
    "exp": ("x", "exp(x)"), "exp2": ("x", "pow(2, x)"), "expm1": ("x", "exp(x) - 1"), "log": ("y", "ln(y)"), "log2": ("y", "log2(y)"), "log10": ("y", "log10(y)"), "log1p": ("y", "ln(1 + y)"),
    "sin": ("x", "sin(x)"), "cos": ("x", "cos(x)"), "tan": ("x", "tan(x)"), "arcsin": ("x", "asin(x)"), "arccos": ("x", "acos(x)"), "arctan": ("x", "atan(x)"), "sinh": ("x", "(exp(x) - exp(-x)) / 2"), "cosh": ("x", "(exp(x) + exp(-x)) / 2"), "tanh": ("x", "(exp(x) - exp(-x)) / (exp(x) + exp(-x))"),
    "arcsinh": ("x", "ln(x + sqrt(x * x + 1))"), "arccosh": ("k", "ln(k + sqrt(k * k - 1.0))"), "arctanh": ("x", "0.5 * ln((1 + x) / (1 - x))"), "deg2rad": ("k", "radians(k)"), "radians": ("k", "radians(k)"), "rad2deg": ("x", "degrees(x)"), "degrees": ("x", "degrees(x)"),
    "floor": ("x", "floor(x)"), "ceil": ("x", "ceil(x)"), "rint": ("y", "round_even(y, 0)"), "fix": ("y", "trunc(y)"), "trunc": ("x", "trunc(x)"), "isnan": ("x", "isnan(x)"), "isfinite": ("x", "isfinite(x)"), "isinf": ("x", "isinf(x)"), "signbit": ("x", "x < 0"), "spacing": ("y", "nextafter(y, 'inf'::DOUBLE) - y"),
    "nan_to_num": ("x", "x"), "i0": ("y", "list_sum(list_transform(range(0, 16), lambda n: pow(y / 2, 2 * n) / pow(CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE), 2)))"), "sinc": ("x", "sin(pi() * x) / (pi() * x)"), "modf_fraction": ("y", "y - trunc(y)"), "modf_whole": ("y", "trunc(y)"), "real": ("x", "x"), "imag": ("x", "0.0"), "conj": ("x", "x"), "angle": ("x", "CASE WHEN x < 0 THEN pi() ELSE 0 END"),
    "iscomplex": ("x", "false"), "isreal": ("x", "true"), "frexp_exponent": ("y", "floor(log2(y)) + 1"), "frexp_mantissa": ("y", "y / pow(2, floor(log2(y)) + 1)"), "logical_not": ("b", "CAST(b AS BOOLEAN) = false"), "invert": ("k", "-k - 1"),
}
_BINARY = {
    "add": ("xy", "x + y"), "subtract": ("xy", "x - y"), "multiply": ("xy", "x * y"), "divide": ("xy", "x / y"), "true_divide": ("xy", "x / y"), "floor_divide": ("xy", "floor(x / y)"), "power": ("yx", "pow(y, x)"), "float_power": ("yx", "pow(y, x)"), "mod": ("xy", "x - y * floor(x / y)"), "remainder": ("xy", "x - y * floor(x / y)"), "fmod": ("xy", "x - y * trunc(x / y)"),
    "maximum": ("xy", "greatest(x, y)"), "minimum": ("xy", "least(x, y)"), "fmax": ("xy", "greatest(x, y)"), "fmin": ("xy", "least(x, y)"), "arctan2": ("xy", "atan2(x, y)"), "hypot": ("xy", "sqrt(x * x + y * y)"), "logaddexp": ("xy", "ln(exp(x) + exp(y))"), "logaddexp2": ("xy", "log2(pow(2, x) + pow(2, y))"), "copysign": ("yx", "CASE WHEN x < 0 THEN -y ELSE y END"),
    "nextafter": ("xy", "nextafter(x, y)"), "ldexp": ("xb", "x * pow(2, b)"), "equal": ("kb", "k = b"), "not_equal": ("kb", "k <> b"), "less": ("xy", "x < y"), "less_equal": ("kb", "k <= b"), "greater": ("xy", "x > y"), "greater_equal": ("kb", "k >= b"), "isclose": ("xy", "abs(x - y) <= 1e-8 + 1e-5 * abs(y)"),
    "logical_and": ("kb", "CAST(k AS BOOLEAN) AND CAST(b AS BOOLEAN)"), "logical_or": ("kb", "CAST(k AS BOOLEAN) OR CAST(b AS BOOLEAN)"), "logical_xor": ("kb", "CAST(k AS BOOLEAN) <> CAST(b AS BOOLEAN)"), "bitwise_and": ("kb", "k & b"), "bitwise_or": ("kb", "k | b"), "bitwise_xor": ("kb", "xor(k, b)"), "left_shift": ("kb", "k << b"), "right_shift": ("kb", "k >> b"),
}
_BASE = f"(SELECT p_partkey, CAST({_X} AS DOUBLE) AS x, {_Y} AS y, CAST({_K} AS BIGINT) AS k, CAST({_B} AS INTEGER) AS b FROM part)"


def _elementwise(name: str, of: dict) -> None:
    cells = ", ".join(f"ROUND(CAST({sql} AS DOUBLE), 7) + 0.0 AS u_{n}" for n, (_, sql) in of.items())

    @_query(name, f"SELECT p_partkey, {cells} FROM {_BASE}")
    def run(spark, d):
        base = _t(spark, d, "part").selectExpr("p_partkey", f"CAST({_X} AS DOUBLE) AS x", f"{_Y} AS y", f"CAST({_K} AS BIGINT) AS k", f"CAST({_B} AS INT) AS b")
        return base.select("p_partkey", *((F.round(ufuncs.apply(n, *args).cast("double"), 7) + 0.0).alias(f"u_{n}") for n, (args, _) in of.items()))


_elementwise("fn_ufuncs_unary", _UNARY)
_elementwise("fn_ufuncs_binary", _BINARY)


@_query(
    "fn_ufuncs_special",
    """WITH t(n, a, b) AS (VALUES (1, 1.0::DOUBLE, 'NaN'::DOUBLE), (2, 'NaN'::DOUBLE, 2.0), (3, 'NaN'::DOUBLE, 'NaN'::DOUBLE), (4, 'inf'::DOUBLE, 3.0), (5, '-inf'::DOUBLE, 'inf'::DOUBLE), (6, 1e300, -2.5), (7, -7.5, 2.0), (8, 0.0, -1.0), (9, 1024.0, 1.0)),
f AS (SELECT n, CASE WHEN isnan(a) OR isnan(b) THEN 'NaN'::DOUBLE ELSE least(a, b) END AS minimum, CASE WHEN isnan(a) OR isnan(b) THEN 'NaN'::DOUBLE ELSE greatest(a, b) END AS maximum,
  CASE WHEN isnan(a) THEN b WHEN isnan(b) THEN a ELSE greatest(a, b) END AS fmax, CASE WHEN isnan(a) THEN b WHEN isnan(b) THEN a ELSE least(a, b) END AS fmin,
  CASE WHEN isnan(a) THEN 0 WHEN a = 'inf'::DOUBLE THEN 1.7976931348623157e308 WHEN a = '-inf'::DOUBLE THEN -1.7976931348623157e308 ELSE a END AS nan_to_num, trunc(a) AS trunc, floor(a) AS floor, ceil(a) AS ceil, trunc(a) AS fix, floor(a / b) AS floor_divide FROM t)
SELECT n, u.name AS name, isnan(u.v) AS nan, CASE WHEN isnan(u.v) THEN 0 ELSE u.v END AS v FROM (SELECT n, unnest([{name: 'minimum', v: minimum}, {name: 'maximum', v: maximum}, {name: 'fmax', v: fmax}, {name: 'fmin', v: fmin}, {name: 'nan_to_num', v: nan_to_num}, {name: 'trunc', v: trunc}, {name: 'floor', v: floor}, {name: 'ceil', v: ceil}, {name: 'fix', v: fix}, {name: 'floor_divide', v: floor_divide}]) AS u FROM f)
WHERE isfinite(CASE WHEN isnan(u.v) THEN 0 ELSE u.v END)""",
)
def _special(spark, d):
    nan, inf = float("nan"), float("inf")
    t = spark.createDataFrame([(1, 1.0, nan), (2, nan, 2.0), (3, nan, nan), (4, inf, 3.0), (5, -inf, inf), (6, 1e300, -2.5), (7, -7.5, 2.0), (8, 0.0, -1.0), (9, 1024.0, 1.0)], "n int, a double, b double")
    cell = lambda n, *args: F.struct(F.lit(n).alias("name"), ufuncs.apply(n, *args).alias("v"))
    cells = F.array(*(cell(n, "a", "b") for n in ("minimum", "maximum", "fmax", "fmin", "floor_divide")), *(cell(n, "a") for n in ("nan_to_num", "trunc", "floor", "ceil", "fix")))
    out = t.select("n", F.inline(cells)).select("n", "name", F.isnan("v").alias("nan"), (F.nanvl("v", F.lit(0.0)) + 0.0).alias("v"))
    return out.filter(F.abs("v") < inf)


@_query("fn_divmod", f"SELECT p_partkey, floor(y / 0.37) AS q, ROUND(y - 0.37 * floor(y / 0.37), 7) AS r, ROUND(y / pow(2, floor(log2(y)) + 1), 9) AS mantissa, CAST(floor(log2(y)) + 1 AS INTEGER) AS exponent, trunc(y) AS whole, ROUND(least(greatest(x, -0.25), 0.5), 7) AS clipped FROM {_BASE}")
def _divmod(spark, d):
    base = _t(spark, d, "part").selectExpr("p_partkey", f"CAST({_X} AS DOUBLE) AS x", f"{_Y} AS y")
    two, parts = ufuncs.apply("divmod", "y", F.lit(0.37)), ufuncs.apply("frexp", "y")
    return base.select("p_partkey", two["quotient"].alias("q"), F.round(two["remainder"], 7).alias("r"), F.round(parts["mantissa"], 9).alias("mantissa"), parts["exponent"].alias("exponent"), ufuncs.apply("modf", "y")["whole"].alias("whole"), F.round(ufuncs.clip("x", -0.25, 0.5), 7).alias("clipped"))


@_query("fn_md5_long", "SELECT p_partkey, CAST(CAST('0x' || substr(md5(p_name), 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS h FROM part")
def _md5(spark, d):
    return QUERIES_BEFORE["fn_md5_long"](spark, d)


@_query("fn_bitset", "SELECT r_regionkey, CAST(pos AS INTEGER) AS pos, (ord(substr(r_name, CAST(pos // 8 + 1 AS BIGINT), 1)) >> CAST(pos % 8 AS INTEGER)) & 1 = 1 AS bit FROM (SELECT r_regionkey, r_name, unnest(range(0, 8 * length(r_name))) AS pos FROM region)")
def _bits(spark, d):
    return QUERIES_BEFORE["fn_bitset"](spark, d)


@_query("fn_library", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_retailprice / (p_size % 5) END AS safe, greatest(p_size, 25, p_partkey % 40) AS hi, least(p_size, 25, p_partkey % 40) AS lo, CAST(42 AS INTEGER) AS answer, substr(p_name, 3, 4) AS piece, -p_size AS neg FROM part")
def _library(spark, d):
    from tidewater.functions import scalar

    k = F.col("p_partkey") % 40
    return _t(spark, d, "part").select("p_partkey", scalar.safe_div(F.col("p_retailprice"), F.col("p_size") % 5).alias("safe"), scalar.greatest("p_size", F.lit(25), k).alias("hi"), scalar.least("p_size", F.lit(25), k).alias("lo"), scalar.the_answer().cast("int").alias("answer"), scalar.byterange("p_name", 2, 6).cast("string").alias("piece"), (-F.col("p_size")).alias("neg"))


# User functions and algorithms ----------------------------------------------------------------------


@_query(
    "udf_knn",
    """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS label, c_custkey % 4 = 3 AS test, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b, CAST(length(c_name) + c_custkey % 13 AS DOUBLE) AS e FROM customer),
m AS (SELECT AVG(a) AS ma, STDDEV_POP(a) AS sa, AVG(b) AS mb, STDDEV_POP(b) AS sb, AVG(e) AS me, STDDEV_POP(e) AS se FROM c WHERE NOT test),
z AS (SELECT id, label, test, (a - ma) / sa AS a, (b - mb) / sb AS b, (e - me) / se AS e FROM c, m),
p AS (SELECT q.id, q.label AS actual, t.label, row_number() OVER (PARTITION BY q.id ORDER BY (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.e - t.e) * (q.e - t.e), t.id) AS r FROM z q, z t WHERE q.test AND NOT t.test)
SELECT actual, guess, COUNT(*) AS n FROM (SELECT id, actual, MIN(label) AS guess FROM p WHERE r <= 2 GROUP BY id, actual) GROUP BY actual, guess""",
)
def _knn(spark, d):
    """Confusion counts of a 2-nearest-neighbour guess of the segment from three standardised features, a quarter of the rows held out."""
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), (F.length("c_name") + F.col("c_custkey") % 13).cast("double").alias("other"), "c_mktsegment")
    train, test = c.filter("c_custkey % 4 <> 3"), c.filter("c_custkey % 4 = 3")
    guess = neighbours.classify(train, test, "c_custkey", ["c_acctbal", "nation", "other"], "c_mktsegment", 2)
    return test.join(guess, F.col("c_custkey") == F.col("query")).groupBy(F.col("c_mktsegment").alias("actual"), "guess").agg(F.count(F.lit(1)).alias("n"))


@_query("udf_kmeans")
def _kmeans(spark, d):
    """Four clusters of customers by two standardised features."""
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return recursion.kmeans(neighbours.scaled(c, c, ["c_acctbal", "nation"]), "c_custkey", ["c_acctbal", "nation"], 4)


@_query("udf_logit_fit", "SELECT ROUND(r, 5) AS slope, ROUND(i, 5) AS intercept, ROUND(SQRT(AVG(POW(z - (i + r * x), 2))), 5) AS rmse FROM (SELECT regr_slope(z, x) OVER () AS r, regr_intercept(z, x) OVER () AS i, z, x FROM (SELECT l_quantity AS x, ln((l_discount + 0.05) / (1 - l_discount - 0.05)) AS z FROM lineitem)) GROUP BY r, i")
def _logit(spark, d):
    """A line fitted to the logit of a share, and its root mean square error, through a registered function in two steps."""
    e = Engine(spark, d)
    sums = {"n": "COUNT(x)", "sx": "SUM(x)", "sz": "SUM(z)", "sxx": "SUM(x * x)", "sxz": "SUM(x * z)", "szz": "SUM(z * z)"}

    def finish(n, sx, sz, sxx, sxz, szz):
        r = (n * sxz - sx * sz) / (n * sxx - sx * sx)
        i = (sz - r * sx) / n
        left = szz - 2 * i * sz - 2 * r * sxz + n * i * i + 2 * i * r * sx + r * r * sxx
        return round(r, 5), round(i, 5), round((max(left, 0.0) / n) ** 0.5, 5)

    e.register_decomposable("logit_fit", sums, finish, "slope double, intercept double, rmse double", ["x", "z"])
    return e.query("SELECT logit_fit(l_quantity, ln((l_discount + 0.05) / (1 - l_discount - 0.05))) FROM lineitem")


@_query("udf_conjugate_gradient", "SELECT ROUND(regr_slope(o_totalprice, o_orderkey / 10000.0), 3) AS slope, ROUND(regr_intercept(o_totalprice, o_orderkey / 10000.0), 2) AS intercept FROM orders")
def _gradient(spark, d):
    """Least squares by conjugate gradients: the sums by one aggregation, the iteration on them."""
    e = Engine(spark, d)

    def finish(n, sx, sy, sxx, sxy):
        import numpy as np

        a, b = np.array([[sxx, sx], [sx, n]], dtype=float), np.array([sxy, sy], dtype=float)
        x, r = np.zeros(2), b.copy()
        p = r.copy()
        for _ in range(50):
            if r @ r < 1e-18 * (b @ b):
                break
            step = (r @ r) / (p @ a @ p)
            x, old = x + step * p, r @ r
            r = r - step * (a @ p)
            p = r + (r @ r) / old * p
        return round(float(x[0]), 3), round(float(x[1]), 2)

    e.register_decomposable("conjugate_gradient", {"n": "COUNT(x)", "sx": "SUM(x)", "sy": "SUM(y)", "sxx": "SUM(x * x)", "sxy": "SUM(x * y)"}, finish, "slope double, intercept double", ["x", "y"])
    return e.query("SELECT conjugate_gradient(o_orderkey / 10000.0D, o_totalprice) FROM orders")


_E = f"e AS ({tables.DISTANCES_SQL})"
_RANKS = ", ".join(f"r{n + 1} AS MATERIALIZED (SELECT v.id, 0.15 / 25 + 0.85 * COALESCE(SUM(r.rank / o.n), 0) AS rank FROM v LEFT JOIN e ON e.target = v.id LEFT JOIN r{n} r ON r.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY v.id)" for n in range(20))


@_query("ra_pagerank", f"WITH {_E}, v AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation), o AS (SELECT src, COUNT(*) AS n FROM e GROUP BY src), r0 AS MATERIALIZED (SELECT id, 1.0 / 25 AS rank FROM v), {_RANKS} SELECT id, ROUND(CAST(rank AS DOUBLE), 9) AS rank FROM r20")
def _pagerank(spark, d):
    return QUERIES_BEFORE["ra_pagerank"](spark, d).select("id", F.round("rank", 9).alias("rank"))


_CLIPS = ", ".join(f"k{n + 1} AS MATERIALIZED (SELECT * FROM k{n} WHERE abs(v - (SELECT AVG(v) FROM k{n})) <= 2 * (SELECT STDDEV_POP(v) FROM k{n}))" for n in range(40))


@_query("ra_sigma_clipping", f"WITH k0 AS MATERIALIZED (SELECT o_orderkey, o_totalprice AS v FROM orders), {_CLIPS} SELECT o_orderkey, v AS o_totalprice FROM k40")
def _sigma(spark, d):
    return QUERIES_BEFORE["ra_sigma_clipping"](spark, d)


@_query("ra_long_paths", "SELECT id, CAST(0 AS BIGINT) AS root, CAST(id AS DOUBLE) AS cost FROM (SELECT unnest(range(0, 2000)) AS id)")
def _long(spark, d):
    """A path of 2,000 vertices: its one component, and costs along it."""
    path = spark.range(1999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("cost"))
    return recursion.connected(path).join(recursion.shortest_paths(path, spark.range(1)), "id")


@_query("sql_recursive_deep", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 30) SELECT n FROM t")
def _deep(spark, d):
    return Engine(spark, d).query(ORACLE_SQL["sql_recursive_deep"])


_NORMAL = "SELECT n, (q3 / n - 3 * m * q2 / n + 2 * m * m * m) / POW(q2 / n - m * m, 1.5) AS s, (q4 / n - 4 * m * q3 / n + 6 * m * m * q2 / n - 3 * m * m * m * m) / POW(q2 / n - m * m, 2) AS k FROM (SELECT CAST(COUNT(x) AS DOUBLE) AS n, AVG(x) AS m, SUM(x * x) AS q2, SUM(x * x * x) AS q3, SUM(x * x * x * x) AS q4 FROM (SELECT (o_totalprice - (SELECT AVG(o_totalprice) FROM orders)) / 100000 AS x FROM orders))"


@_query(
    "df_normality",
    f"""WITH b AS ({_NORMAL}), c AS (SELECT *, s * SQRT((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
  (k - 3 * (n - 1) / (n + 1)) / SQRT(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * SQRT(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS bb FROM b),
e AS (SELECT *, SQRT(2 * (beta - 1)) - 1 AS w2, 6 + 8 / bb * (2 / bb + SQRT(1 + 4 / (bb * bb))) AS a FROM c),
z AS (SELECT 1 / SQRT(0.5 * LN(w2)) * LN(y / SQRT(2 / (w2 - 1)) + SQRT(POW(y / SQRT(2 / (w2 - 1)), 2) + 1)) AS skew,
  (1 - 2 / (9 * a) - SIGN(1 + x * SQRT(2 / (a - 4))) * POW((1 - 2 / a) / ABS(1 + x * SQRT(2 / (a - 4))), 1.0 / 3)) / SQRT(2 / (9 * a)) AS kurtosis FROM e)
SELECT ROUND(skew, 4) AS skew, ROUND(kurtosis, 4) AS kurtosis, ROUND(skew * skew + kurtosis * kurtosis, 3) AS k2 FROM z""",
)
def _normal(spark, d):
    out = QUERIES_BEFORE["df_normality"](spark, d)
    return out.select(F.round("skew", 4).alias("skew"), F.round("kurtosis", 4).alias("kurtosis"), F.round("k2", 3).alias("k2"))


@_query("df_nunique_approx", "SELECT COUNT(DISTINCT l_partkey) AS exact, true AS near FROM lineitem")
def _approximate(spark, d):
    out = QUERIES_BEFORE["df_nunique_approx"](spark, d)
    return out.select("exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.02 * F.col("exact")).alias("near"))


@_query("ra_sparse_index", "SELECT MIN(o_orderkey) AS low, MAX(o_orderkey) AS high, COUNT(*) AS n, true AS apart, CAST((SELECT COUNT(*) FROM orders WHERE o_orderkey = 77) AS BIGINT) AS probed FROM orders")
def _sparse(spark, d):
    """An index of key ranges: together they hold all rows, none overlaps the next, and a probe finds a key's rows in its range."""
    dealt, index = joins.sparse_index(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4)
    index = recursion.settle(index)
    apart = joins.merge_boundaries(index).agg(F.count(F.lit(1)).alias("runs"))
    part = joins.index_probe(index, 77).select("part")
    probed = dealt.join(part, "part", "left_semi").filter("o_orderkey = 77").agg(F.count(F.lit(1)).alias("probed"))
    whole = index.agg(F.min("begin").alias("low"), F.max("end").alias("high"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    return whole.crossJoin(apart).crossJoin(probed).select("low", "high", "n", (F.col("runs") == F.col("parts")).alias("apart"), "probed")  # one row each


@_query("df_bloom_join", "SELECT o_orderkey, c_acctbal FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 8000")
def _bloom(spark, d):
    rich = _t(spark, d, "customer").filter("c_acctbal > 8000")
    may = joins.bloom_semi(_t(spark, d, "orders"), "o_custkey", rich, "c_custkey")
    return may.join(rich, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_acctbal")


@_query("sql_catalog", "SELECT 'orders' AS parent, 'o_orderkey' AS key, 'l_orderkey' AS foreign_key, 'l_suppkey' AS third, CAST((SELECT COUNT(*) FROM lineitem) AS BIGINT) AS n")
def _catalog(spark, d):
    parent, key, foreign = tables.join_keys("lineitem", "orders")
    n = _t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(parent).alias("parent"), F.lit(key).alias("key"), F.lit(foreign).alias("foreign_key"), F.lit(tables.column_at("lineitem", 2)).alias("third"), "n")


@_query("sql_errors", "SELECT unnest(['duplicate alias', 'nested aggregate', 'ungrouped column', 'unknown function', 'unknown table']) AS refused")
def _errors(spark, d):
    """Statements that must be refused, by what is wrong with them."""
    from pyspark.errors import PySparkException

    e, found = Engine(spark, d), []
    for what, text in (("unknown table", "SELECT a FROM nowhere"), ("ungrouped column", "SELECT c_name, COUNT(*) AS n FROM customer GROUP BY c_nationkey"), ("nested aggregate", "SELECT SUM(COUNT(c_custkey)) FROM customer"), ("unknown function", "SELECT nothing_such(c_custkey) FROM customer")):
        try:
            e.query(text).schema  # noqa: B018
        except (PySparkException, ValueError):
            found.append(what)
    try:
        Interpreter(spark, {"n": _t(spark, d, "nation")}).run("E = scan(n); X = [from E, E emit n_name];")
    except LanguageError:
        found.append("duplicate alias")
    return spark.createDataFrame([(x,) for x in sorted(found)], "refused string")


# Frames ---------------------------------------------------------------------------------------------

_PE = "PARTITION BY user_id ORDER BY ts, event_id"
_C3 = f"OVER ({_PE} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"


@_query("df_rolling_centred", f"SELECT event_id, CASE WHEN COUNT(value) {_C3} >= 4 THEN ROUND(SUM(value) {_C3}, 4) END AS s, CASE WHEN COUNT(value) {_C3} >= 4 THEN MAX(value) {_C3} END AS m FROM events")
def _centred(spark, d):
    r = windows.Rolling(["user_id"], ["ts", "event_id"], rows=4, center=True)
    return _t(spark, d, "events").select("event_id", F.round(r.sum("value"), 4).alias("s"), r.max("value").alias("m"))


_R6 = f"WINDOW r AS ({_PE} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_r6 = lambda f, name, digits=7: f"CASE WHEN COUNT(value) OVER r >= 6 THEN ROUND({f} OVER r, {digits}) END AS {name}"


@_query("df_rolling_more", f"SELECT event_id, {_r6('VAR_SAMP(value)', 'va')}, {_r6('VAR_POP(value)', 'vp')}, {_r6('COVAR_SAMP(value, event_id)', 'co', 6)}, {_r6('QUANTILE_CONT(value, 0.3)', 'qu')}, {_r6('QUANTILE_CONT(value, 0.5)', 'me')}, {_r6('MAX(value)', 'ap')}, COUNT(value) OVER r AS n FROM events {_R6}")
def _rolling(spark, d):
    r = windows.Rolling(["user_id"], ["ts", "event_id"], rows=6)
    o = lambda c, n, k=7: F.round(c, k).alias(n)
    return _t(spark, d, "events").select("event_id", o(r.var("value"), "va"), o(r.var("value", 0), "vp"), o(r.cov("value", "event_id"), "co", 6), o(r.quantile("value", 0.3), "qu"), o(r.median("value"), "me"), o(r.apply("value", F.array_max), "ap"), r.count("value").alias("n"))


_M = "SUM(value) OVER r / 12 AS m, SUM(value * value) OVER r / 12 AS m2, SUM(value * value * value) OVER r / 12 AS m3, SUM(value * value * value * value) OVER r / 12 AS m4"


@_query("df_rolling_shape", f"SELECT event_id, ROUND((m3 - 3 * m * m2 + 2 * m * m * m) / POW(m2 - m * m, 1.5) * SQRT(132.0) / 10, 2) AS sk, ROUND(11.0 / 90 * (13 * ((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / POW(m2 - m * m, 2) - 3) + 6), 2) AS ku FROM (SELECT event_id, COUNT(value) OVER r AS n, {_M} FROM events WINDOW r AS ({_PE} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE n = 12")
def _shape(spark, d):
    r = windows.Rolling(["user_id"], ["ts", "event_id"], rows=12)
    out = _t(spark, d, "events").select("event_id", F.round(r.skew("value"), 2).alias("sk"), F.round(r.kurt("value"), 2).alias("ku"))
    return out.filter("sk IS NOT NULL")


@_query(
    "df_resample_more",
    "SELECT date_trunc('day', ts) AS ts, COUNT(*) AS size, ROUND(AVG(value), 7) AS mean, MIN(value) AS min, ROUND(MEDIAN(value), 7) AS median, COUNT(DISTINCT user_id) AS nunique, ROUND(EXP(SUM(LN(1 + value / 1e6))), 6) AS prod, ROUND(STDDEV_SAMP(value) / SQRT(COUNT(value)), 7) AS sem, ROUND(STDDEV_SAMP(value), 7) AS std, ROUND(VAR_SAMP(value), 7) AS var, ROUND(QUANTILE_CONT(value, 0.9), 7) AS q90, arg_max(value, event_id) AS last, MAX(value) - MIN(value) AS span FROM events GROUP BY 1",
)
def _resample(spark, d):
    from tidewater.functions import aggregates

    v = F.col("value")
    aggs = {"size": F.count(F.lit(1)), "mean": F.round(F.avg(v), 7), "min": F.min(v), "median": F.round(F.median(v), 7), "nunique": F.count_distinct("user_id"), "prod": F.round(F.product(1 + v / 1e6), 6), "sem": F.round(aggregates.sem("value"), 7), "std": F.round(F.stddev_samp(v), 7), "var": F.round(F.var_samp(v), 7), "q90": F.round(stats.quantile("value", 0.9), 7), "last": stats.last("value", "event_id"), "span": F.max(v) - F.min(v)}
    return windows.resample(_t(spark, d, "events"), "ts", "1 day", aggs, empty=False)


@_query("df_group_more", "SELECT o_orderpriority, COUNT(*) AS size, ROUND(EXP(SUM(LN(1 + o_totalprice / 1e9))), 6) AS prod, ROUND(STDDEV_SAMP(o_totalprice) / SQRT(COUNT(*)), 4) AS sem FROM orders WHERE o_orderpriority <= '3' OR o_orderpriority > '3' GROUP BY o_orderpriority")
def _groups(spark, d):
    from tidewater.functions import aggregates

    o = _t(spark, d, "orders").withColumn("x", 1 + F.col("o_totalprice") / 1e9)
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("size"), F.round(F.product("x"), 6).alias("prod"), F.round(aggregates.sem("o_totalprice"), 4).alias("sem"))


@_query("df_cumprod", f"SELECT event_id, ROUND(EXP(SUM(LN(1 + value / 1e5)) OVER ({_PE} ROWS UNBOUNDED PRECEDING)), 6) AS p, row_number() OVER ({_PE}) - 1 AS n FROM events WHERE user_id = 7")
def _cumprod(spark, d):
    """One group's rows, their running products and numbers."""
    one = relational.select(_t(spark, d, "events"), F.col("user_id") == 7).withColumn("x", 1 + F.col("value") / 1e5)
    by = (["user_id"], ["ts", "event_id"])
    return one.select("event_id", F.round(stats.cumulative("x", "prod", *by), 6).alias("p"), stats.cumulative(None, "count", *by).cast("long").alias("n"))


@_query("df_autocorr", f"SELECT user_id, ROUND(CORR(a, b), 6) AS autocorr FROM (SELECT user_id, value AS a, LAG(value, 2) OVER ({_PE}) AS b FROM events) GROUP BY user_id")
def _autocorr(spark, d):
    return stats.autocorr(_t(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 2).select("user_id", F.round("autocorr", 6).alias("autocorr"))


@_query(
    "df_columns",
    "SELECT l_orderkey AS okey, l_linenumber, round_even(l_extendedprice, 1) AS rounded, CAST(l_quantity AS BIGINT) AS qty, l_extendedprice * 2 + 1 AS twice, least(greatest(l_discount, 0.02), 0.06) AS clipped, least(l_discount, 0.05) AS clip_up, greatest(l_discount, 0.05) AS clip_low, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS flag, l_tax IS NULL AS missing, l_tax IS NOT NULL AS there, l_linestatus || '-' || l_returnflag AS joined FROM lineitem WHERE l_quantity > 10 AND l_discount BETWEEN 0.01 AND 0.09",
)
def _columns(spark, d):
    f = frame
    df = f.query(_t(spark, d, "lineitem"), "l_quantity > 10").filter(f.between("l_discount", 0.01, 0.09))
    df = f.assign(df, twice="l_extendedprice * 2 + 1", rounded=f.round_half_even("l_extendedprice", 1), qty=f.astype("l_quantity", "long"), clipped=f.clip("l_discount", 0.02, 0.06), clip_up=f.clip("l_discount", upper=0.05), clip_low=f.clip("l_discount", lower=0.05), flag=f.map_values("l_returnflag", {"R": 1, "A": 2}), missing=f.isnull(df, "l_tax"), there=f.notnull(df, "l_tax"), joined=f.cat(["l_linestatus", "l_returnflag"], "-"))
    df = f.rename(df, {"l_orderkey": "okey"})
    _, df = f.pop(df, "l_tax")
    df = f.drop(df, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    return df.select("okey", "l_linenumber", "rounded", "qty", "twice", "clipped", "clip_up", "clip_low", "flag", "missing", "there", "joined")


_ALL = "ORDER BY ts, event_id"


@_query("df_frame_windows", f"SELECT event_id, ROUND(SUM(value) OVER ({_ALL} ROWS UNBOUNDED PRECEDING), 3) AS total, MAX(value) OVER ({_ALL} ROWS UNBOUNDED PRECEDING) AS top FROM events")
def _frame_windows(spark, d):
    """Running values over the whole frame, no partition key: no task sees more than its range."""
    e = _t(spark, d, "events").select("event_id", "ts", "value")
    out = windows.cumulative_frame(windows.cumulative_frame(e, "value", "sum", ["ts", "event_id"], "total", 6), "value", "max", ["ts", "event_id"], "top", 6)
    return out.select("event_id", F.round("total", 3).alias("total"), "top")


@_query("df_frame_rolling", f"SELECT event_id, LAG(value, 2) OVER ({_ALL}) AS back, value - LAG(value) OVER ({_ALL}) AS step, LEAD(value, 3) OVER ({_ALL}) AS ahead, CASE WHEN COUNT(value) OVER r >= 7 THEN ROUND(SUM(value) OVER r, 4) END AS s, CASE WHEN COUNT(value) OVER c >= 4 THEN MAX(value) OVER c END AS m FROM events WINDOW r AS ({_ALL} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), c AS ({_ALL} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def _frame_rolling(spark, d):
    def columns(partition, order):
        r, c = windows.Rolling(partition, order, rows=7), windows.Rolling(partition, order, rows=4, center=True)
        return {"back": windows.shift("value", partition, order, 2), "step": windows.diff("value", partition, order), "ahead": windows.shift("value", partition, order, -3), "s": F.round(r.sum("value"), 4), "m": c.max("value")}

    return windows.over_frame(_t(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], 6, 3, columns, 6).drop("ts", "value")


@_query("df_frame_fill", f"SELECT event_id, LAST_VALUE(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f, FIRST_VALUE(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM (SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) OR event_id < 40 THEN NULL ELSE value END AS v FROM events)")
def _frame_fill(spark, d):
    e = _t(spark, d, "events").select("event_id", F.when(~(F.col("event_id") % 5).isin(0, 1) & (F.col("event_id") >= 40), F.col("value")).alias("v"))
    return windows.fill_frame(windows.fill_frame(e, "v", ["event_id"], "f", True, 6), "v", ["event_id"], "b", False, 6).drop("v")


@_query("df_map_overlap", "SELECT event_id, ROUND(value + COALESCE(LAG(value) OVER (ORDER BY event_id), 0) + COALESCE(LEAD(value) OVER (ORDER BY event_id), 0), 4) AS v FROM events")
def _map_overlap(spark, d):
    """A pandas function that looks one row back and ahead, across the borders of partitions."""

    def near(p):
        return p.assign(v=(p.value + p.value.shift(1).fillna(0) + p.value.shift(-1).fillna(0)).round(4))[["event_id", "v"]]

    return frame.map_overlap_ordered(_t(spark, d, "events").select("event_id", "value"), near, "event_id long, v double", ["event_id"], 1, 1, 6)


@_query("df_quantiles_exact", "SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]) AS q, ROUND(unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0])), 5) AS v, unnest(quantile_cont(l_quantity, [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0])) AS w FROM lineitem")
def _quantiles(spark, d):
    """Exact quantiles without a buffer of all values."""
    li, qs = _t(spark, d, "lineitem"), [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    found = zip(qs, stats.quantiles_exact(li, "l_extendedprice", qs, 500), stats.quantiles_exact(li, "l_quantity", qs, 500))
    return spark.createDataFrame([(q, round(v, 5), w) for q, v, w in found], "q double, v double, w double")


_HOLES = "(SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS t FROM events)"


def _holes(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("t"))


@_query("df_missing", f"SELECT event_id, COALESCE(v, -1.0) AS v, COALESCE(t, '?') AS t, 'filled' AS what FROM {_HOLES} UNION ALL SELECT event_id, v, t, 'any' FROM {_HOLES} WHERE v IS NOT NULL AND t IS NOT NULL UNION ALL SELECT event_id, v, t, 'series' FROM {_HOLES} WHERE v IS NOT NULL")
def _missing(spark, d):
    h = _holes(spark, d).drop("user_id")
    return frame.fillna(frame.fillna(h, -1.0, ["v"]), "?", ["t"]).withColumn("what", F.lit("filled")).unionByName(frame.dropna(h).withColumn("what", F.lit("any"))).unionByName(frame.dropna(h, subset=["v"]).withColumn("what", F.lit("series")))


@_query("df_apply", "SELECT n_nationkey, upper(n_name) AS shout, CAST(length(n_name) + n_regionkey AS BIGINT) AS size, CAST(n_nationkey * 2 AS BIGINT) AS twice FROM nation")
def _apply(spark, d):
    n = _t(spark, d, "nation")
    out = frame.apply_series(n, "n_name", lambda s: s.str.upper(), "string", "shout")
    out = frame.apply_rows(out, lambda r: len(r["n_name"]) + r["n_regionkey"], "long", "size")
    out = frame.map_partitions(out, lambda p: p.assign(twice=p.n_nationkey.astype("int64") * 2)[["n_nationkey", "shout", "size", "twice"]], "n_nationkey int, shout string, size long, twice long")
    return frame.pipe(out, lambda x: x.select("n_nationkey", "shout", "size", "twice"))


@_query("df_applymap", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def _applymap(spark, d):
    return frame.applymap(_t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), lambda c: c.cast("string"))


@_query("df_select_dtypes", "SELECT c_name, c_mktsegment FROM customer")
def _dtypes(spark, d):
    return frame.select_dtypes(_t(spark, d, "customer"), include=("string",))


@_query("df_conversions", "SELECT o_orderkey, date_trunc('day', o_orderdate) AS day, CAST(strftime(o_orderdate, '%Y%m') AS DOUBLE) AS ym, date_trunc('month', o_orderdate) AS mo FROM orders")
def _conversions(spark, d):
    text = _t(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"), F.date_format("o_orderdate", "yyyyMM").alias("y"))
    return text.select("o_orderkey", frame.to_datetime("s", "yyyy-MM-dd").cast("timestamp_ntz").alias("day"), frame.to_numeric("y").alias("ym"), frame.dt_floor("o_orderdate", "month").cast("timestamp_ntz").alias("mo"))


@_query("df_align", "SELECT COALESCE(a.k, b.k) AS k, a.v AS x, b.v AS y, COALESCE(a.v, 0) + COALESCE(b.v, 0) AS total FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k")
def _align(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    a, b = c.filter("k % 2 = 0"), c.filter("k % 3 = 0")
    x, y = frame.align(a, b, "k")
    total = frame.combine(a, b, "k", lambda p, q: p + q, 0.0).withColumnRenamed("v", "total")
    return x.withColumnRenamed("v", "x").join(y.withColumnRenamed("v", "y"), "k").join(total, "k")


@_query("df_extractall", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS match, m[i] AS value FROM (SELECT p_partkey, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT p_partkey, regexp_extract_all(p_type, '[A-Z]{2}') AS m FROM part))")
def _extractall(spark, d):
    return frame.extractall(_t(spark, d, "part"), "p_type", "([A-Z]{2})", keep=["p_partkey"])


@_query("df_order", "SELECT * FROM (SELECT 'small' AS what, c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7) UNION ALL SELECT * FROM (SELECT 'head', c_custkey FROM customer ORDER BY c_custkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'tail', c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5) UNION ALL SELECT 'loc', c_custkey FROM customer WHERE c_custkey BETWEEN 40 AND 60")
def _order(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    parts = {"small": windows.nsmallest(c, 7, ["c_acctbal"], ["c_custkey"]), "head": windows.head(c, 5, ["c_custkey"]), "tail": windows.tail(c, 5, ["c_custkey"]), "loc": frame.loc(c, "c_custkey", 40, 60)}
    return relational.union_all(*(p.select(F.lit(k).alias("what"), "c_custkey") for k, p in parts.items()))


@_query("df_partitions", "SELECT COUNT(*) AS n, COUNT(*) AS split, COUNT(*) AS by_size, COUNT(*) AS by_freq, true AS ordered, CAST(6 AS BIGINT) AS parts, true AS alike FROM orders")
def _partitions(spark, d):
    """Dealt and split in several ways, no row is lost; ranges are in order; aligned frames have equal divisions."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    count = lambda x, n: x.agg(F.count(F.lit(1)).alias(n))
    by = windows.set_index(o, "o_orderkey", 6)
    spans = by.groupBy(F.spark_partition_id().alias("p")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    from pyspark.sql import Window

    ordered = spans.withColumn("before", F.lag("b").over(Window.orderBy("a"))).agg(F.coalesce(F.bool_and(F.col("before") < F.col("a")), F.lit(True)).alias("ordered"))  # a row for each partition
    parts = windows.partition_sizes(by).agg(F.count(F.lit(1)).alias("parts"))
    split = relational.union_all(*windows.random_split(o, [0.5, 0.3, 0.2], 5))
    a, b = frame.align_partitions([o, o.filter("o_orderkey % 2 = 0")], "o_orderkey", [100, 500, 900])
    alike = a.groupBy("part_").agg(F.count(F.lit(1)).alias("x")).join(b.groupBy("part_").agg(F.count(F.lit(1)).alias("y")), "part_").agg((F.count(F.lit(1)) == 4).alias("alike"))
    out = count(windows.repartition_by_size(o, 1 << 16), "by_size").crossJoin(count(windows.repartition_by_freq(o, "o_orderdate", "month"), "by_freq"))
    return count(o, "n").crossJoin(count(split, "split")).crossJoin(out).crossJoin(ordered).crossJoin(parts).crossJoin(alike)  # one row each


@_query("df_info", "SELECT 'c_custkey' AS \"column\", COUNT(c_custkey) AS non_null, 'bigint' AS dtype, 8 * COUNT(c_custkey) AS bytes FROM customer UNION ALL SELECT 'c_name', COUNT(c_name), 'string', CAST(SUM(strlen(c_name)) AS BIGINT) FROM customer UNION ALL SELECT 'c_acctbal', COUNT(c_acctbal), 'double', 8 * COUNT(c_acctbal) FROM customer")
def _info(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return frame.info(c).join(frame.memory_usage(c), "column")


@_query("df_categories", "SELECT s AS known, CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS code, s IN (SELECT c_mktsegment FROM customer WHERE c_custkey <= 5) AS used FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)")
def _categories(spark, d):
    c = _t(spark, d, "customer")
    known = frame.as_known(c, "c_mktsegment")
    used = frame.remove_unused_categories(known, c.filter("c_custkey <= 5"), "c_mktsegment")
    return spark.createDataFrame([(k, n, k in used) for n, k in enumerate(known)], "known string, code int, used boolean")


@_query("df_sample", "SELECT COUNT(*) AS n, true AS some, true AS subset, true AS replaced FROM orders")
def _sample(spark, d):
    """Samples differ in rows; what must hold of them doesn't."""
    o = _t(spark, d, "orders").select("o_orderkey")
    half = windows.sample(o, 0.5, seed=3)
    some = half.agg(F.count(F.lit(1)).alias("s"), F.count_distinct("o_orderkey").alias("u"))
    more = windows.sample(o, 2.0, replace=True, seed=3).agg(F.count(F.lit(1)).alias("m"))
    return o.agg(F.count(F.lit(1)).alias("n")).crossJoin(some).crossJoin(more).select("n", (F.col("s") / F.col("n")).between(0.4, 0.6).alias("some"), (F.col("s") == F.col("u")).alias("subset"), (F.col("m") / F.col("n")).between(1.8, 2.2).alias("replaced"))  # one row each


@_query("df_hypotheses", "SELECT ROUND((AVG(l_quantity) - 25) / (STDDEV_SAMP(l_quantity) / SQRT(COUNT(*))), 5) AS one, ROUND(AVG(l_tax - l_discount) / (STDDEV_SAMP(l_tax - l_discount) / SQRT(COUNT(*))), 5) AS rel, ROUND((SELECT SUM(o * o) * COUNT(*) / SUM(o) - SUM(o) FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS o FROM lineitem GROUP BY l_linenumber)), 5) AS chi FROM lineitem")
def _hypotheses(spark, d):
    li = _t(spark, d, "lineitem")
    one = li.agg(F.round(stats.ttest_1samp(F.col("l_quantity"), 25.0), 5).alias("one"), F.round(stats.ttest_rel(F.col("l_tax"), F.col("l_discount")), 5).alias("rel"))
    return one.crossJoin(stats.chisquare(li, "l_linenumber").select(F.round("chisquare", 5).alias("chi")))  # one row


# Bags -----------------------------------------------------------------------------------------------


@_query("bag_more", "SELECT 'star' AS what, c_custkey * 2 + c_nationkey AS v FROM customer UNION ALL SELECT 'kept', c_custkey FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'mapped', c_custkey + 5 FROM customer UNION ALL SELECT 'first', c_custkey FROM customer UNION ALL SELECT 'second', CAST(c_nationkey AS BIGINT) FROM customer UNION ALL SELECT 'range', unnest(range(0, 9))")
def _bags(spark, d):
    c = _t(spark, d, "customer")
    two = Bag(c.select(F.struct("c_custkey", F.col("c_nationkey").cast("long").alias("n")).alias("value")))
    keys = Bag(c, "c_custkey")
    first, second = two.unzip()
    parts = {"star": two.starmap(lambda a, b: a * 2 + b), "kept": keys.remove(lambda v: v % 3 == 0), "mapped": keys.map_partitions(lambda s: s + 5, "long"), "first": first, "second": second, "range": Bag.range(spark, 9)}
    return relational.union_all(*(b.df.select(F.lit(k).alias("what"), F.col("value").alias("v")) for k, b in parts.items()))


@_query("bag_reduce", "SELECT 'fold' AS what, CAST(SUM(c_custkey) AS DOUBLE) AS v FROM customer UNION ALL SELECT 'var', ROUND(VAR_SAMP(c_custkey), 4) FROM customer UNION ALL SELECT 'std', ROUND(STDDEV_POP(c_custkey), 4) FROM customer UNION ALL SELECT 'pairs', CAST(25 * 5 AS DOUBLE) UNION ALL SELECT 'sample', 10 UNION ALL SELECT 'dealt', CAST(COUNT(*) AS DOUBLE) FROM customer UNION ALL SELECT 'zip', CAST(COUNT(*) AS DOUBLE) FROM customer UNION ALL SELECT 'taken', 4 UNION ALL SELECT 'chosen', 1 UNION ALL SELECT 'some', 1")
def _bag_reduce(spark, d):
    keys, n = Bag(_t(spark, d, "customer"), "c_custkey"), Bag(_t(spark, d, "nation"), "n_nationkey")
    one = {"fold": keys.fold(F.sum), "var": keys.var(1), "std": keys.std(), "pairs": n.product(Bag(_t(spark, d, "region"), "r_regionkey")).agg(F.count(F.lit(1)).alias("value")), "sample": keys.sample(10, 1).count(), "dealt": keys.repartition(5).count(), "zip": zip_bags(keys.df.withColumnRenamed("value", "k"), keys.df.withColumnRenamed("value", "k"), "k").agg(F.count(F.lit(1)).alias("value")), "taken": spark.range(len(keys.take(4))).agg(F.count(F.lit(1)).alias("value")), "chosen": keys.choices(500, 2).df.agg((F.count(F.lit(1)) > 100).cast("int").alias("value")), "some": keys.random_sample(0.5, 2).df.agg((F.count(F.lit(1)) > 10).cast("int").alias("value"))}
    return relational.union_all(*(x.select(F.lit(k).alias("what"), F.round(F.col("value").cast("double"), 4).alias("v")) for k, x in one.items()))


@_query("bag_accumulate", "SELECT c_custkey AS value, CAST(SUM(c_custkey) OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM customer")
def _accumulate(spark, d):
    return Bag(_t(spark, d, "customer"), "c_custkey").accumulate("sum", lambda v: v, lambda v: v % 5)


@_query("bag_records", "SELECT user_id AS u, event_type AS t FROM events WHERE value > 50")
def _records(spark, d):
    e = _t(spark, d, "events").filter("value > 50")
    return Bag(e.select(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t")).alias("value"))).to_dataframe()


# Arrays ---------------------------------------------------------------------------------------------

_CELLS = "(SELECT vec_id AS i, CAST(j - 1 AS BIGINT) AS j, CAST(embedding[j] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings))"


def _cells(spark, d) -> DataFrame:
    return arrays.from_vectors(_t(spark, d, "embeddings"), "vec_id", "embedding")


@_query("arr_reductions_more", f"SELECT i, ROUND(EXP(SUM(LN(1 + ABS(v)))), 5) AS prod, ROUND(SUM(v), 5) AS nansum, MIN(v) AS nanmin, MAX(v) AS nanmax, ROUND(AVG(v), 6) AS nanmean, ROUND(VAR_POP(v), 6) AS nanvar, ROUND(STDDEV_POP(v), 6) AS nanstd, ROUND(MEDIAN(v), 6) AS nanmedian, MAX(v) - MIN(v) AS ptp, COUNT(*) FILTER (v <> 0) AS count_nonzero, ROUND(EXP(SUM(LN(1 + ABS(v)))), 5) AS nanprod FROM {_CELLS} GROUP BY i")
def _reductions(spark, d):
    a = _cells(spark, d)
    plain = arrays.reduce(a, ["nansum", "nanmin", "nanmax", "nanmean", "nanvar", "nanstd", "nanmedian", "ptp", "count_nonzero"], "j")
    prods = arrays.reduce(a.withColumn("v", 1 + F.abs("v")), ["prod", "nanprod"], "j")
    digits = {"nansum": 5, "nanmean": 6, "nanvar": 6, "nanstd": 6, "nanmedian": 6, "prod": 5, "nanprod": 5}
    return plain.join(prods, "i").select("i", *(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in ("prod", "nansum", "nanmin", "nanmax", "nanmean", "nanvar", "nanstd", "nanmedian", "ptp", "count_nonzero", "nanprod")))


@_query("arr_moment", f"SELECT ROUND(AVG(POW(v - m, 3)), 6) AS third, ROUND((SELECT SUM(v) FROM {_CELLS} WHERE i = j), 5) AS trace, ROUND((SELECT SQRT(SUM(v * v)) FROM {_CELLS}), 4) AS fro, ROUND((SELECT MAX(s) FROM (SELECT SUM(ABS(v)) AS s FROM {_CELLS} GROUP BY j)), 4) AS one, ROUND((SELECT MAX(s) FROM (SELECT SUM(ABS(v)) AS s FROM {_CELLS} GROUP BY i)), 4) AS most FROM (SELECT v, AVG(v) OVER () AS m FROM {_CELLS})")
def _moment(spark, d):
    a = _cells(spark, d)
    parts = [arrays.moment(a, 3).select(F.round("moment", 6).alias("third")), arrays.trace(a).select(F.round("trace", 5).alias("trace"))]
    parts += [arrays_more.norm(a, k).select(F.round("norm", 4).alias(n)) for k, n in (("fro", "fro"), ("1", "one"), ("inf", "most"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@_query("arr_pick", f"SELECT * FROM (SELECT 'top' AS what, i, j, v FROM {_CELLS} ORDER BY v DESC, i, j LIMIT 9) UNION ALL SELECT 'taken', i, j, v FROM {_CELLS} WHERE j IN (1, 5) UNION ALL SELECT 'kept', i, j, v FROM {_CELLS} WHERE i IN (0, 2) UNION ALL SELECT 'upper', i, j, v FROM {_CELLS} WHERE j >= i UNION ALL SELECT 'lower', i, j, v FROM {_CELLS} WHERE j <= i UNION ALL SELECT 'extracted', i, j, v FROM {_CELLS} WHERE v > 0.2")
def _pick(spark, d):
    a = _cells(spark, d)
    parts = {"top": arrays.topk(a, 9), "taken": arrays.take(a, "j", [1, 5]), "kept": arrays_more.compress(a, "i", [True, False, True]), "upper": arrays.triangle(a), "lower": arrays.triangle(a, False), "extracted": arrays_more.extract(a, F.col("v") > 0.2)}
    return relational.union_all(*(p.select(F.lit(k).alias("what"), "i", "j", "v") for k, p in parts.items()))


@_query("arr_moves", f"SELECT 't' AS what, j AS i, i AS j, v FROM {_CELLS} UNION ALL SELECT 'swap', j, i, v FROM {_CELLS} UNION ALL SELECT 'roll', i, (j + 3) % 32, v FROM {_CELLS} WHERE j < 32 UNION ALL SELECT 'flip', i, 31 - j, v FROM {_CELLS} WHERE j < 32 UNION ALL SELECT 'stack', i + 10 * k, j, v FROM (SELECT * FROM {_CELLS} WHERE i < 10), (SELECT unnest([0, 1]) AS k) UNION ALL SELECT 'side', i, j + 32 * k, v FROM (SELECT * FROM {_CELLS} WHERE i < 10 AND j < 32), (SELECT unnest([0, 1]) AS k) UNION ALL SELECT 'zero', i, j, 0.0 FROM {_CELLS} UNION ALL SELECT 'one', i, j, 1.0 FROM {_CELLS}")
def _moves(spark, d):
    a = _cells(spark, d)
    few, wide = a.filter("i < 10"), a.filter("j < 32")
    parts = {"t": arrays.transpose(a), "swap": arrays_more.swapaxes(a, "i", "j"), "roll": arrays.roll(wide, "j", 3, 32), "flip": arrays.flip(wide, "j", 32), "stack": arrays_more.vstack([few, few], [10, 10]), "side": arrays_more.hstack([few.filter("j < 32"), few.filter("j < 32")], [32, 32]), "zero": arrays_more.zeros_like(a), "one": arrays_more.ones_like(a)}
    return relational.union_all(*(p.select(F.lit(k).alias("what"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v") for k, p in parts.items()))


@_query("arr_products", f"WITH c AS (SELECT * FROM {_CELLS}) SELECT 'vdot' AS what, CAST(0 AS BIGINT) AS i, ROUND(SUM(v * v), 4) AS v FROM c UNION ALL SELECT 'average', i, ROUND(SUM(v * (j + 1)) / SUM(j + 1), 6) FROM c GROUP BY i UNION ALL SELECT 'coarse', i * 100 + j // 4, ROUND(SUM(v), 6) FROM c GROUP BY i * 100 + j // 4 UNION ALL SELECT 'over', j, ROUND(SUM(v), 5) FROM c GROUP BY j UNION ALL SELECT 'dot', a.i, ROUND(SUM(a.v * b.v), 5) FROM c a JOIN c b ON a.j = b.j AND b.i = 0 GROUP BY a.i")
def _products(spark, d):
    a = _cells(spark, d)
    zero = F.lit(0).cast("long").alias("i")
    parts = {
        "vdot": arrays_more.vdot(a, a).select(zero, F.round("vdot", 4).alias("v")),
        "average": arrays.average(a, F.col("j") + 1, "j").select("i", F.round("average", 6).alias("v")),
        "coarse": arrays.coarsen(a, "sum", "j", 4).select((F.col("i") * 100 + F.col("j")).alias("i"), F.round("v", 6).alias("v")),
        "over": arrays_more.apply_over_axes(a, "sum", ["i"]).select(F.col("j").alias("i"), F.round("v", 5).alias("v")),
        "dot": arrays.tensordot(a, a.filter("i = 0"), [("j", "j")]).select(F.col("a_i").alias("i"), F.round("v", 5).alias("v")),
    }
    return relational.union_all(*(p.select(F.lit(k).alias("what"), "i", "v") for k, p in parts.items()))


@_query("arr_bins", "SELECT 'count' AS what, CAST(p_size AS BIGINT) AS v, COUNT(*) AS n FROM part GROUP BY p_size UNION ALL SELECT 'digit', CAST((p_size >= 10) AS BIGINT) + CAST((p_size >= 25) AS BIGINT) + CAST((p_size >= 40) AS BIGINT), COUNT(*) FROM part GROUP BY 2 UNION ALL SELECT 'union', v, 1 FROM (SELECT CAST(p_size AS BIGINT) AS v FROM part WHERE p_size < 9 UNION SELECT CAST(p_partkey % 11 AS BIGINT) FROM part) UNION ALL SELECT 'piece', CASE WHEN p_size < 10 THEN -1 WHEN p_size > 40 THEN 1 ELSE 0 END, COUNT(*) FROM part GROUP BY 2 UNION ALL SELECT 'choose', CASE p_partkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE 9 END, COUNT(*) FROM part GROUP BY 2")
def _bins(spark, d):
    p = _t(spark, d, "part")
    v = p.select(F.col("p_size").alias("v"))
    count = lambda c: p.groupBy(c.cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = {
        "count": arrays.bincount(v).select(F.col("value").alias("v"), "n"),
        "digit": count(arrays.digitize("p_size", [10, 25, 40])),
        "union": arrays_more.union1d(v.filter("v < 9").select(F.col("v").cast("long").alias("v")), p.select((F.col("p_partkey") % 11).alias("v"))).select("v", F.lit(1).cast("long").alias("n")),
        "piece": count(arrays_more.piecewise(F.col("p_size"), [F.col("p_size") < 10, F.col("p_size") > 40], [F.lit(-1), F.lit(1)], F.lit(0))),
        "choose": count(arrays_more.choose((F.col("p_partkey") % 3).cast("int"), [F.lit(7), F.lit(8), F.lit(9)])),
    }
    return relational.union_all(*(x.select(F.lit(k).alias("what"), "v", "n") for k, x in parts.items()))


@_query("arr_create", "SELECT 'arange' AS what, CAST(k AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, 1.5 + 0.5 * k AS v FROM (SELECT unnest(range(0, 7)) AS k) UNION ALL SELECT 'linspace', k, 0, k * 0.25 FROM (SELECT unnest(range(0, 9)) AS k) UNION ALL SELECT 'eye', k, k, 1.0 FROM (SELECT unnest(range(0, 4)) AS k) UNION ALL SELECT 'diag', k, k, 1.5 + 0.5 * k FROM (SELECT unnest(range(0, 7)) AS k) UNION ALL SELECT 'full', i, j, 2.5 FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 4)) AS j) UNION ALL SELECT 'fun', i, j, i * 10.0 + j FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 4)) AS j) UNION ALL SELECT 'rows', i, j, CAST(i AS DOUBLE) FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 4)) AS j) UNION ALL SELECT 'reshaped', (i * 4 + j) // 6, (i * 4 + j) % 6, i * 10.0 + j FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 4)) AS j) UNION ALL SELECT 'tiled', i, j + 4 * r, i * 10.0 + j FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 4)) AS j), (SELECT unnest(range(0, 2)) AS r) UNION ALL SELECT 'repeated', i, j * 2 + r, i * 10.0 + j FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 4)) AS j), (SELECT unnest(range(0, 2)) AS r) UNION ALL SELECT 'padded', i, j, i * 10.0 + least(greatest(j - 1, 0), 3) FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 7)) AS j) UNION ALL SELECT 'inserted', i, CASE WHEN j = 4 THEN 1 WHEN j >= 1 THEN j + 1 ELSE j END, CASE WHEN j = 4 THEN 9.0 ELSE i * 10.0 + j END FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 5)) AS j) UNION ALL SELECT 'gradient', k, 0, 0.5 FROM (SELECT unnest(range(0, 7)) AS k) UNION ALL SELECT 'ediff', k, 0, 0.5 FROM (SELECT unnest(range(0, 6)) AS k)")
def _create(spark, d):
    line = arrays.arange(spark, 1.5, 5.0, 0.5)
    grid = arrays_more.fromfunction(spark, 3, 4, lambda i, j: i * 10.0 + j)
    column = spark.range(3).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(9.0).alias("v"))
    parts = {
        "arange": line, "linspace": arrays.linspace(spark, 0.0, 2.0, 9), "eye": arrays.eye(spark, 4), "diag": arrays_more.diag(line), "full": arrays.full(spark, 3, 4, 2.5), "fun": grid, "rows": arrays_more.indices(spark, (3, 4)).filter("axis = 0").drop("axis"),
        "reshaped": arrays.reshape(grid, 4, 6), "tiled": arrays_more.tile(grid, "j", 2, 4), "repeated": arrays_more.repeat(grid, "j", 2), "padded": arrays_more.pad(grid, "j", 1, 2, 4), "inserted": arrays_more.insert(grid, "j", 1, column, 1), "gradient": arrays.gradient(line, "i"), "ediff": arrays_more.ediff1d(line),
    }
    return relational.union_all(*(p.select(F.lit(k).alias("what"), F.col("i").cast("long").alias("i"), (F.col("j").cast("long") if "j" in p.columns else F.lit(0).cast("long")).alias("j"), F.col("v").cast("double").alias("v")) for k, p in parts.items()))


@_query("arr_matrices", f"SELECT (SELECT ROUND(SUM(v * v), 3) FROM {_CELLS}) AS squares, true AS qr, true AS svd, true AS inverse, true AS solved, true AS lu, true AS cholesky, true AS fft, true AS close")
def _matrices(spark, d):
    """Factorisations by what they must give back."""
    import numpy as np

    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    size = len(e.first().x)
    q, r = arrays_more.qr(spark, e, "vec_id", "x", size)
    back = arrays_more.apply_gufunc(lambda m: m @ r, q, "vec_id", "x")
    both = back.withColumnRenamed("x", "y").join(e, "vec_id")
    off = both.agg(F.max(F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b)))).alias("m")).first().m
    s, _ = arrays.svd(e, "x", size)
    squares = arrays_more.norm(_cells(spark, d)).select(F.round(F.col("norm") * F.col("norm"), 3).alias("squares"))
    rng = np.random.default_rng(4)
    m = rng.normal(size=(12, 12))
    spd = m @ m.T + 12 * np.eye(12)
    a, b = arrays.from_numpy(spark, spd), arrays.from_numpy(spark, rng.normal(size=(12, 2)))
    inverse = np.allclose(arrays.to_numpy(arrays_more.inv(spark, a)) @ spd, np.eye(12))
    solved = np.allclose(spd @ arrays.to_numpy(arrays_more.solve(spark, a, b)), arrays.to_numpy(b))
    p, low, up = arrays_more.lu(m)
    chol = arrays.to_numpy(arrays_more.cholesky(spark, a))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "r long, x array<double>")
    spectrum = arrays.fft_rows(rows, "r", "x").groupBy("r").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("p")).toPandas().sort_values("r")
    plane = arrays.fft2(rows, "r", "x").toPandas().sort_values(["r", "k"])
    fft = np.allclose(spectrum.p, 12 * (m**2).sum(1)) and np.allclose((plane.re + 1j * plane.im).to_numpy().reshape(12, 12), np.fft.fft2(m))
    flags = {"qr": off < 1e-9, "svd": bool(np.isclose((s**2).sum(), np.trace(r.T @ r))), "inverse": inverse, "solved": solved, "lu": np.allclose(p @ low @ up, m), "cholesky": np.allclose(np.tril(chol) @ np.tril(chol).T, spd), "fft": fft}
    return squares.crossJoin(arrays_more.allclose(a, a).withColumnRenamed("allclose", "close")).select("squares", *(F.lit(bool(v)).alias(k) for k, v in flags.items()), "close")  # one row


# Sources and sinks ----------------------------------------------------------------------------------


def _folder(spark) -> str:
    import uuid

    recursion.settle(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}"


@_query("io_more", "SELECT what, n FROM (SELECT 'parquet' AS what, COUNT(*) AS n FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'json', COUNT(*) FROM customer UNION ALL SELECT 'orc', COUNT(*) FROM customer UNION ALL SELECT 'text', COUNT(*) FROM nation UNION ALL SELECT 'bytes', 1 UNION ALL SELECT 'pipe', COUNT(*) FROM region UNION ALL SELECT 'pandas', 25 UNION ALL SELECT 'array', 6 UNION ALL SELECT 'delayed', 5 UNION ALL SELECT 'demo', 360 UNION ALL SELECT 'csv', COUNT(*) FROM customer UNION ALL SELECT 'store', 25 UNION ALL SELECT 'rows', 25)")
def _io(spark, d):
    import numpy as np

    at, c, n = _folder(spark), _t(spark, d, "customer"), _t(spark, d, "nation")
    io.to_parquet(c, f"{at}/p", partition_on=["c_mktsegment"])
    io.to_json(c, f"{at}/j")
    io.to_orc(c, f"{at}/o")
    io.to_csv(c, f"{at}/c")
    io.to_textfiles(n.select(F.col("n_name").alias("value")), f"{at}/t")
    io.to_csv(_t(spark, d, "region").withColumn("r_comment", F.lit("x")), f"{at}/d", sep="|", header=False)
    relational.store(n, f"{at}/s")
    relational.sink(n)
    first = spark.read.format("binaryFile").load(f"{at}/t").filter("length > 0").limit(1).select("path").first().path
    count = lambda x: x.agg(F.count(F.lit(1)).alias("n"))
    parts = {
        "parquet": count(io.read_parquet(spark, f"{at}/p", columns=["c_custkey", "c_nationkey"], filters=[("c_nationkey", "<", 5)])),
        "json": count(io.read_json(spark, f"{at}/j")), "orc": count(io.read_orc(spark, f"{at}/o")), "text": count(io.read_text(spark, f"{at}/t")), "bytes": count(io.read_bytes(spark, first)), "pipe": count(tables.load_delimited(spark, f"{at}/d", "region")),
        "pandas": count(io.from_pandas(spark, n.toPandas())), "array": count(io.from_array(spark, np.arange(12.0).reshape(6, 2))), "delayed": count(io.from_delayed(spark, [lambda: __import__("pandas").DataFrame({"a": [1, 2]}), lambda: __import__("pandas").DataFrame({"a": [3, 4, 5]})], "a long")), "demo": count(io.demo_timeseries(spark, "2024-01-01", "2024-01-01 01:00:00", 10)),
        "csv": count(io.read_csv(spark, f"{at}/c")), "store": count(spark.read.parquet(f"{at}/s")), "rows": spark.range(len(io.to_records(n))).agg(F.count(F.lit(1)).alias("n")),
    }
    return relational.union_all(*(x.select(F.lit(k).alias("what"), F.col("n").cast("long").alias("n")) for k, x in parts.items()))


@_query("tasks_all", "SELECT unnest(['compute', 'delayed', 'gather', 'persist', 'publish', 'scatter', 'submit', 'visualize', 'temps', 'parallel']) AS what, true AS good")
def _tasks(spark, d):
    """The task interface by what it must give back."""
    n = _t(spark, d, "nation")
    client = tasks.Client(spark)
    try:
        add = tasks.delayed(lambda a, b: a + b)
        client.publish_dataset("nations", n)
        kept = client.persist(n)
        temps = relational.Temps()
        temps.store("t", n)
        temps.append("t", n)
        good = {
            "compute": [len(x) if hasattr(x, "__len__") else x for x in client.compute(n)] != [], "delayed": add(add(1, 2), 3).compute() == 6, "submit": client.submit(lambda x: x * 2, 21).result() == 42, "gather": client.gather(client.map(lambda x: x + 1, [1, 2, 3])) == [2, 3, 4], "persist": kept.count() == 25, "publish": client.get_dataset("nations").count() == 25,
            "scatter": client.scatter([1, 2]) is not None, "visualize": "Scan" in client.visualize(n), "temps": temps.scan("t").count() == 50, "parallel": relational.parallel(lambda: 1, lambda: 2) == [1, 2] and relational.sequence(lambda: 3) == [3],
        }
        kept.unpersist()
    finally:
        client.close()
    return spark.createDataFrame([(k, bool(v)) for k, v in good.items()], "what string, good boolean")


# Statements of the imperative language --------------------------------------------------------------

_program("ml_wildcard", "N = scan(nation); R = scan(region); X = [from N, R where N.n_regionkey = R.r_regionkey emit N.*, R.r_name as r];", "SELECT n.*, r_name AS r FROM nation n, region r WHERE n_regionkey = r_regionkey")
_program("ml_limit_distinct", "N = scan(nation); D = distinct([from N emit n_regionkey as k]); C = cross(D, [from limit([from N emit n_nationkey as m order by m], 2) as L emit m]); X = [from C emit k, m];", "SELECT k, m FROM (SELECT DISTINCT n_regionkey AS k FROM nation), (SELECT n_nationkey AS m FROM nation ORDER BY m LIMIT 2)")



@_query("ml_statements", "SELECT what, n FROM (SELECT 'stored' AS what, COUNT(*) AS n FROM nation WHERE n_regionkey > 1 UNION ALL SELECT 'dumped', COUNT(*) FROM region UNION ALL SELECT 'loaded', COUNT(*) FROM region UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'sampled', 7 UNION ALL SELECT 'countall', COUNT(*) FROM nation UNION ALL SELECT 'bag', 2 * COUNT(*) FROM nation UNION ALL SELECT 'crossed', 25 * 5)")
def _statements(spark, d):
    """STORE, SINK, DUMP, EXPORT, LOAD, EMPTY, SAMPLESCAN, COUNTALL, bag unions and CROSS by the rows that they give."""
    at = _folder(spark)
    lang = Interpreter(spark, {"nation": _t(spark, d, "nation"), "region": _t(spark, d, "region")})
    bound = lang.run(f"""
        N = scan(nation); R = scan(region);
        S = [from N where n_regionkey > 1 emit n_nationkey, n_name];
        store(S, kept); sink(S); dump(R); export(R, '{at}/r');
        E = empty(a:int, b:string);
        P = samplescan(nation, 7, WoR);
        C = countall(N); B = N + N; X = cross(N, R);""")
    again = Interpreter(spark, {"kept": lang.stored["kept"]}).run(f"T = scan(kept); L = load('{at}/r', csv(schema(k:int, name:string), skip=0));")
    count = lambda x: x.agg(F.count(F.lit(1)).alias("n"))
    parts = {"stored": count(again["T"]), "dumped": count(lang.dumped[0]), "loaded": count(again["L"].filter("k is not null")), "empty": count(bound["E"]), "sampled": count(bound["P"]), "countall": bound["C"].toDF("n"), "bag": count(bound["B"]), "crossed": count(bound["X"])}
    return relational.union_all(*(x.select(F.lit(k).alias("what"), F.col("n").cast("long").alias("n")) for k, x in parts.items()))


_program("ml_expressions", "P = scan(part); X = [from P emit p_partkey, -p_size as neg, md5(p_name) as h, byterange(p_name, 1, 4) as piece, greater(p_size, 20) as hi, lesser(p_size, 20) as lo, random() < 2 as coin, worker_id() >= 0 as worker, flip(2) as heads, theanswertolifetheuniverseandeverything() as answer, pow(p_size, 2) as square, head(p_name, 3) as first, tail(p_name, 3) as last, concat(p_brand, p_type) as both];".replace("theanswertolifetheuniverseandeverything", "theansweristolifetheuniverseandeverything"), "SELECT p_partkey, -p_size AS neg, CAST(CAST('0x' || substr(md5(p_name), 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS h, substr(p_name, 2, 3) AS piece, greatest(p_size, 20) AS hi, least(p_size, 20) AS lo, true AS coin, true AS worker, true AS heads, 42 AS answer, CAST(p_size * p_size AS DOUBLE) AS square, left(p_name, 3) AS first, right(p_name, 3) AS last, p_brand || p_type AS both FROM part")
_program("ml_positions", "N = scan(nation); R = scan(region); J = join(N, $2, R, $0); X = [from J emit $0 as n, $4 as r];", "SELECT n_nationkey AS n, r_name AS r FROM nation, region WHERE n_regionkey = r_regionkey")


@_query("ml_python", "SELECT n_nationkey, CAST(length(n_name) * 3 AS BIGINT) AS v FROM nation")
def _python(spark, d):
    lang = Interpreter(spark, {"nation": _t(spark, d, "nation")})
    lang.register_udf("thrice", lambda s: s.str.len() * 3, "long")
    return lang.run("N = scan(nation); X = [from N emit n_nationkey, thrice(n_name) as v];")["X"]


@_query("ra_hypercube", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_quantity > 40")
def _hypercube(spark, d):
    """A join of both sides dealt over a grid: each row of one side meets the other side's rows of its key in one cell."""
    li = _t(spark, d, "lineitem").filter("l_quantity > 40").select("l_orderkey", "l_linenumber")
    return relational.join(relational.shuffle(li, ["l_orderkey"], 6), relational.shuffle(_t(spark, d, "orders"), ["o_orderkey"], 6), F.col("l_orderkey") == F.col("o_orderkey"), ["l_orderkey", "l_linenumber", "o_custkey"])


@_query("io_sql", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, r_name FROM region WHERE r_regionkey > 2")
def _io_sql(spark, d):
    """Written to and read from a database by JDBC: one in the driver's memory, whose jar comes with Spark; executors don't reach it."""
    import uuid

    r = _t(spark, d, "region").select("r_regionkey", "r_name")
    url = f"jdbc:derby:memory:tw{uuid.uuid4().hex};create=true"
    how = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    io.to_sql(r, "regions", url, properties=how, on_driver=True)
    io.to_sql(r.filter("r_regionkey > 2").withColumn("r_regionkey", F.col("r_regionkey") + 100), "regions", url, if_exists="append", properties=how, on_driver=True)
    return recursion.settle(io.read_sql_table(spark, "regions", url, properties=how, on_driver=True)).toDF("r_regionkey", "r_name")


@_query("arr_along", f"SELECT i, ROUND(MAX(v) - MIN(v), 6) AS v FROM {_CELLS} WHERE i < 40 GROUP BY i")
def _along(spark, d):
    return arrays_more.apply_along_axis(_cells(spark, d).filter("i < 40"), "j", lambda x: x.max() - x.min()).select("i", F.round("v", 6).alias("v"))


@_query("arr_elementwise", f"SELECT i, j, v * 3 + 1 AS v, CAST(v <> 0 AS BOOLEAN) AS nonzero, round_even(v, 1) AS rounded, CAST(abs(v - v * 1.000001) <= 1e-8 + 1e-5 * abs(v * 1.000001) AS BOOLEAN) AS close, (i * 32 + j) // 32 AS row, (i * 32 + j) % 32 AS col FROM {_CELLS} WHERE j < 32")
def _elements(spark, d):
    a = _cells(spark, d).filter("j < 32")
    row, col = arrays_more.unravel(F.col("i") * 32 + F.col("j"), (1 << 40, 32))
    out = arrays.elementwise(a, a, lambda x, y: x + 2 * y + 1).withColumnRenamed("v", "w").join(a, ["i", "j"])
    return out.select("i", "j", F.col("w").alias("v"), (F.col("v") != 0).alias("nonzero"), frame.round_half_even("v", 1).alias("rounded"), arrays_more.isclose(F.col("v"), F.col("v") * 1.000001).alias("close"), row.alias("row"), col.alias("col"))


@_query("arr_power_divergence", "SELECT ROUND(SUM((o - e) * (o - e) / e), 5) AS pearson, ROUND(2 * SUM(o * LN(o / e)), 5) AS g FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS o, (SELECT COUNT(*) FROM lineitem) / CAST((SELECT COUNT(DISTINCT l_linenumber) FROM lineitem) AS DOUBLE) AS e FROM lineitem GROUP BY l_linenumber)")
def _divergence(spark, d):
    o = _t(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).cast("double").alias("o"))
    o = o.crossJoin(o.agg(F.avg("o").alias("e")))  # one row
    first, second = (arrays_more.power_divergence(o, "o", "e", p) for p in (1.0, 0.0))
    return first.toDF("pearson").crossJoin(second.toDF("g")).select(F.round("pearson", 5).alias("pearson"), F.round("g", 5).alias("g"))

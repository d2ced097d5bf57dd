"""Operators on literal rows: what the queries over whole tables don't show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalar, ufuncs
from tidewater.operators import arrays, arrays_more, frame, joins, relational, stats, windows
from tidewater.operators.bag import Bag
from tidewater.plans.tasks import Client, delayed
from tidewater.sources import io, tables


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_scalars(spark):
    df = spark.sql("SELECT -7 AS a, 3 AS b, 'hello' AS s, CAST('A' AS BINARY) AS x")
    row = df.select(scalar.idivide("a", "b"), scalar.mod("a", "b"), scalar.safe_div("a", F.lit(0), 9.0), scalar.substr("s", 1, 3), scalar.sequence(F.lit(0)), scalar.ngram("s", 4), scalar.bitset("x")).first()
    assert tuple(row) == (-2, 2, 9.0, "el", [], ["hell", "ello"], [True, False, False, False, False, False, True, False])


def test_ufuncs_against_numpy(spark):
    x = np.array([-1.5, -0.5, 0.25, 0.5, 2.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    for name in ("sqrt", "log"):
        with pytest.raises(Exception, match=".*"):
            ufuncs.apply(name, "x", "x", "x")
    for name in "exp expm1 sin cos tan sinh cosh tanh arctan arcsinh square cbrt floor ceil rint trunc negative absolute degrees radians sign sinc signbit isfinite exp2".split():
        got = [r[0] for r in df.select(ufuncs.apply(name, "x")).collect()]
        assert np.allclose(np.array(got, dtype=float), getattr(np, name)(x).astype(float)), name
    for name in "maximum minimum hypot arctan2 logaddexp copysign power remainder fmod floor_divide".split():
        a = np.abs(x) if name == "power" else x
        d = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, x[::-1])], "a double, b double").coalesce(1)
        got = [r[0] for r in d.select(ufuncs.apply(name, "a", "b")).collect()]
        assert np.allclose(np.array(got, dtype=float), getattr(np, name)(a, x[::-1])), name


def test_ufuncs_of_special_values(spark):
    nan, inf = float("nan"), float("inf")
    x = np.array([nan, inf, -inf, 1e300, -1e300, 2.0**53 + 2, -7.5, 0.0, 5e-324, 1024.0])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, x[::-1]))], "n int, a double, b double").coalesce(1).orderBy("n")
    for name in "floor ceil trunc fix nan_to_num isnan isinf isfinite sign".split():
        got = [r[0] for r in df.select(ufuncs.apply(name, "a")).collect()]
        assert np.array_equal(np.array(got, dtype=float), getattr(np, name)(x).astype(float), equal_nan=True), name
    for name in "maximum minimum fmax fmin nextafter".split():
        got = [r[0] for r in df.select(ufuncs.apply(name, "a", "b")).collect()]
        assert np.array_equal(np.array(got, dtype=float), getattr(np, name)(x, x[::-1]), equal_nan=True), name
    y = np.array([0.0, 1.0, -0.75, 3.0, 1e300, 5e-300, 8.0, -2.0**-30, 123456.789])
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "n int, a double").coalesce(1).orderBy("n")
    got = d.select(ufuncs.apply("frexp", "a").alias("f"), ufuncs.apply("modf", "a").alias("m")).collect()
    m, e = np.frexp(y)
    assert [r.f.mantissa for r in got] == m.tolist() and [r.f.exponent for r in got] == e.tolist()
    f, w = np.modf(y)
    assert [r.m.fraction for r in got] == f.tolist() and [r.m.whole for r in got] == w.tolist()
    z = np.array([0.0, 0.5, -3.0, 20.0, 300.0])
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "n int, a double").coalesce(1).orderBy("n")
    assert np.allclose([r[0] for r in d.select(ufuncs.apply("i0", "a")).collect()], np.i0(z), rtol=1e-12)


def test_merge_with_nulls_suffixes_and_indicator(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "p"), (3, "q"), (None, "r")], "k long, v string")
    got = values(joins.merge(a, b, "outer", on="k", indicator="m"), "k", "v_x", "v_y", "m")
    assert sorted(got, key=repr) == sorted([(1, "x", "p", "both"), (2, "y", None, "left_only"), (None, "z", None, "left_only"), (3, None, "q", "right_only"), (None, None, "r", "right_only")], key=repr)


def test_grouping_drops_null_keys(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (None, 5.0)], "k long, v double")
    assert values(stats.reduce(df, {"v": ["sum", "count", "nunique"]}, ["k"]), "k", "v_sum", "v_count", "v_nunique") == [(1, 2.0, 1, 1)]
    assert len(values(stats.reduce(df, {"v": ["sum", "nunique"]}, ["k"], dropna=False), "k", "v_sum")) == 2


def test_rolling_and_unbiased_moments(spark):
    pd = pytest.importorskip("pandas")
    v = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 1.0]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "g long, i long, v double")
    r = windows.Rolling(["g"], ["i"], rows=5)
    got = df.select("i", r.skew("v").alias("s"), r.kurt("v").alias("k"), r.quantile("v", 0.3).alias("q"), r.var("v").alias("x")).orderBy("i").toPandas()
    want = pd.Series(v).rolling(5)
    for c, w in (("s", want.skew()), ("k", want.kurt()), ("q", want.quantile(0.3)), ("x", want.var())):
        assert np.allclose(got[c].astype(float), w, equal_nan=True), c


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 6])
def test_centred_windows(spark, rows):
    pd = pytest.importorskip("pandas")
    v = [float(i * i % 11) for i in range(12)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "g long, i long, v double")
    r = windows.Rolling(["g"], ["i"], rows=rows, center=True)
    got = df.select("i", r.sum("v").alias("s"), r.median("v").alias("m")).orderBy("i").toPandas()
    want = pd.Series(v).rolling(rows, center=True)
    assert np.allclose(got["s"].astype(float), want.sum(), equal_nan=True) and np.allclose(got["m"].astype(float), want.median(), equal_nan=True)


def test_histogram_has_all_bins(spark):
    v = [0.5, 0.5, 9.5, 10.0, 3.0]
    got = arrays.histogram(spark.createDataFrame([(x,) for x in v], "v double"), 10, 0.0, 10.0)
    assert [n for _, n in values(got, "bin", "n")] == np.histogram(v, 10, (0, 10))[0].tolist()


def test_bloom_filter_loses_nothing(spark):
    primary = spark.range(0, 30_000, 3).withColumnRenamed("id", "p").repartition(5)
    foreign = spark.range(60_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("f"))
    got = {r.f for r in joins.bloom_semi(foreign, "f", primary, "p").collect()}
    real = {x for x in range(0, 30_000, 3) if x % 1000 != 7}
    assert real <= got and len(got) < 1.05 * len(real)


def test_ranges_of_keys(spark):
    index = spark.createDataFrame([(0, 10, 20, 5), (1, 15, 30, 5), (2, 50, 60, 5)], "part int, begin long, end long, n long")
    keys = spark.createDataFrame([(x,) for x in (9, 10, 30, 31, 49, 55, 61, None)], "k long")
    assert [r.k for r in joins.clean_foreign(keys, "k", index).orderBy("k").collect()] == [10, 30, 55]
    assert [r.k for r in joins.clean_foreign(keys, "k", index, most=1).orderBy("k").collect()] == [10, 30, 31, 49, 55]


def test_neighbours_against_numpy(spark):
    from tidewater.operators import neighbours

    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(200, 3)).round(1), rng.normal(size=(30, 3)).round(1)
    frame_ = lambda m: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(m)], "id long, a double, b double, c double").repartition(3)
    for block in (4096, 7):
        got = values(neighbours.nearest(frame_(x), frame_(q), "id", ["a", "b", "c"], 4, block), "query", "rank", "id")
        want = [(i, r + 1, int(j)) for i, v in enumerate(q) for r, j in enumerate(np.lexsort((np.arange(200), sum((x[:, k] - v[k]) ** 2 for k in range(3))))[:4])]
        assert got == sorted(want, key=repr)


def test_ill_conditioned_qr_and_transforms(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 6))
    a[:, 5] = a[:, 0] + 1e-9 * a[:, 5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>").repartition(5)
    q, r = arrays_more.qr(spark, rows, "id", "v", 6, fan=2)
    m = np.array([z.v for z in q.orderBy("id").collect()])
    assert np.allclose(m @ r, a, atol=1e-12) and np.allclose(np.triu(r), r)
    q, r = arrays_more.sfqr(spark, spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(a[:4].T)], "id long, v array<double>"), "id", "v", 4)
    assert np.allclose(q @ np.array([z.v for z in r.orderBy("id").collect()]).T, a[:4])
    for kind in ("fft", "ifft", "rfft", "hfft", "irfft"):
        got = arrays.fft_rows(rows.filter("id < 3"), "id", "v", kind).orderBy("id", "k").toPandas()
        want = getattr(np.fft, kind)(a[:3])
        assert np.allclose((got.re + 1j * got.im).to_numpy().reshape(want.shape), want), kind


def test_frame_as_text(spark):
    df = spark.createDataFrame([(i, f"row {i}") for i in range(20)], "id long, s string")
    text = frame.to_string(df, ["id"], 2)
    assert [x in text for x in ("row 0", "row 1", "row 2", "row 17", "row 18", "row 19")] == [True, True, False, False, True, True]
    assert "<td>row 0</td>" in frame.to_html(df, ["id"], 1)
    with pytest.raises(Exception, match="length one"):
        arrays_more.squeeze(arrays.from_numpy(spark, np.ones((2, 2))), "i").collect()
    assert values(arrays_more.squeeze(arrays.from_numpy(spark, np.array([[4.0, 5.0]])), "i"), "j", "v") == [(0, 4.0), (1, 5.0)]
    assert values(arrays_more.dstack([arrays.eye(spark, 1), arrays.eye(spark, 1)]), "i", "j", "k", "v") == [(0, 0, 0, 1.0), (0, 0, 1, 1.0)]


def test_frame_pieces(spark):
    df = spark.createDataFrame([(1, "a b", [1, 2], 2.5), (2, None, None, float("nan"))], "id long, s string, l array<long>, x double")
    assert values(frame.explode(df.select("id", "l"), "l"), "id", "l") == [(1, 1), (1, 2), (2, None)]
    assert [r[0] for r in df.select(frame.isnull(df, "x")).collect()] == [False, True]
    assert df.select(frame.cat(["s", "s"], "-").alias("c")).first().c == "a b-a b"
    assert [r.code for r in frame.codes(df, "s").orderBy("id").collect()] == [0, -1]
    assert frame.select_dtypes(df, ("number",)).columns == ["id", "x"]
    assert values(frame.combine(df.select("id", "x"), df.select((F.col("id") + 1).alias("id"), "x"), "id", lambda a, b: a + b, 0.0).filter("id = 1"), "x") == [(2.5,)]
    assert df.select(frame.text("s", "split", " ", 1)).first()[0] == ["a", "b"]


def test_arrays_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 3)), rng.normal(size=(3, 2))
    x, y = arrays.from_numpy(spark, a), arrays.from_numpy(spark, b)
    assert np.allclose(arrays.to_numpy(arrays.matmul(x, y)), a @ b)
    assert np.allclose(arrays.to_numpy(arrays_more.einsum("ij,kj->ik", x, x)), a @ a.T)
    assert np.allclose(arrays.to_numpy(arrays.cumulate(x, "sum", "j")), a.cumsum(1))
    assert np.allclose(arrays.to_numpy(arrays.diff(x, "i")), np.diff(a, axis=0))
    assert np.allclose(arrays.to_numpy(arrays.gradient(x, "i")), np.gradient(a, axis=0))
    assert np.allclose(arrays.to_numpy(arrays.roll(x, "i", 1, 4)), np.roll(a, 1, 0))
    assert np.allclose(arrays.to_numpy(arrays.reshape(x, 3, 6)), a.reshape(2, 6))
    assert np.allclose(arrays.to_numpy(arrays_more.pad(x, "i", 1, 2, 4)), np.pad(a, ((1, 2), (0, 0)), "edge"))
    assert np.allclose(arrays.to_numpy(arrays_more.block([[x, x], [x, x]], [4, 4], [3, 3])), np.block([[a, a], [a, a]]))
    assert np.allclose(arrays.to_numpy(arrays_more.inv(spark, arrays.from_numpy(spark, a[:3]))), np.linalg.inv(a[:3]))
    assert {r.i: r.argmax for r in arrays.arg(x, "max", "j").collect()} == dict(enumerate(a.argmax(1).tolist()))
    p, low, u = arrays_more.lu(a[:3])
    assert np.allclose(p @ low @ u, a[:3])
    assert arrays_more.allclose(x, x).first()[0] and not arrays_more.allclose(x, arrays.transpose(x)).first()[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    q, r = arrays_more.qr(spark, rows, "id", "v", 3)
    m = np.array([z.v for z in q.orderBy("id").collect()])
    assert np.allclose(m @ r, a) and np.allclose(m.T @ m, np.eye(3))
    assert np.allclose(arrays.svd(rows, "v", 3)[0], np.linalg.svd(a)[1])


def test_qr_where_partitions_have_no_rows(spark):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(9, 3)))], "id long, v array<double>")
    a = np.array([x.v for x in rows.orderBy("id").collect()])
    spread = rows.repartitionByRange(4, "id").filter("id < 3 or id > 6")
    q, r = arrays_more.qr(spark, spread, "id", "v", 3, fan=2)
    left = np.array([x.v for x in q.orderBy("id").collect()])
    assert np.allclose(left @ r, np.delete(a, [3, 4, 5, 6], axis=0)) and np.allclose(left.T @ left, np.eye(3))
    q, r = arrays_more.qr(spark, rows.filter("id < 0"), "id", "v", 3)
    assert q.count() == 0 and r.shape == (0, 3)


def test_bags(spark):
    b = Bag.from_sequence(spark, [3, 1, 2, 2], "long")
    assert [r.value for r in b.topk(2).collect()] == [3, 2] and b.sum().first()[0] == 8 and sorted(b.distinct().take(9)) == [1, 2, 3]
    assert values(b.foldby(lambda v: v % 2, lambda v: F.sum(v)), "key", "value") == [(0, 4), (1, 4)]
    assert Bag.from_sequence(spark, ["ab", "a_c", "xyz"], "string").glob("a?").take(5) == ["ab"]


def test_relational_pieces(spark):
    df = spark.range(100).toDF("a")
    assert relational.sample_scan(df, 10, replace=False).count() == 10 and relational.empty(spark, "a int").count() == 0
    assert relational.hypercube_shuffle(df, {"a": 0}, [2, 3]).count() == 300
    assert relational.parallel(lambda: df.count(), lambda: 1) == [100, 1]
    t = relational.Temps()
    t.append("tw_t", df)
    t.append("tw_t", df)
    assert t.scan("tw_t").count() == 200


def test_tables_and_text(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0|none\n1|ARGENTINA|1|some\n")
    got = tables.load_delimited(spark, str(tmp_path / "nation.tbl"), "nation", ["n_name", "n_regionkey"])
    assert values(got, "n_name", "n_regionkey") == [("ALGERIA", 0), ("ARGENTINA", 1)]
    with pytest.raises(KeyError):
        tables.load_delimited(spark, "x", "nothing")
    (tmp_path / "o.csv").write_text("made by hand\n\ndepth;place\n40.5;^pier; north^\n7.25;^under %^the%^ bridge^\n")
    got = io.read_csv(spark, str(tmp_path / "o.csv"), "depth double, place string", sep=";", quote="^", escape="%", skip=3)
    assert values(got, "depth", "place") == [(40.5, "pier; north"), (7.25, "under ^the^ bridge")]
    (tmp_path / "f.txt").write_text("ab  12\ncd   7\n")
    assert values(io.read_fwf(spark, str(tmp_path / "f.txt"), {"s": (0, 2, "string"), "n": (2, 6, "int")}), "s", "n") == [("ab", 12), ("cd", 7)]
    assert tables.join_keys("orders", "customer") == ("customer", "c_custkey", "o_custkey") and tables.column_at("region", 1) == "r_name"


def test_tasks(spark):
    calls = []
    one = delayed(lambda: calls.append(1) or 1)()
    assert delayed(lambda a, b: a + b)(one, one).compute() == 2 and calls == [1]
    c = Client(spark)
    assert c.gather(c.map(lambda n: spark.range(n).count(), [3, 5])) == [3, 5]
    c.publish_dataset("tw_published", spark.range(4))
    assert c.get_dataset("tw_published").count() == 4 and "Physical Plan" in c.visualize(spark.range(1))
    c.close()


def test_streaming_buckets(spark, tmp_path):
    from tidewater.streaming import buckets

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.select("ts", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    out = buckets.tumbling(stream, "ts", "1 day", "1 hour", {"n": F.count(F.lit(1))})
    q = out.writeStream.outputMode("complete").format("memory").queryName("tw_buckets").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tw_buckets").agg(F.sum("n")).first()[0] == src.count()


def test_sql_through_the_driver_gives_all_rows(spark, monkeypatch):
    """Nulls, several types and several batches come back whole, and so does what is appended."""
    import datetime
    import uuid
    from decimal import Decimal

    from tidewater.sources import io

    monkeypatch.setattr(io, "SQL_ROWS", 4)
    rows = [(i, None if i == 3 else f"n{i}", i / 8, Decimal(f"{i}.25"), datetime.date(2020, 1, 1 + i), None if i == 5 else i % 2 == 0) for i in range(11)]
    df = spark.createDataFrame(rows, "k long, name string, x double, d decimal(8,2), day date, even boolean").repartition(3)
    url, how = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    io.to_sql(df.limit(0), "t", url, properties=how, on_driver=True)
    assert io.read_sql_table(spark, "t", url, properties=how, on_driver=True).count() == 0
    io.to_sql(df, "t", url, if_exists="append", properties=how, on_driver=True)
    io.to_sql(df.filter("k = 3"), "t", url, if_exists="append", properties=how, on_driver=True)
    got = io.read_sql_table(spark, "t", url, properties=how, on_driver=True)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted([*rows, rows[3]], key=lambda r: r[0])


def test_nearest_looks_only_within_reach(spark, monkeypatch):
    """Against all pairs, with ties, equal rows, few training rows and a constant first feature."""
    import numpy as np

    from tidewater.operators import neighbours

    r = np.random.default_rng(6)
    monkeypatch.setattr(neighbours, "CHUNK", 5)
    for n, flat in ((300, False), (300, True), (1, False)):
        points = [(i, 0.0 if flat else float(r.integers(0, 40)), float(r.integers(0, 3))) for i in range(n + 60)]
        df = spark.createDataFrame(points, "id long, a double, b double").repartition(3)
        got = neighbours.nearest(df.filter(f"id < {n}"), df.filter(f"id >= {n}"), "id", ["a", "b"], 2, block=25).collect()
        want = []
        for i, a, b in points[n:]:
            near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, x, y in points[:n])[:2]
            want += [(i, at + 1, j, d) for at, (d, j) in enumerate(near)]
        assert sorted(map(tuple, got)) == want
    some = r.normal(size=(500, 2))
    assert (neighbours._reach(some[:9], some, 2) < 1).all()

"""Joins of the frame interface: merges, as-of joins, joins over sparse range indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on: list[str] | str | None = None, left_on: list[str] | str | None = None, right_on: list[str] | str | None = None, suffixes: tuple[str, str] = ("_x", "_y"), indicator: str | None = None) -> DataFrame:
    """An equi-join; other columns that clash get suffixes, keys of the same name are one column.

    Null keys match nothing. indicator: a column that says left_only, right_only or both.
    """
    lk = [left_on] if isinstance(left_on, str) else left_on or ([on] if isinstance(on, str) else on) or [c for c in left.columns if c in right.columns]
    rk = [right_on] if isinstance(right_on, str) else right_on or lk
    shared = {a for a, b in zip(lk, rk) if a == b}
    clash = (set(left.columns) & set(right.columns)) - shared
    a = left.select(*(F.col(c).alias(f"l{i}_") for i, c in enumerate(left.columns)), F.lit(True).alias("in_left_"))
    b = right.select(*(F.col(c).alias(f"r{i}_") for i, c in enumerate(right.columns)), F.lit(True).alias("in_right_"))
    cond: Column = F.lit(True)
    for x, y in zip(lk, rk):
        cond = cond & (F.col(f"l{left.columns.index(x)}_") == F.col(f"r{right.columns.index(y)}_"))
    out = a.join(b, cond, {"outer": "full", "left": "left", "right": "right", "inner": "inner"}[how])
    cols = []
    for i, c in enumerate(left.columns):
        v = F.col(f"l{i}_")
        cols.append(F.coalesce(v, F.col(f"r{right.columns.index(c)}_")).alias(c) if c in shared else v.alias(c + suffixes[0] if c in clash else c))
    cols += [F.col(f"r{i}_").alias(c + suffixes[1] if c in clash else c) for i, c in enumerate(right.columns) if c not in shared]
    if indicator:
        cols.append(F.when(F.col("in_right_").isNull(), "left_only").when(F.col("in_left_").isNull(), "right_only").otherwise("both").alias(indicator))
    return out.select(*cols)


def semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def merge_asof(left: DataFrame, right: DataFrame, on: str, by: list[str] | str | None = None, right_columns: list[str] | None = None, direction: str = "backward", allow_exact: bool = True, tolerance=None, suffix: str = "_y") -> DataFrame:
    """Each left row with the right row of its group whose key is nearest in the direction.

    Both sides are put in one table, sorted by group and key once, and the last (or next) right row
    is carried along a window: one shuffle by group, no pairs. Of right rows with equal keys the one
    with the greatest other columns is taken. Rows with a null key find nothing. Without `by`
    there's one group: then rows are dealt by ranges of the key, and what is carried over a range's
    border comes from a table with one row for each range.
    """
    by = [by] if isinstance(by, str) else by or []
    take = right_columns or [c for c in right.columns if c not in (*by, on)]
    names = {c: c + suffix if c in left.columns else c for c in take}
    a = left.select(F.struct(*left.columns).alias("l_"), *(F.col(c).alias(f"by{i}_") for i, c in enumerate(by)), F.col(on).alias("k_"), F.lit(1).alias("side_"), F.lit(None).alias("r_"))
    rkey = F.struct(F.col(on).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(take)))
    b = right.filter(F.col(on).isNotNull()).select(F.lit(None).alias("l_"), *(F.col(c).alias(f"by{i}_") for i, c in enumerate(by)), F.col(on).alias("k_"), F.lit(0).alias("side_"), rkey.alias("r_"))
    both = a.unionByName(b)
    keys = [f"by{i}_" for i in range(len(by))]

    def carried(forward: bool) -> Column:
        # exact matches count if right rows of the same key come before the left ones (or after them, forward)
        first = (not forward) == allow_exact
        side = F.col("side_").asc() if first else F.col("side_").desc()
        order = [F.col("k_").asc(), side, F.col("r_").asc()]
        if keys:
            w = Window.partitionBy(*keys).orderBy(*order)
            frame = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
            return (F.first if forward else F.last)("r_", ignorenulls=True).over(frame)
        raise AssertionError

    if not keys:
        return _asof_ranges(both, names, take, left, on, direction, allow_exact, tolerance)
    wanted = {"backward": (False,), "forward": (True,), "nearest": (False, True)}[direction]
    out = both.select("*", *(carried(f).alias("f_" if f else "b_") for f in wanted)).filter("side_ = 1")
    return _asof_finish(out, names, take, left, direction, tolerance)


def _asof_finish(out: DataFrame, names: dict, take: list[str], left: DataFrame, direction: str, tolerance) -> DataFrame:
    times = dict(out.dtypes)["k_"].startswith("timestamp")
    _number = lambda c: (c.cast("timestamp") if times else c).cast("double")  # noqa: E731  seconds for times
    if direction == "nearest":
        dist = lambda c: F.abs(_number(F.col("k_")) - _number(F.col(f"{c}.k")))
        hit = F.when(F.col("f_").isNull() | (dist("b_") <= dist("f_")), F.coalesce("b_", "f_")).otherwise(F.col("f_"))
    else:
        hit = F.col("f_" if direction == "forward" else "b_")
    out = out.withColumn("hit_", F.when(F.col("k_").isNotNull(), hit))
    if tolerance is not None:
        out = out.withColumn("hit_", F.when(F.abs(_number(F.col("k_")) - _number(F.col("hit_.k"))) <= tolerance, F.col("hit_")))
    return out.select(*(F.col("l_")[c].alias(c) for c in left.columns), *(F.col("hit_")[f"c{i}"].alias(names[c]) for i, c in enumerate(take)))


def _asof_ranges(both: DataFrame, names, take, left, on, direction, allow_exact, tolerance) -> DataFrame:
    """One group: ranges of the key, a window within each, and a summary row of each range before (or after) it."""
    from tidewater.plans.recursion import settle

    dealt = settle(both.filter("k_ is not null").repartitionByRange("k_").withColumn("part_", F.spark_partition_id()))
    edges = dealt.groupBy("part_").agg(F.max(F.when(F.col("side_") == 0, F.col("r_"))).alias("last_"), F.min(F.when(F.col("side_") == 0, F.col("r_"))).alias("first_"))
    # one row for each range: as many as there are partitions
    w = Window.orderBy("part_")
    before = F.last("last_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first_", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    edges = edges.select("part_", before.alias("before_"), after.alias("after_"))
    out = dealt.join(F.broadcast(edges), "part_")

    def carried(forward: bool) -> Column:
        first = (not forward) == allow_exact
        side = F.col("side_").asc() if first else F.col("side_").desc()
        w = Window.partitionBy("part_").orderBy(F.col("k_").asc(), side, F.col("r_").asc())
        frame = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
        return F.coalesce((F.first if forward else F.last)("r_", ignorenulls=True).over(frame), F.col("after_" if forward else "before_"))

    wanted = {"backward": (False,), "forward": (True,), "nearest": (False, True)}[direction]
    out = out.select("*", *(carried(f).alias("f_" if f else "b_") for f in wanted)).filter("side_ = 1")
    done = _asof_finish(out, names, take, left, direction, tolerance)
    lost = both.filter("side_ = 1 and k_ is null").select(*(F.col("l_")[c].alias(c) for c in left.columns))
    return done.unionByName(lost, allowMissingColumns=True)


#: Bits of a Bloom filter at most: 32 MB.
BLOOM_BITS = 1 << 28


# Sparse range indexes ------------------------------------------------------------------------------


def sparse_index(df: DataFrame, key: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """df dealt by ranges of the key, with its range number `part`, and (part, begin, end, n) of each range."""
    from tidewater.plans.recursion import settle

    dealt = settle((df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)).withColumn("part", F.spark_partition_id()))
    return dealt, dealt.groupBy("part").agg(F.min(key).alias("begin"), F.max(key).alias("end"), F.count(F.lit(1)).alias("n"))


def index_probe(index: DataFrame, value) -> DataFrame:
    """Ranges that may hold a key."""
    return index.filter((F.col("begin") <= F.lit(value)) & (F.col("end") >= F.lit(value)))


def merge_boundaries(index: DataFrame) -> DataFrame:
    """(begin, end, parts): ranges that touch or overlap joined into one, with all their parts."""
    w = Window.orderBy("begin", "end")
    start = (F.col("begin") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    run = index.withColumn("run", F.sum(F.coalesce(start, F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_sort(F.collect_set("part")).alias("parts")).drop("run")


def clean_foreign(foreign: DataFrame, key: str, index: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows whose key lies in some range. Ranges that touch are joined first; of more than `most`, only the whole span counts."""
    ranges = [(r["begin"], r["end"]) for r in merge_boundaries(index).orderBy("begin").limit(most + 1).collect()]
    if not ranges:
        return foreign.limit(0)
    if len(ranges) > most:
        low, high = index.agg(F.min("begin"), F.max("end")).first()
        ranges = [(low, high)]
    begins, ends = (F.array(*(F.lit(x) for x in xs)) for xs in zip(*ranges))
    if len(ranges) == 1:
        return foreign.filter(F.col(key).between(*ranges[0]))
    last = F.aggregate(begins, F.lit(-1), lambda a, b: a + (b <= F.col(key)).cast("int"))
    return foreign.filter((last >= 0) & (F.col(key) <= F.get(ends, last)))


def range_routed_join(foreign: DataFrame, foreign_key: str, primary: DataFrame, primary_key: str) -> DataFrame:
    """An equi-join whose foreign rows outside all key ranges of the primary side go before the shuffle."""
    _, index = sparse_index(primary.select(primary_key), primary_key)
    return clean_foreign(foreign, foreign_key, index).join(primary, F.col(foreign_key) == F.col(primary_key))


def bloom_semi(foreign: DataFrame, foreign_key: str, primary: DataFrame, primary_key: str) -> DataFrame:
    """Foreign rows that may have a partner, by a Bloom filter of the primary keys; all that have one are among them.

    The filter has 16 bits a key, BLOOM_BITS at most, so that its size is bounded; it is merged in a tree and broadcast.
    """
    import numpy as np
    import pandas as pd

    bits = min(BLOOM_BITS, 1 << (16 * max(64, primary.count()) - 1).bit_length())
    places = lambda c: [F.pmod(F.xxhash64(F.col(c), F.lit(i)), F.lit(bits)).alias(f"p{i}") for i in range(4)]

    def marked(batches):
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            flat = b.to_numpy().ravel()
            np.bitwise_or.at(held, flat >> 3, (1 << (flat & 7)).astype(np.uint8))
        yield pd.DataFrame({"m": [held.tobytes()]})

    def merged(batches):
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for m in b["m"]:
                held |= np.frombuffer(m, np.uint8)
        yield pd.DataFrame({"m": [held.tobytes()]})

    keys = primary.filter(F.col(primary_key).isNotNull()).select(*places(primary_key))
    parts = keys.rdd.getNumPartitions()
    filled = keys.mapInPandas(marked, "m binary")
    while parts > 1:
        parts = -(-parts // 16)
        filled = filled.coalesce(parts).mapInPandas(merged, "m binary")
    sent = foreign.sparkSession.sparkContext.broadcast(b"".join(r[0] for r in filled.collect()))

    def probed(*at):
        held = np.frombuffer(sent.value, np.uint8)
        return pd.Series(np.logical_and.reduce([held[x.to_numpy() >> 3] >> (x.to_numpy() & 7) & 1 for x in at]).astype(bool))

    may = F.pandas_udf(lambda a, b, c, d: probed(a, b, c, d), "boolean")
    return foreign.filter(F.col(foreign_key).isNotNull()).filter(may(*places(foreign_key)))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, begin: str, end: str, width: float) -> DataFrame:
    """Points with all intervals that hold them: both sides meet in buckets of the width given."""
    a = points.withColumn("bucket_", F.floor(F.col(at) / F.lit(width)))
    b = intervals.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(begin) / F.lit(width)), F.floor(F.col(end) / F.lit(width)))))
    return a.join(b, "bucket_").filter((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end))).drop("bucket_")


def concat(parts: list[DataFrame], join: str = "outer") -> DataFrame:
    """Rows of all parts by column name; inner: only columns that all have."""
    if join == "inner":
        common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        parts = [p.select(*common) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def concat_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both side by side, rows matched by key."""
    return left.join(right, key, "full")


def combine_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left's values, right's where they are null or the row is missing."""
    out = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, d in (("l", left), ("r", right)) if c in d.columns)).alias(c)
    return out.select(*map(pick, names))

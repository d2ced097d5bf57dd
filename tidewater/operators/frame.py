"""Row-wise operators of the frame interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def select_dtypes(df: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Columns by type name; `number` stands for all numbers."""

    def of(t: str, kinds: tuple[str, ...]) -> bool:
        return any(t.startswith(NUMERIC) if k == "number" else t.startswith(k) for k in kinds)

    return df.select(*(c for c, t in df.dtypes if (not include or of(t, include)) and not of(t, exclude)))


def assign(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.withColumns({n: F.expr(c) if isinstance(c, str) else c for n, c in columns.items()})


def rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(columns)


def drop(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def pop(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    return df.select(column), df.drop(column)


def query(df: DataFrame, text: str) -> DataFrame:
    return df.filter(text)


def evaluate(df: DataFrame, **texts: str) -> DataFrame:
    return df.withColumns({n: F.expr(t) for n, t in texts.items()})


def where(c: str, condition: Column, other=None) -> Column:
    return F.when(condition, F.col(c)).otherwise(F.lit(other))


def mask(c: str, condition: Column, other=None) -> Column:
    return F.when(condition, F.lit(other)).otherwise(F.col(c))


def isin(c: str, values: list) -> Column:
    """False, not null, for nulls."""
    return F.coalesce(F.col(c).isin(values), F.lit(False))


def between(c: str, low, high, inclusive: bool = True) -> Column:
    return F.col(c).between(low, high) if inclusive else (F.col(c) > low) & (F.col(c) < high)


def isnull(df: DataFrame, c: str) -> Column:
    """Null or, for floats, NaN."""
    floats = dict(df.dtypes)[c] in ("float", "double")
    return F.col(c).isNull() | F.isnan(c) if floats else F.col(c).isNull()


def notnull(df: DataFrame, c: str) -> Column:
    return ~isnull(df, c)


def fillna(df: DataFrame, value, subset: list[str] | None = None) -> DataFrame:
    return df.fillna(value, subset)


def ffill(c: str, partition: list[str], order: list[str], limit: int | None = None) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(c, ignorenulls=True).over(w)


def bfill(c: str, partition: list[str], order: list[str], limit: int | None = None) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(0, Window.unboundedFollowing if limit is None else limit)
    return F.first(c, ignorenulls=True).over(w)


def dropna(df: DataFrame, how: str = "any", subset: list[str] | None = None, thresh: int | None = None) -> DataFrame:
    return df.dropna(how, thresh, subset)


def replace(c: str, mapping: dict) -> Column:
    out: Column | None = None
    for old, new in mapping.items():
        hit = F.col(c) == F.lit(old)
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    return F.col(c) if out is None else out.otherwise(F.col(c))


def replace_regex(c: str, pattern: str, new: str) -> Column:
    return F.regexp_replace(c, pattern, new)


def astype(c: str, kind: str) -> Column:
    return F.col(c).cast(kind)


def clip(c: str, lower=None, upper=None) -> Column:
    """Nulls stay null."""
    out = F.col(c)
    if lower is not None:
        out = F.when(out < lower, F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, F.lit(upper)).otherwise(out)
    return out


def round_half_even(c: str, digits: int = 0) -> Column:
    return F.bround(c, digits)


def map_values(c: str, mapping: dict) -> Column:
    """Values by a literal map; null where it has none."""
    return F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[F.col(c)]


def apply_series(df: DataFrame, c: str, func: Callable, returns: str, out: str) -> DataFrame:
    """func on pandas Series, batch by batch."""
    return df.withColumn(out, F.pandas_udf(func, returns)(F.col(c)))


def apply_rows(df: DataFrame, func: Callable, returns: str, out: str) -> DataFrame:
    """func on each row as a dict; by Arrow batches. Python runs once a row: where func has a columnwise form, use applymap or assign."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` {returns}"

    def run(batches: Iterator):
        for b in batches:
            yield b.assign(**{out: [func(r) for r in b.to_dict("records")]})

    return df.mapInPandas(run, schema)


def applymap(df: DataFrame, func: Callable[[Column], Column]) -> DataFrame:
    """A column expression on every column."""
    return df.select(*(func(F.col(c)).alias(c) for c in df.columns))


def map_partitions(df: DataFrame, func: Callable, schema: str) -> DataFrame:
    """func on pandas frames, batch by batch."""

    def run(batches: Iterator):
        for b in batches:
            yield func(b)

    return df.mapInPandas(run, schema)


def map_overlap(df: DataFrame, func: Callable, schema: str, partition: list[str], order: list[str], before: int, after: int) -> DataFrame:
    """func on each group's sorted pandas frame with its neighbours at hand: func(frame, before, after)."""
    return df.groupBy(*partition).applyInPandas(lambda p: func(p.sort_values(order), before, after), schema)


def map_overlap_ordered(df: DataFrame, func: Callable, schema: str, order: list[str], before: int, after: int, partitions: int | None = None) -> DataFrame:
    """func on pandas frames of the rows in order, each with the `before` rows ahead of it and the `after` rows behind it.

    func gives a row for each row that it gets; those of the rows ahead and behind are dropped again.
    """
    from tidewater.operators.windows import overlapped

    rows = overlapped(df, order, before, after, partitions)
    names = df.columns

    def run(p):
        p = p.sort_values("pos_")
        found, own = func(p[names].reset_index(drop=True)), ~p["halo_"].to_numpy()
        if len(found) != len(own):
            raise ValueError("func must give a row for each row")
        return found[own]

    return rows.groupBy("part_").applyInPandas(run, schema)


def pipe(df: DataFrame, func: Callable, *args, **kwargs) -> DataFrame:
    return df.transform(func, *args, **kwargs)


def explode(df: DataFrame, c: str) -> DataFrame:
    return df.select(*(F.explode_outer(x).alias(x) if x == c else x for x in df.columns))


def to_datetime(c: str, fmt: str | None = None) -> Column:
    return F.to_timestamp_ntz(F.col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")


def to_timedelta(c: str, unit: str = "seconds") -> Column:
    n = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}[unit]
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(c) * n)


def to_numeric(c: str, kind: str = "double") -> Column:
    """Null where the text is no number."""
    return F.col(c).try_cast(kind)


def loc(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Rows whose key lies in the closed range; pushed to the scan."""
    if low is not None:
        df = df.filter(F.col(key) >= F.lit(low))
    return df.filter(F.col(key) <= F.lit(high)) if high is not None else df


def iloc(df: DataFrame, *positions: int) -> DataFrame:
    return df.select(*(df.columns[p] for p in positions))


def dt(c: str, field: str) -> Column:
    """Fields of a timestamp as the frame interface counts them: Monday is 0."""
    fields = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "dayofyear": F.dayofyear, "quarter": F.quarter, "week": F.weekofyear,
        "dayofweek": F.weekday, "weekday": F.weekday, "date": F.to_date, "days_in_month": lambda x: F.dayofmonth(F.last_day(x)), "day_name": lambda x: F.date_format(x, "EEEE"), "month_name": lambda x: F.date_format(x, "MMMM"),
        "is_month_start": lambda x: F.dayofmonth(x) == 1, "is_month_end": lambda x: F.to_date(x) == F.last_day(x), "is_quarter_start": lambda x: (F.dayofmonth(x) == 1) & (F.month(x) % 3 == 1), "is_quarter_end": lambda x: (F.to_date(x) == F.last_day(x)) & (F.month(x) % 3 == 0),
        "is_year_start": lambda x: F.dayofyear(x) == 1, "is_year_end": lambda x: (F.month(x) == 12) & (F.dayofmonth(x) == 31), "is_leap_year": lambda x: F.dayofmonth(F.last_day(F.make_date(F.year(x), F.lit(2), F.lit(1)))) == 29, "microsecond": lambda x: F.expr(f"extract(microsecond from `{x}`)") if isinstance(x, str) else F.date_format(x, "SSSSSS").cast("int"),
    }
    return fields[field](F.col(c))


def dt_floor(c: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(c)).cast("timestamp_ntz")


def text(c: str, method: str, *args) -> Column:
    """String methods of the frame interface."""
    x = F.col(c)
    methods = {
        "lower": lambda: F.lower(x), "upper": lambda: F.upper(x), "title": lambda: F.initcap(x), "capitalize": lambda: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2)))), "swapcase": lambda: F.array_join(F.transform(F.split(x, ""), lambda ch: F.when(ch == F.upper(ch), F.lower(ch)).otherwise(F.upper(ch))), ""),
        "len": lambda: F.length(x), "strip": lambda *a: F.btrim(x, F.lit(a[0])) if a else F.trim(x), "lstrip": lambda *a: F.ltrim(x), "rstrip": lambda *a: F.rtrim(x), "contains": lambda p: x.rlike(p), "startswith": lambda p: x.startswith(p), "endswith": lambda p: x.endswith(p), "match": lambda p: x.rlike("^(?:" + p + ")"), "fullmatch": lambda p: x.rlike("^(?:" + p + ")$"),
        "find": lambda s: F.instr(x, s) - 1, "replace": lambda p, r: F.regexp_replace(x, p, r), "slice": lambda b, e: F.substring(x, b + 1, max(0, e - b)), "get": lambda i: F.substring(x, i + 1, 1), "repeat": lambda n: F.repeat(x, n), "pad": lambda n: F.lpad(x, n, " "), "ljust": lambda n: F.rpad(x, n, " "), "rjust": lambda n: F.lpad(x, n, " "), "zfill": lambda n: F.when(F.length(x) < n, F.lpad(x, n, "0")).otherwise(x),
        "count": lambda p: F.regexp_count(x, F.lit(p)), "split": lambda sep, n=-1: F.split(x, "\\Q" + sep + "\\E", n + 1 if n >= 0 else -1), "extract": lambda p, g=1: F.nullif(F.regexp_extract(x, p, g), F.lit("")), "findall": lambda p: F.regexp_extract_all(x, F.lit(p), 0), "isdigit": lambda: x.rlike(r"^\p{Nd}+$"), "isalpha": lambda: x.rlike(r"^\p{L}+$"), "isalnum": lambda: x.rlike(r"^[\p{L}\p{N}]+$"), "isspace": lambda: x.rlike(r"^\s+$"), "islower": lambda: (x == F.lower(x)) & (x != F.upper(x)), "isupper": lambda: (x == F.upper(x)) & (x != F.lower(x)),
        "reverse": lambda: F.reverse(x), "encode": lambda e="UTF-8": F.encode(x, e), "normalize": lambda: F.trim(x),
    }
    return methods[method](*args)


def cat(columns: list[str], sep: str = "") -> Column:
    """Null if any is null."""
    return F.when(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, F.concat_ws(sep, *columns))


def extractall(df: DataFrame, c: str, pattern: str, group: int = 1, keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), F.posexplode(F.regexp_extract_all(F.col(c), F.lit(pattern), group)).alias("match", "value"))


def categories(df: DataFrame, c: str) -> DataFrame:
    """(code, value) of the distinct values in order; the window is over distinct values only."""
    values = df.select(F.col(c).alias("value")).filter("value is not null").distinct()
    return values.select((F.row_number().over(Window.orderBy("value")) - 1).alias("code"), "value")


def as_known(df: DataFrame, c: str) -> list:
    """The categories of a column, found by one pass; for columns of few values."""
    return [r["value"] for r in categories(df, c).orderBy("code").collect()]


def remove_unused_categories(known: list, df: DataFrame, c: str) -> list:
    """Of known categories those that the column has, in their order."""
    used = {r[0] for r in df.select(c).filter(F.col(c).isin(known)).distinct().collect()}
    return [k for k in known if k in used]


def memory_usage(df: DataFrame) -> DataFrame:
    """(column, bytes): the plain size of each column's values, as if uncompressed. One pass."""
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    of = lambda n, t: F.sum(F.when(F.col(f"`{n}`").isNotNull(), F.octet_length(f"`{n}`") if t in ("string", "binary") else F.octet_length(F.col(f"`{n}`").cast("string")) if t.startswith(("array", "map", "struct")) else F.lit(width.get(t, 8))).otherwise(0))
    cells = F.array(*(F.struct(F.lit(n).alias("column"), F.coalesce(of(n, t), F.lit(0)).cast("long").alias("bytes")) for n, t in df.dtypes))
    return df.agg(cells.alias("s")).select(F.inline("s"))


def info(df: DataFrame) -> DataFrame:
    """(column, non_null, dtype) of each column. One pass."""
    cells = F.array(*(F.struct(F.lit(n).alias("column"), F.count(F.col(f"`{n}`")).alias("non_null"), F.lit(t).alias("dtype")) for n, t in df.dtypes))
    return df.agg(cells.alias("s")).select(F.inline("s"))


def to_string(df: DataFrame, order: list[str], rows: int = 5) -> str:
    """The first and last rows in order as text."""
    head, tail = df.orderBy(*order).limit(rows).toPandas(), df.orderBy(*(F.desc(c) for c in order)).limit(rows).toPandas()[::-1]
    import pandas as pd

    return pd.concat([head, tail]).drop_duplicates().to_string(index=False)


def to_html(df: DataFrame, order: list[str], rows: int = 5) -> str:
    return df.orderBy(*order).limit(rows).toPandas().to_html(index=False)


def align_partitions(frames: list[DataFrame], key: str, divisions: list) -> list[DataFrame]:
    """Frames dealt alike: partition n has the keys from divisions[n - 1] up to divisions[n]; each sorted."""
    part = lambda: F.aggregate(F.array(*map(F.lit, divisions)), F.lit(0), lambda a, d: a + (F.col(key) >= d).cast("int"))
    return [f.withColumn("part_", part()).repartition(len(divisions) + 1, "part_").sortWithinPartitions("part_", key) for f in frames]


def codes(df: DataFrame, c: str, out: str = "code") -> DataFrame:
    """Codes of a column's values; -1 for null."""
    return df.join(categories(df, c).withColumnsRenamed({"code": out, "value": c}), c, "left").fillna({out: -1})


def get_dummies(df: DataFrame, c: str, values: list) -> DataFrame:
    return df.select("*", *(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in values)).drop(c)


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, variable, value)


def pivot_table(df: DataFrame, index: str, columns: str, values: str, aggregate: str = "mean", names: list | None = None) -> DataFrame:
    """names: the pivoted values, if known; else they are found by a pass of their own."""
    pivoted = df.groupBy(index).pivot(columns, names)
    return pivoted.agg({"mean": F.avg, "sum": F.sum, "count": F.count}[aggregate](values))


def align(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    keys = left.select(key).union(right.select(key)).distinct()
    return keys.join(left, key, "left"), keys.join(right, key, "left")


def combine(left: DataFrame, right: DataFrame, key: str, func: Callable[[Column, Column], Column], fill=None) -> DataFrame:
    """func of both sides' values of each shared column, rows matched by key; missing values are `fill`."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    out = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    side = lambda s, c: F.col(f"{s}.{c}") if fill is None else F.coalesce(F.col(f"{s}.{c}"), F.lit(fill))
    return out.select(F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key), *(func(side("l", c), side("r", c)).alias(c) for c in shared))

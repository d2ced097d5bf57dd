"""SQL text to DataFrames: the engine's entry point."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import recursion, sqlfront
from tidewater.sources import tables


class Engine:
    """Queries over a folder of tables or over registered DataFrames.

    Dialect: Spark SQL; besides, aggregates group by all other items of SELECT where GROUP BY is left
    out, WITH RECURSIVE takes UNION (a set fixpoint; with max_iterations, more expansions than that raise), and
    SELECT f(columns) FROM ... calls a registered Python function on whole columns.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None):
        self.spark = spark
        self.udfs: dict[str, tuple[Callable, list[int], str]] = {}
        self.folds: dict[str, tuple[dict[str, str], Callable, str, list[str]]] = {}
        self.sf_dir = sf_dir
        self.tables: dict[str, DataFrame] = {}

    def register_table(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def _views(self, sql: str) -> None:
        """Views of the tables that the text names; a folder's files are listed once, and only for these."""
        words = set(re.findall(r"[a-z_]\w*", sql.lower()))
        for name in tables.PARQUET:
            if self.sf_dir and name in words and name not in self.tables:
                self.tables[name] = tables.load(self.spark, self.sf_dir, name)
        for name, df in self.tables.items():
            if name.lower() in words:
                df.createOrReplaceTempView(name)

    def register_udf(self, func: Callable, param_count_list: list[int], returns: str = "result double", name: str | None = None) -> None:
        """func gets a pandas frame (or Series, for one column) for each number in param_count_list and gives a scalar, tuple, Series or frame.

        It runs in one executor task on the rows that the query leaves, as such functions see whole
        tables by definition; select what it needs first.
        """
        self.udfs[name or func.__name__] = (func, list(param_count_list), returns)

    def register_decomposable(self, name: str, sums: dict[str, str], finish: Callable, returns: str, args: list[str]) -> None:
        """A function that needs only aggregates of its arguments: sums, as SQL over the names in args, then finish(**sums) on their one row.

        Nothing but that row comes to Python, so that the table is aggregated by all tasks.
        """
        self.folds[name] = (sums, finish, returns, args)

    def unregister_all_udf(self) -> None:
        self.udfs.clear()
        self.folds.clear()

    def get_udf(self, name: str) -> tuple[Callable, list[int], str]:
        if name not in self.udfs:
            raise ValueError(f"{name} is not registered")
        return self.udfs[name]

    def query(self, sql: str, max_iterations: int | None = None) -> DataFrame:
        self._views(sql)
        if r := sqlfront.recursive(sql):
            return self._recursive(r, max_iterations)
        if c := sqlfront.table_call(sql, [*self.udfs, *self.folds]):
            return self._call(c)
        return self.spark.sql(sqlfront.implicit_groups(sql.rstrip().rstrip(";")))

    def explain(self, sql: str) -> str:
        df = self.query(sql)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _recursive(self, r: sqlfront.Recursive, max_iterations: int | None) -> DataFrame:
        base = self.query(r.base)
        base = base.toDF(*r.columns) if r.columns else base

        def step(whole: DataFrame) -> DataFrame:
            whole.createOrReplaceTempView(r.name)
            return self.query(r.step).toDF(*base.columns).select(*(F.col(c).cast(t) for c, t in base.dtypes))

        if r.operator == "union all":
            # each expansion sees the rows of the one before; duplicates stay
            whole = front = recursion.settle(base)
            for _ in recursion.rounds(max_iterations):
                front = recursion.settle(step(front))
                if front.isEmpty():
                    break
                whole = recursion.settle(whole.union(front))
        elif r.operator == "union":
            whole = recursion.union_fixpoint(base, step, max_iterations)
        else:
            whole = recursion.settle(base.distinct())
            for _ in recursion.rounds(max_iterations):
                new = recursion.settle(whole.intersect(step(whole)) if r.operator == "intersect" else whole.subtract(step(whole)))
                if new.count() == whole.count():
                    break
                whole = new
        whole.createOrReplaceTempView(r.name)
        return self.query(r.final)

    def _call(self, c: sqlfront.Call) -> DataFrame:
        if c.name in self.folds:
            return self._fold(c)
        func, counts, returns = self.get_udf(c.name)
        args = self.spark.sql(f"SELECT {', '.join(c.args)} {c.rest}")
        names = [f"a{i}" for i in range(len(args.columns))]
        return call_frames(args.toDF(*names), func, counts, returns, [a.split(".")[-1].strip() for a in c.args])


    def _fold(self, c: sqlfront.Call) -> DataFrame:
        sums, finish, returns, names = self.folds[c.name]
        columns = ", ".join(f"{a} AS {n}" for a, n in zip(c.args, names, strict=True))
        row = self.spark.sql(f"SELECT {columns} {c.rest}").agg(*(F.expr(e).alias(n) for n, e in sums.items()))

        def run(batches):
            import pandas as pd

            for b in batches:
                yield pd.DataFrame([finish(**r) for r in b.to_dict("records")], columns=[x.strip().split()[0] for x in returns.split(",")])

        return row.mapInPandas(run, returns)


def call_frames(args: DataFrame, func: Callable, counts: list[int], returns: str, labels: list[str] | None = None) -> DataFrame:
    """func on frames of `counts` columns each, cut from args left to right; one task."""
    labels = labels or args.columns
    out = [x.strip().split()[0] for x in returns.split(",")]

    def run(pdf):
        import numpy as np
        import pandas as pd

        frames, at = [], 0
        for n in counts:
            part = pdf.iloc[:, at : at + n]
            part.columns = labels[at : at + n]
            frames.append(part.iloc[:, 0] if n == 1 else part)
            at += n
        found = func(*frames)
        if isinstance(found, pd.DataFrame):
            return found.set_axis(out, axis=1)
        if isinstance(found, (pd.Series, np.ndarray, list)):
            found = np.asarray(found)
            return pd.DataFrame(found.reshape(len(found), -1), columns=out)
        return pd.DataFrame([found if isinstance(found, tuple) else (found,)], columns=out)

    return args.groupBy().applyInPandas(run, returns)

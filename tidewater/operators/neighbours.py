"""Nearest neighbours of rows with numeric features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.plans.recursion import settle

#: Query rows that are sent to all partitions of the training rows at once.
BLOCK = 4096
#: Of these, neighbours by the first feature that look together; training rows that give the bounds.
CHUNK, SAMPLE = 64, 4096


def scaled(df: DataFrame, by: DataFrame, features: list[str]) -> DataFrame:
    """Features less the mean of `by`, divided by its population deviation; constant ones only less the mean."""
    row = by.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features)).first()
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in features})


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q from all of x, features added in order."""
    found = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        found += (q[:, j, None] - x[None, :, j]) ** 2
    return found


def _reach(q: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """A bound on the k-th squared distance of each of q, from some of the rows, with room for rounding."""
    if len(some) < k:
        return np.full(len(q), np.inf)
    return np.partition(_squares(q, some), k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-300


def nearest(train: DataFrame, test: DataFrame, id_col: str, features: list[str], k: int, block: int = BLOCK) -> DataFrame:
    """(query, rank, id, distance): the k training rows nearest to each test row by squared distance; ties go to the smaller id.

    Test rows go to all partitions of the training rows in blocks; each batch there gives at most k rows a query. The k-th
    distance in SAMPLE training rows bounds how far a query has to look: rows whose first feature alone is further off are
    passed over, which loses none of the nearest.
    """
    spark = train.sparkSession
    train = settle(train.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features))).dropna())
    test = settle(test.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features))).dropna())
    n = max(1, -(-test.count() // block))
    some = train.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).drop("id").toPandas().to_numpy()
    schema, out = "query long, id long, distance double", None
    for part in range(n):
        rows = test.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == part).toPandas().sort_values("f0")
        q = rows.iloc[:, 1:].to_numpy()
        far = np.concatenate([np.zeros(0), *(_reach(q[c : c + CHUNK], some, k) for c in range(0, len(q), CHUNK))])
        sent = spark.sparkContext.broadcast((rows["id"].to_numpy(), q, far))

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pandas as pd

            ids, q, far = sent.value
            for b in batches:
                b = b.sort_values("f0")
                x, own = b.iloc[:, 1:].to_numpy(), b["id"].to_numpy()
                for c in range(0, len(q), CHUNK):
                    at, most = q[c : c + CHUNK], far[c : c + CHUNK]
                    # rows whose first feature alone is further off can't be among the k nearest
                    low, high = np.searchsorted(x[:, 0], [(at[:, 0] - np.sqrt(most)).min(), (at[:, 0] + np.sqrt(most)).max()], "left")
                    high += np.searchsorted(x[high:, 0], (at[:, 0] + np.sqrt(most)).max(), "right")
                    if low == high:
                        continue
                    found = _squares(at, x[low:high])
                    m = min(k, high - low)
                    row, col = np.nonzero(found <= np.minimum(np.partition(found, m - 1, axis=1)[:, m - 1], most)[:, None])
                    near = found[row, col]
                    order = np.lexsort((own[low + col], near, row))
                    row, col, near = row[order], low + col[order], near[order]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < m
                    yield pd.DataFrame({"query": ids[c + row[first]], "id": own[col[first]], "distance": near[first]})

        one = train.mapInPandas(run, schema)
        one = settle(one) if n > 1 else one
        if n > 1:
            sent.destroy()
        out = one if out is None else out.union(one)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "id", "distance")


def classify(train: DataFrame, test: DataFrame, id_col: str, features: list[str], label: str, k: int = 2) -> DataFrame:
    """(query, guess): the most frequent label among the k nearest training rows, of equally frequent ones the least."""
    near = nearest(scaled(train, train, features), scaled(test, train, features), id_col, features, k)
    labels = train.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"))
    votes = near.join(labels, "id").groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("guess"))

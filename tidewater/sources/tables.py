"""The known tables: columns, keys, readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table as DDL. Tables read from Parquet bring their own types; these serve text files.
SCHEMAS = {
    "region": "r_regionkey long, r_name string, r_comment string",
    "nation": "n_nationkey long, n_name string, n_regionkey long, n_comment string",
    "customer": "c_custkey long, c_name string, c_address string, c_nationkey long, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "supplier": "s_suppkey long, s_name string, s_address string, s_nationkey long, s_phone string, s_acctbal double, s_comment string",
    "part": "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size long, p_container string, p_retailprice double, p_comment string",
    "partsupp": "ps_partkey long, ps_suppkey long, ps_availqty long, ps_supplycost double, ps_comment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string, o_clerk string, o_shippriority long, o_comment string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz, l_commitdate timestamp_ntz, l_receiptdate timestamp_ntz, l_shipinstruct string, l_shipmode string, l_comment string",
    "countries": "id long, c_name string",
    "distances": "src long, target long, distance long",
}
PRIMARY_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "countries": "id"}
FOREIGN_KEYS = {
    "nation": {"n_regionkey": "region"},
    "customer": {"c_nationkey": "nation"},
    "supplier": {"s_nationkey": "nation"},
    "partsupp": {"ps_partkey": "part", "ps_suppkey": "supplier"},
    "orders": {"o_custkey": "customer"},
    "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    "distances": {"src": "countries", "target": "countries"},
}
PARQUET = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_delimited(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A known table from pipe-delimited text without a header; only the columns asked for are parsed."""
    if name not in SCHEMAS:
        raise KeyError(f"unknown table {name!r}")
    df = spark.read.schema(SCHEMAS[name]).option("sep", "|").csv(path)
    return df.select(*columns) if columns else df


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Temporary views of a folder's tables; a plan reads only those, and the columns, that it uses."""
    names = PARQUET if names is None else names
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)
    return list(names)


def distances(nation: DataFrame) -> DataFrame:
    """The edge table that path queries need, made from nation's keys."""
    one = nation.select(F.col("n_nationkey").cast("long").alias("src"), ((2 * F.col("n_nationkey") + 1) % 25).cast("long").alias("target"), (F.col("n_regionkey") + 1).cast("long").alias("distance"))
    two = nation.select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") + 7) % 25).cast("long").alias("target"), F.lit(3).cast("long").alias("distance"))
    return one.unionByName(two)


DISTANCES_SQL = (
    "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((2 * n_nationkey + 1) % 25 AS BIGINT) AS target, CAST(n_regionkey + 1 AS BIGINT) AS distance FROM nation "
    "UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 7) % 25 AS BIGINT), CAST(3 AS BIGINT) FROM nation"
)


def join_keys(left: str, right: str) -> tuple[str, str, str]:
    """(primary table, its key, the other's foreign key) of two known tables."""
    for child, parent in ((left, right), (right, left)):
        for column, of in FOREIGN_KEYS.get(child, {}).items():
            if of == parent:
                return parent, PRIMARY_KEYS[parent], column
    raise KeyError(f"no key joins {left!r} and {right!r}")


def column_at(name: str, position: int) -> str:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")][position]

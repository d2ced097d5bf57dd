"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: what a Python worker holds at once, whatever the partition's size.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
#: Tables that operators keep in a Python worker between their tasks.
_TABLES: list[dict] = []
#: Bytes of a row group of scratch tables: what a writing task holds on the heap.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that long texts don't fill a worker's memory.

    Plans take the limits when they run, so they stay set; limits that are lower already aren't raised.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def kept_in_worker() -> dict:
    """A dict for what an operator's tasks keep in a Python worker; it is emptied when another operator's task begins there."""
    _TABLES.append({})
    return _TABLES[-1]


def make_room(own: dict | None = None) -> None:
    """Empties what other operators' tasks have kept in this Python worker, and hands freed memory back to the system.

    Spark uses workers again, so that tables of one stage would stand beside the data of the next.
    """
    others = [t for t in _TABLES if t and t is not own]
    for t in others:
        t.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> bool:
    """Hands memory that the driver's JVM has freed outside its heap back to the system; whether Java can (17.0.9 and later, glibc).

    Each plan's compilation and threads leave some behind; in a session of many plans that is over 100 MB.
    """
    jvm = spark.sparkContext._jvm
    with suppress(Py4JError):
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method, as the server's own class is closed to reflection
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
        return True
    return False


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and runs in one process, as in tests, a temporary folder is set;
    on a cluster that is refused, as other machines wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if base:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
        return base.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
    return sc.getCheckpointDir().rstrip("/")


#: Paths that scratch() has given out and clear() hasn't deleted.
_given: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    _given.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the scratch tables given out after the first `since`, but for those to keep; what still reads them fails."""
    drop(spark, [p for p in _given[since:] if p not in keep])


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes these scratch tables, as far as they are still there."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gone = set(paths)
    _given[:] = [p for p in _given if p not in gone]


def given() -> int:
    """How many scratch paths are given out, for clear()."""
    return len(_given)


def given_since(since: int) -> list[str]:
    return _given[since:]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and lost executors lose nothing."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), and the table's path."""
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when their job ends, not when its plan is collected as garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A key with more rows than this is joined by broadcast: there are at most HOT_KEYS such keys, whatever the table's size.
HOT_ROWS, HOT_KEYS = 200_000, 10_000


def spread_join(many: DataFrame, one: DataFrame, key: str, n: str = "n", hot: int = HOT_ROWS) -> DataFrame:
    """many joined with one, which has a row for each key and, as n, how many rows of many have it; n is left out.

    Keys of over `hot` rows don't meet in a task: their rows of `one` are broadcast, HOT_KEYS at most.
    """
    top, total = one.agg(F.max(n), F.sum(n)).first()
    if (top or 0) <= hot:
        return many.join(one.drop(n), key)
    least = max(hot, total // HOT_KEYS)
    heavy, light = one.filter(F.col(n) > least).drop(n), one.filter(F.col(n) <= least).drop(n)
    rest = many.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return many.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


#: Ids up to this number, 16 MB of them, are broadcast.
FEW_IDS = 1_000_000


def only(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is in the written table ids, or is not (how: left_anti).

    Few ids are broadcast, so that rows, which may hold whole texts, are neither shuffled nor sorted.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, key, how)


def with_fields(schema, ddl: str):
    """A schema with more fields, which ddl names; whole, however wide the types are."""
    from pyspark.sql.types import StructType

    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def packed(docs: DataFrame) -> DataFrame:
    """row_, all columns of docs in one, and text_: nothing that an operator adds can clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), F.col("text").alias("text_"))


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*(F.col("row_")[c].alias(c) for c in names))


def third(id_col: str) -> Column:
    """crc32(id as text) mod 3; 0 where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def held_out(id_col: str) -> Column:
    return third(id_col) == 1

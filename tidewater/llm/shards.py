"""Sharding by size-tiered compaction with versioned manifests.

A store holds immutable Parquet shards and manifests. Arrivals are appended as small shards. A
compaction groups shards of similar size (within a factor RATIO of each other), fills groups up to
the target size and merges each group into one shard, by one task that streams through its files;
nothing is shuffled. A manifest names all shards of a version; it appears by one rename that fails
if that version exists, so readers see the old or the new set of shards and never a mixture, and of
two writers one tries again, RETRIES times at most. Files of failed or lost attempts are named by no
manifest. A compaction deletes nothing, so that every version stays readable and open readers go on;
`vacuum` deletes what only versions before the last few name, and what none names.

Defined results: rows come back whole, with all columns, nulls, repeated rows and extra columns
included; their order isn't kept. An empty append adds no shard. A store without a manifest is
empty and has no schema: reading it raises FileNotFoundError, as does a version that vacuum has
ended. Long texts make a shard larger, never cut. Shards of equal size go by file name. Column names that clash with those of
earlier shards are by name the same columns; missing ones read as null.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common

#: Bytes of a finished shard; shards of a merge at least; sizes in a tier differ by this factor at most.
TARGET_BYTES, LEAST_SHARDS, RATIO = 64 << 20, 2, 4
#: Rows of an arriving shard at most, and merges that run at once and are committed together.
ARRIVAL_ROWS, WAVE = 2000, 64
#: Times that a writer tries again after another one has committed first.
RETRIES = 100


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def _list(self, name: str) -> list[tuple[str, int]]:
        fs, path = self._fs(), self._path(name)
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "shards": []}
        path = self._path(f"manifests/v{version:010d}.json")
        if not self._fs().exists(path):
            raise FileNotFoundError(f"{self.root}: no version {version}")
        stream = self._fs().open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, before: dict, add: list[dict], remove: list[str]) -> dict:
        """A new version: before's shards without `remove` and with `add`. Raises Conflict if it exists."""
        now = {"version": before["version"] + 1, "shards": sorted([s for s in before["shards"] if s["file"] not in set(remove)] + add, key=lambda s: s["file"])}
        draft, final = self._path(f"manifests/.draft-{uuid.uuid4().hex}"), self._path(f"manifests/v{now['version']:010d}.json")
        out = self._fs().create(draft, False)
        try:
            out.write(bytearray(json.dumps(now).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf).rename(draft, final, options)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            raise Conflict(f"version {now['version']} exists") from e
        return now

    def _shards(self, folder: str) -> list[dict]:
        return [{"file": f"{folder}/{n}", "bytes": size} for n, size in self._list(folder) if n.endswith(".parquet")]

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> dict:
        """Adds rows as small shards of at most arrival_rows rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", arrival_rows).parquet(f"{self.root}/{folder}")
        made = self._shards(folder)
        for attempt in range(RETRIES + 1):
            try:
                return self.commit(self.manifest(), made, [])
            except Conflict:
                if attempt == RETRIES:
                    raise
        raise AssertionError

    def plan(self, shards: list[dict], target: int = TARGET_BYTES) -> list[list[dict]]:
        """Groups of shards to merge: of one size tier each, of about the target's size or less together."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < target / 2:
                tiers.setdefault(int(math.log(max(s["bytes"], 1), RATIO)), []).append(s)
        groups = []
        for _, tier in sorted(tiers.items()):
            group: list[dict] = []
            for s in sorted(tier, key=lambda s: (s["bytes"], s["file"])):
                if group and sum(x["bytes"] for x in group) + s["bytes"] > target:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) >= LEAST_SHARDS]

    def compact(self, target: int = TARGET_BYTES) -> dict:
        """Merges tier by tier until no tier has enough small shards. Each wave of merges is a version; old files stay."""
        lost = 0
        while True:
            before = self.manifest()
            groups = self.plan(before["shards"], target)[:WAVE]
            if not groups:
                return before
            folders = [f"data/{uuid.uuid4().hex}" for _ in groups]

            def merge(group: list[dict], folder: str) -> list[dict]:
                self.read_files([s["file"] for s in group]).coalesce(1).write.parquet(f"{self.root}/{folder}")
                return self._shards(folder)

            # a job for each merge, many at once: a union of single partitions would be made one partition
            with ThreadPoolExecutor(min(len(groups), WAVE)) as pool:
                made = [s for found in pool.map(merge, groups, folders) for s in found]
            gone = [s["file"] for g in groups for s in g]
            try:
                self.commit(before, made, gone)
                lost = 0
            except Conflict:
                lost += 1
                if lost > RETRIES:
                    raise

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n, _ in self._list("manifests") if n.startswith("v") and n.endswith(".json")]

    def vacuum(self, retain: int = 1) -> list[str]:
        """Ends all versions but the last `retain` and deletes shards that none of these names. Returns the shards deleted.

        Not for use while another writer appends or compacts: what it hasn't committed yet is named by no manifest.
        """
        if retain < 1:
            raise ValueError("retain at least the last version")
        kept, ended = self.versions()[-retain:], self.versions()[:-retain]
        named = {s["file"] for v in kept for s in self.manifest(v)["shards"]}
        for v in ended:  # first the manifests: a version that can be opened can be read
            self._fs().delete(self._path(f"manifests/v{v:010d}.json"), False)
        gone = []
        for folder, _ in self._list("data"):
            files = [s["file"] for s in self._shards(f"data/{folder}")]
            for name in files:
                if name not in named:
                    self._fs().delete(self._path(name), False)
                    gone.append(name)
            if not named.intersection(files):
                self._fs().delete(self._path(f"data/{folder}"), True)
        return gone

    def read_files(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/{f}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        files = [s["file"] for s in self.manifest(version)["shards"]]
        if not files:
            raise FileNotFoundError(f"{self.root}: no shards")
        return self.read_files(files)


def sharded(spark: SparkSession, rows: DataFrame, root: str | None = None, target: int = TARGET_BYTES) -> Store:
    """A compacted store of rows."""
    store = Store(spark, root or common.scratch(spark, "shards"))
    store.append(rows)
    store.compact(target)
    return store


def op4(spark, sf_dir: str) -> DataFrame:
    """Every document as the compacted store gives it back, its text as a digest."""
    docs = common.table(spark, sf_dir, "documents")
    store = sharded(spark, docs)
    rows = store.read() if store.manifest()["shards"] else docs.limit(0)
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


"""Sharding by size-tiered compaction, with DataFrame functions only.

Arrivals are appended as small immutable runs. Runs of one size tier (sizes within a factor of
``fanout``) are merged, ``fanout`` or more at a time, into target-sized files. Every change writes
a new version of the manifest; a version becomes visible by one rename that fails if it exists
already, so a reader sees all of a change or nothing, and of two writers one starts over.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import free_name, shared_dir


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Run:
    name: str
    path: str
    bytes: int
    tier: int
    schema: str = ""

    def fields(self) -> list[StructField]:
        return list(StructType.fromJson(json.loads(self.schema))) if self.schema else []


def united(runs: list[Run]) -> StructType:
    """Columns of all runs, in the order of their first sight; raises where runs disagree about a column's type."""
    fields: dict[str, StructField] = {}
    for run in runs:
        for f in run.fields():
            before = fields.setdefault(f.name.lower(), f)
            if before.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {before.dataType.simpleString()} in one run and {f.dataType.simpleString()} in another")
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()])


class ShardTable:
    """A folder with ``data/`` of immutable runs and ``manifest/v<number>.json``."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4, target_bytes: int = 128 << 20, base_bytes: int = 1 << 20):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fanout, self.target_bytes, self.base_bytes = fanout, target_bytes, base_bytes
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self._conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def tier(self, size: int) -> int:
        return 0 if size <= self.base_bytes else 1 + int(math.log(size / self.base_bytes, self.fanout))

    def versions(self) -> list[int]:
        folder = self._path(f"{self.folder}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v"))

    def runs(self, version: int | None = None) -> list[Run]:
        """Runs of a version, the latest by default; an empty table has none."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.folder}/manifest/v{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, runs: list[Run], base: int) -> int:
        """Writes version ``base + 1``; raises Conflict if it is there already."""
        version = base + 1
        self._fs.mkdirs(self._path(f"{self.folder}/manifest"))
        draft = self._path(f"{self.folder}/manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(f"{self.folder}/manifest/v{version:08d}.json"), self._no_overwrite)
        except Exception as e:
            self._fs.delete(draft, False)
            if "already exists" in str(e) or "AlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _size(self, path: str) -> int:
        return int(self._fs.getContentSummary(self._path(path)).getLength()) if self._fs.exists(self._path(path)) else 0

    def append(self, df: DataFrame, arrival: str, retries: int = 5) -> list[Run]:
        """Appends one run for each value of the column ``arrival``, written in one pass without a shuffle and committed as one version.

        A null arrival is a run too. No rows: nothing is committed. Runs may differ in columns: those that a run lacks are null in it. A column of another type than
        in the runs that are there is refused before anything is written.
        """
        batch = uuid.uuid4().hex[:12]
        top = f"{self.folder}/data/{batch}"
        part = free_name(df.columns, "arrived")
        schema = df.schema.json()
        united([*self.runs(), Run("", "", 0, 0, schema)])
        value = F.sha2(F.col(arrival).cast("string"), 256)  # a folder name that needs no escapes
        df.withColumn(part, F.coalesce(F.substring(value, 1, 24), F.lit("none"))).write.partitionBy(part).parquet(top)
        new = []
        for s in sorted(self._fs.listStatus(self._path(top)), key=lambda s: s.getPath().getName()):
            name = s.getPath().getName()
            if s.isDirectory() and name.startswith(f"{part}="):
                size = self._size(f"{top}/{name}")
                new.append(Run(f"{batch}-{name.partition('=')[2]}", f"{top}/{name}", size, self.tier(size), schema))
        for left in range(retries if new else -1, -1, -1):
            base = max(self.versions(), default=0)
            united([*self.runs(base), *new])  # another writer may have come first
            try:
                self.commit([*self.runs(base), *new], base)
                break
            except Conflict:
                if not left:
                    raise
        return new

    def _merge(self, runs: list[Run]) -> Run:
        size = sum(r.bytes for r in runs)
        name = f"merged-{uuid.uuid4().hex[:12]}"
        path = f"{self.folder}/data/{name}"
        files = max(1, -(-size // self.target_bytes))
        schema = united(runs)
        self.spark.read.schema(schema).parquet(*[r.path for r in runs]).coalesce(files).write.parquet(path)
        size = self._size(path)
        return Run(name, path, size, max(self.tier(size), max(r.tier for r in runs) + 1), schema.json())

    def compact(self, workers: int = 4) -> int:
        """Merges until no tier holds ``fanout`` runs; returns the number of merges. Old runs stay until :meth:`vacuum`.

        In a round all full tiers are merged, ``workers`` Spark jobs at a time, and one version is committed.
        """
        merges = 0
        while True:
            base = max(self.versions(), default=0)
            runs = self.runs(base)
            tiers: dict[int, list[Run]] = {}
            for r in sorted(runs, key=lambda r: (r.tier, r.bytes, r.name)):
                tiers.setdefault(r.tier, []).append(r)
            many = max(self.fanout, 2)
            groups = [rs[i : i + many] for rs in tiers.values() for i in range(0, len(rs) - many + 1, many)]
            if not groups:
                return merges
            with ThreadPoolExecutor(workers) as pool:
                merged = list(pool.map(self._merge, groups))
            gone = {r.name for g in groups for r in g}
            try:
                self.commit([*(r for r in runs if r.name not in gone), *merged], base)
                merges += len(groups)
            except Conflict:
                for r in merged:
                    self._fs.delete(self._path(r.path), True)

    def vacuum(self, min_age_seconds: float = 86_400) -> int:
        """Deletes runs that the latest version doesn't hold and that were written ``min_age_seconds`` ago or earlier.

        The age protects runs that another writer has written and not yet committed, and readers of older
        versions: it must exceed the longest append, merge or read. Zero is for tables that nobody else uses.
        """
        keep = {r.path.rsplit("/data/", 1)[1] for r in self.runs()}
        dropped, newest = 0, (time.time() - min_age_seconds) * 1000
        top = self._path(f"{self.folder}/data")
        if not self._fs.exists(top):
            return 0
        for s in self._fs.listStatus(top):
            name = s.getPath().getName()
            inside = [(f"{name}/{x.getPath().getName()}", x) for x in self._fs.listStatus(s.getPath()) if x.isDirectory()] or [(name, s)]
            for path, status in inside:
                if path not in keep and status.getModificationTime() <= newest:
                    dropped += bool(self._fs.delete(self._path(f"{self.folder}/data/{path}"), True))
        return dropped

    def read(self, schema, version: int | None = None, run: str = "__run", tier: str = "__tier") -> DataFrame:
        """Rows of a version with the name and tier of their run, in columns ``run`` and ``tier`` (names that ``schema`` must not have).

        No row for an empty table. The manifest, a row for each run, is joined by the folder of a row's file.
        """
        if {run.lower(), tier.lower()} & {c.lower() for c in schema.names}:
            raise ValueError(f"the table has a column {run} or {tier}; name others")
        runs = self.runs(version)
        if not runs:
            return self.spark.createDataFrame([], schema).withColumns({run: F.lit(""), tier: F.lit(0)})
        folder = free_name([*schema.names, run, tier], "folder")
        manifest = self.spark.createDataFrame([(r.path.rsplit("/data/", 1)[1], r.name, r.tier) for r in runs], f"`{folder}` string, `{run}` string, `{tier}` int")
        parts = self.spark.read.schema(schema).parquet(*[r.path for r in runs])
        where = F.regexp_extract(F.col("_metadata.file_path"), "^.*/data/(.+)/[^/]+$", 1)
        return parts.withColumn(folder, where).join(F.broadcast(manifest), folder, "left").select(*schema.names, run, tier)


def shard(df: DataFrame, arrival, folder: str | None = None, fanout: int = 4, target_bytes: int = 128 << 20, base_bytes: int = 1 << 20) -> DataFrame:
    """Appends ``df`` run by run of the column expression ``arrival``, compacts, and returns what the table then holds.

    All columns come back (nulls, repeats and empty texts included) with the run and its tier, in
    ``__run`` and ``__tier`` (with underscores added where ``df`` has such columns itself). An empty table returns no row.
    Without a ``folder`` the table is a new one in the shared folder, and its merged runs are deleted at once; in a
    given folder they stay for :meth:`ShardTable.vacuum`. The table itself stays until its owner removes it.
    """
    spark = df.sparkSession
    table = ShardTable(spark, folder or f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}", fanout, target_bytes, base_bytes)
    when = free_name(df.columns, "when")
    table.append(df.withColumn(when, arrival), when)
    table.compact()
    if folder is None:
        table.vacuum(0)
    run, tier = free_name(df.columns, "__run"), free_name(df.columns, "__tier")
    return table.read(df.schema, run=run, tier=tier)

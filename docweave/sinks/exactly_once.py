"""Writers that a retry can't make write twice.

What is written becomes visible by a rename that fails if its target exists, so of two writers one wins and the other learns of it. All files lie in one folder on
any file system that Hadoop reaches; nothing is ever changed in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Taken(Exception):
    """The version or batch that was to be written is there already."""


class Folder:
    """A folder with small files that appear whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.spark, self.path = spark, path.rstrip("/")
        self._at = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, sub: str) -> list[str]:
        where = self._at(f"{self.path}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{name}"))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def claim(self, name: str, content: dict) -> None:
        """Makes the file ``name``; raises ``Taken`` if it is there."""
        target = self._at(f"{self.path}/{name}")
        self._fs.mkdirs(target.getParent())
        draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(draft.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        try:
            self._context.rename(draft, target, self._no_overwrite)
        except Exception as e:
            self._fs.delete(draft, False)
            if "already exists" in str(e) or "AlreadyExists" in str(e):
                raise Taken(name) from e
            raise

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)


class AppendLog:
    """A table of appended batches. A batch's rows count once, however often it is written, by whomever."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def append(self, rows: DataFrame, batch: int | str) -> bool:
        """Writes ``rows`` as ``batch``; false, and nothing is added, if that batch is in the log already. An empty batch is one too."""
        entry = f"ledger/{batch}.json"
        if self.folder.exists(entry):
            return False
        data = f"data/{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.path}/{data}")
        try:
            self.folder.claim(entry, {"data": data, "schema": rows.schema.json()})
        except Taken:
            self.folder.remove(data)
            return False
        return True

    def sink(self, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each batch of a query once, also when the query is started again from an older checkpoint."""

        def write(rows: DataFrame, batch: int) -> None:
            self.append(shape(rows), batch)

        return write

    def batches(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.folder.names("ledger")]

    def rows(self) -> DataFrame:
        """Rows of all batches, by name: a column that a batch lacks is null there. What no ledger entry names is not read."""
        out = None
        by_schema: dict[str, list[str]] = {}
        for b in self.batches():
            entry = self.folder.read(f"ledger/{b}.json")
            by_schema.setdefault(entry["schema"], []).append(f"{self.folder.path}/{entry['data']}")
        for schema, paths in by_schema.items():
            one = self.folder.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise ValueError("the log has no batch")
        return out


class VersionedTable:
    """A table that is replaced as a whole: every swap is a version, of which a reader sees all or nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def version(self) -> int:
        """The newest version; 0 for none."""
        return max((int(n.removesuffix(".json")) for n in self.folder.names("versions")), default=0)

    def swap(self, rows: DataFrame, expected: int) -> int:
        """Makes ``rows`` version ``expected + 1``; raises ``Taken`` if someone else has made it."""
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.path}/{data}")
        try:
            self.folder.claim(f"versions/{expected + 1:012d}.json", {"data": data})
        except Taken:
            self.folder.remove(data)
            raise
        return expected + 1

    def rows(self, version: int | None = None) -> DataFrame:
        entry = self.folder.read(f"versions/{version or self.version():012d}.json")
        return self.folder.spark.read.parquet(f"{self.folder.path}/{entry['data']}")

    def change(self, make: Callable[[DataFrame | None], DataFrame], attempts: int = 10) -> int:
        """Swaps in ``make`` of the newest version (None for none); when another writer comes first, once more with that one's rows."""
        for _ in range(attempts):
            base = self.version()
            try:
                return self.swap(make(self.rows(base) if base else None), base)
            except Taken:
                continue
        raise Taken(f"{attempts} attempts")

    def vacuum(self, keep: int = 2) -> int:
        """Removes all versions but the newest ``keep`` with their rows; how many went."""
        old = self.folder.names("versions")[: -keep or None]
        for n in old:
            self.folder.remove(self.folder.read(f"versions/{n}")["data"])
            self.folder.remove(f"versions/{n}")
        return len(old)

"""What the operators of this subpackage share: the shared folder, Arrow columns, free names, and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests on one machine) a folder of our own is
    set; a cluster without the setting is an error, since its executors would write where nobody reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with as many underscores as it takes to differ from every name of ``taken``."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def arrow_column(returns: str, start: Callable[[], Callable[..., list]], *cols: Column, rows: int = 256) -> Column:
    """Column of what ``work(*lists)`` returns for the lists of values of some rows; ``start()`` makes ``work`` in each worker.

    Spark sends Arrow batches that its own settings bound in rows and bytes; of a batch only ``rows`` values at
    a time become Python objects, so the session's settings stay as they are.
    """
    fields = StructType.fromDDL(returns if " " in returns else f"x {returns}")
    kind = to_arrow_type(fields if " " in returns else fields[0].dataType)

    def run(arrays: tuple[pa.Array, ...], work: Callable[..., list]) -> pa.Array:
        parts = [pa.array(work(*(a.slice(at, rows).to_pylist() for a in arrays)), kind) for at in range(0, len(arrays[0]), rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    def one(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for a in parts:
            yield run((a,), work)

    def many(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        work = start()
        for arrays in parts:
            yield run(arrays, work)

    return F.arrow_udf(one if len(cols) == 1 else many, returns).asNondeterministic()(*cols)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files that every executor can read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has columns ``u`` and ``v`` of one type that can be ordered (long, string, binary); loops
    and nulls are dropped, repeats do no harm.
    Returns ``node``, ``component`` for nodes with at least one edge to another node (no row
    for an empty table). Alternating large-star and small-star rounds: each keeps
    reachability and ends in stars around the smallest node, in few rounds even for long chains.
    Only minima are aggregated, so a node with very many neighbours is no single group in
    memory. Each round is checkpointed. Raises if ``max_rounds`` is not enough.
    """
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = mark
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e = checkpoint(small.select(F.greatest("x.u", "x.m").alias("u"), F.least("x.u", "x.m").alias("v")).where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

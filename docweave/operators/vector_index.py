"""Vector top k by inverted lists.

Centres are fitted on a bounded sample; every row is then filed under the centre it is most similar to, and the lists are kept as a
Parquet table that other sessions can open. A query is held against the lists whose centres it is most similar to only: with about as many
lists as the square root of the rows, the work of all queries grows as n**1.5, not n**2, where a fixed number of lists
is enough. How many are enough depends on the vectors, so it is measured: a sample of queries is answered in full, and
the number of lists is the smallest that finds the wanted share of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .retrieval import matrix, top_k_each, vector_top_each

#: Rows that centres are fitted on, lists, and queries that the number of lists is measured with, at most. The lists hold every row all the same.
FIT_ROWS = 20_000
MOST_LISTS = 4_096
MEASURED_QUERIES = 200
#: Rows of a list, and queries, that meet at a time.
BLOCK = 1_024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres_of(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Unit centres of a sample of vectors, by alternating assignment and mean of directions; a centre without rows takes the row that fits its own worst."""
    x = _unit(sample[np.linalg.norm(sample, axis=1) > 0])
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    centres = x[np.random.default_rng(seed).permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        scores = x @ centres.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = x[np.argsort(scores.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """``folder``: lists and centres as tables. ``probes``: lists that a query is held against. ``sizes``: rows of each list."""

    folder: str
    id_col: str
    vec_col: str
    centres: np.ndarray
    sizes: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/lists")


def _ranked_lists(centres: np.ndarray, n: int, id_col: str, vec_col: str, id_kind: str, rows: DataFrame) -> DataFrame:
    """``id_col``, vector, ``list`` and ``place`` (from 0) of the ``n`` lists nearest to each row."""
    width, n = centres.shape[1], min(n, len(centres))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 1024):
                some = part.iloc[at : at + 1024]
                scores = matrix(list(some[vec_col]), width) @ centres.T
                near = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                again = np.repeat(np.arange(len(some)), near.shape[1])
                yield pd.DataFrame({id_col: some[id_col].to_numpy()[again], vec_col: some[vec_col].to_numpy()[again], "list": near.ravel(), "place": np.tile(np.arange(near.shape[1]), len(some))})

    return rows.select(id_col, vec_col).mapInPandas(run, f"`{id_col}` {id_kind}, `{vec_col}` array<double>, list int, place int")


def build(vectors: DataFrame, folder: str, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, probes: int = 8, seed: int = 0) -> VectorIndex:
    """Files every row of ``vectors`` that has an id and a vector, with its other columns, under ``folder`` and returns the index.

    ``lists`` is the square root of the rows unless it is given, ``MOST_LISTS`` at most. Centres come from ``FIT_ROWS`` rows, chosen by a hash of the id. Vectors may
    differ in length (the shorter ends in zeros), null components are 0; zero vectors are filed under the first list. Rows that repeat are all kept. Columns called ``list`` or ``place`` are refused.
    Rows are dealt by list and a hash of the id, so a list of any size is written by many tasks.
    """
    if taken := {"list", "place"} & {c.lower() for c in vectors.columns}:
        raise ValueError(f"columns of the index: {sorted(taken)}")
    spark = vectors.sparkSession
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).withColumn(vec_col, F.col(vec_col).cast("array<double>"))
    n, width = kept.agg(F.count("*"), F.coalesce(F.max(F.size(vec_col)), F.lit(1))).first()
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
    chosen = kept.select(F.xxhash64(F.lit(seed), id_col).alias("h"), vec_col).orderBy("h").limit(min(FIT_ROWS, 64 * lists))
    sample = [r[1] for r in chosen.collect()]
    centres = centres_of(matrix(sample, max(1, width)), lists, seed=seed) if sample else np.zeros((1, max(1, width)))
    fields = StructType([*kept.schema, StructField("list", IntegerType())])

    def file(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = [(matrix(list(part[vec_col].iloc[at : at + 1024]), centres.shape[1]) @ centres.T).argmax(axis=1) for at in range(0, len(part), 1024)]
            yield part.assign(list=np.concatenate(own).astype(np.int32) if own else np.zeros(0, np.int32))

    filed = kept.mapInPandas(file, fields)
    filed.repartitionByRange("list", F.xxhash64(id_col)).sortWithinPartitions("list").write.mode("overwrite").parquet(f"{folder}/lists")
    sizes = np.zeros(len(centres), np.int64)
    for i, rows in spark.read.parquet(f"{folder}/lists").groupBy("list").agg(F.count("*")).collect():  # a row for each list
        sizes[i] = rows
    table = [(i, [float(x) for x in c], int(s)) for i, (c, s) in enumerate(zip(centres, sizes, strict=True))]
    spark.createDataFrame(table, "list int, centre array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    return VectorIndex(folder, id_col, vec_col, centres, sizes, probes)


def open_index(spark: SparkSession, folder: str, id_col: str = "vec_id", vec_col: str = "embedding", probes: int = 8) -> VectorIndex:
    """An index that ``build`` has written."""
    rows = sorted(spark.read.parquet(f"{folder}/centres").collect())
    return VectorIndex(folder, id_col, vec_col, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), probes)


def calibrated(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.95, seed: int = 0) -> VectorIndex:
    """The index with the fewest ``probes`` that find the share ``recall`` of the true k best of a sample of ``queries`` (``query_id``, ``query``).

    ``MEASURED_QUERIES`` queries at most, chosen by a hash of their id, are answered in full for it, which takes time in proportion to the rows.
    """
    spark = queries.sparkSession
    some = queries.where("query_id IS NOT NULL AND query IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), "query_id")).limit(MEASURED_QUERIES)
    asked = some.select("query_id", F.col("query").cast("array<double>").alias("query")).collect()
    if not asked:
        return index
    fixed = spark.createDataFrame(asked, some.select("query_id", F.col("query").cast("array<double>").alias("query")).schema)
    rows = index.rows(spark)
    true = vector_top_each(rows, fixed, k, index.id_col, index.vec_col)
    filed = rows.select(index.id_col, "list").join(F.broadcast(true), index.id_col).select("query_id", "list").collect()  # k rows for each measured query
    order = np.argsort(-(matrix([r["query"] for r in asked], index.centres.shape[1]) @ index.centres.T), axis=1, kind="stable")
    place = {r["query_id"]: np.argsort(o, kind="stable") for r, o in zip(asked, order, strict=True)}
    needed = np.sort([place[q][i] for q, i in filed]) if filed else np.zeros(1, int)
    return replace(index, probes=int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)


def search(index: VectorIndex, queries: DataFrame, k: int, where: Column | str | None = None) -> DataFrame:
    """``query_id``, id, score (inner product, 6 decimals), rank of the ``k`` best rows that each query finds in its lists, ties by the smaller id.

    ``where`` chooses rows before the search, so it never costs results; with a rare condition fewer of the k may lie in the lists searched, and more ``probes`` find them. Queries without an
    id or vector have no rows. A list's rows and the queries that ask for it meet in blocks, so a list of any size is many tasks' work.
    """
    spark, id_col, vec_col = queries.sparkSession, index.id_col, index.vec_col
    kinds = dict(queries.dtypes)
    asked = queries.where("query_id IS NOT NULL AND query IS NOT NULL").withColumn("query", F.col("query").cast("array<double>"))
    wanted = _ranked_lists(index.centres, index.probes, "query_id", "query", kinds["query_id"], asked)
    rows = index.rows(spark)
    id_kind = dict(rows.dtypes)[id_col]
    if where is not None:
        rows = rows.where(where)
    blocks = [(i, max(1, -(-int(n) // BLOCK))) for i, n in enumerate(index.sizes)]
    n_blocks = spark.createDataFrame(blocks, "list int, blocks int")  # a row for each list
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    held = rows.join(F.broadcast(n_blocks), "list").groupBy("list", part(id_col, F.col("blocks")).alias("block"))
    held = held.agg(F.collect_list(id_col).alias("ids"), F.collect_list(vec_col).alias("vectors"))
    asks = wanted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each list
    asking = wanted.join(F.broadcast(asks), "list").groupBy("list", part("query_id", F.col("blocks")).alias("ask"))
    asking = asking.agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("query").alias("queries"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in parts:
            for qi, qv, vi, vv in zip(one["query_ids"], one["queries"], one["ids"], one["vectors"], strict=True):
                width = max(len(x) for xs in (qv, vv) for x in xs)
                scores = matrix(qv, width) @ matrix(vv, width).T
                least = np.partition(scores, -k, axis=1)[:, -k][:, None] - 2e-6 if scores.shape[1] > k else -np.inf
                a, c = np.nonzero(scores >= least)
                yield pd.DataFrame({"query_id": np.asarray(qi)[a], id_col: np.asarray(vi)[c], "score": scores[a, c]})

    found = held.join(asking, "list").select("query_ids", "queries", "ids", "vectors").mapInPandas(run, f"query_id {kinds['query_id']}, `{id_col}` {id_kind}, score double")
    return top_k_each(found.withColumn("score", F.round("score", 6)), k, id_col)


def recall_of(found: DataFrame, true: DataFrame, id_col: str = "vec_id") -> float:
    """Share of the rows of ``true`` (``query_id``, id) that ``found`` has; 1 for none."""
    n = true.count()
    return true.join(found.select("query_id", id_col).distinct(), ["query_id", id_col], "left_semi").count() / n if n else 1.0

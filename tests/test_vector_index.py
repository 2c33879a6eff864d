"""Inverted lists against the full search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import retrieval, vector_index
from docweave.plans import named

DATA = "/root/testdata/sf0.01"


def clustered(spark, n, seed=1, width=24, groups=40):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    x = middles[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, width))
    return spark.createDataFrame([(i, [float(c) for c in v], int(i % 7)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


def asked(vectors):
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_recall_and_work_on_clusters(spark, tmp_path):
    lists = {}
    for n in (1500, 6000):
        vectors = clustered(spark, n, groups=n // 30)
        index = vector_index.calibrated(vector_index.build(vectors, f"file://{tmp_path}/{n}"), asked(vectors), 10)
        true = retrieval.vector_top_each(vectors, asked(vectors), 10)
        assert vector_index.recall_of(vector_index.search(index, asked(vectors), 10), true) >= 0.9
        assert index.sizes.sum() == n
        lists[n] = index.probes * index.sizes.mean()
    assert lists[6000] < 2.9 * lists[1500]  # rows that a query meets: fewer than in proportion to n


def test_recall_without_structure(spark, tmp_path):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found, true = named.QUERIES["vector_topk_index"](spark, DATA), retrieval.vector_top_each(vectors, asked(vectors), 10)
    assert vector_index.recall_of(found, true) >= 0.9
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in retrieval.vector_top_each(vectors, asked(vectors), 500).collect()}
    assert all(exact[r["query_id"], r["vec_id"]] == pytest.approx(r["score"], abs=2e-6) for r in found.collect())


def test_all_lists_are_exact_and_filters_come_first(spark, tmp_path):
    vectors = clustered(spark, 800)
    built = vector_index.build(vectors, f"file://{tmp_path}/a", probes=10**6)
    index = vector_index.open_index(spark, built.folder, probes=10**6)
    for where in (None, "label = 3", F.col("label") > 4):
        kept = vectors if where is None else vectors.where(where)
        want = sorted(map(tuple, retrieval.vector_top_each(kept, asked(vectors), 10).collect()))
        assert sorted(map(tuple, vector_index.search(index, asked(vectors), 10, where).collect())) == want


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.5, None, 3.0]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [float("nan"), 2.0]), (7, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("clash"))
    index = vector_index.build(vectors, f"file://{tmp_path}/odd", probes=99)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0]), (3, [0.0, 1.0, 1.0])], "query_id long, query array<double>")
    got = {(r["query_id"], r["vec_id"], r["score"]) for r in vector_index.search(index, queries, 20).collect()}
    assert got == {(1, 1, 1.0), (1, 2, 0.5), (1, 4, 0.0), (1, 5, 1.0), (1, 6, 0.0), (1, 7, 0.0), (3, 1, 0.0), (3, 2, 3.0), (3, 4, 0.0), (3, 5, 0.0), (3, 6, 2.0), (3, 7, 0.0)}
    assert vector_index.search(index, queries, 20).where("query_id = 1 AND vec_id = 5").count() == 2
    empty = vector_index.build(vectors.limit(0), f"file://{tmp_path}/none")
    assert vector_index.search(empty, queries, 3).count() == 0 and vector_index.calibrated(empty, queries, 3).probes >= 1
    with pytest.raises(ValueError):
        vector_index.build(vectors.withColumn("List", F.lit(1)), f"file://{tmp_path}/x")


def test_full_search_with_missing_components(spark):
    rows = [(i, [None if i in (2, 4) else float(i), 1.0]) for i in range(9)] + [(20, [1.0]), (21, [float("nan"), 1.0, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.0, 1.0, 1.0])], "query_id long, query array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in retrieval.vector_top_each(vectors, queries, 1).collect()}
    assert got == {(1, 1): (8, 8.5), (2, 1): (21, 6.0)}

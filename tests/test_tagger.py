"""The trained tagger against a twin that trains without Spark, differences, and held-out rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.functions.snippets import snippets
from docweave.operators import classify, tagger
from docweave.plans import search

DATA = "/root/testdata/sf0.01"
TAX = tagger.Taxonomy([("a", "x", "1"), ("a", "x", "2"), ("a", "y", "1"), ("b", "z", "other"), ("b", "z", "3")])


def loss(rows, leaves, w):
    z, (s1, s2, s3) = tagger.logits(rows, w), tagger._parts(TAX)
    total = 0.0
    for r, leaf in enumerate(leaves):
        two = TAX.parent3[leaf]
        one = TAX.parent2[two]
        for part, among, true in ((s1, range(2), one), (s2, np.flatnonzero(TAX.parent2 == one), two), (s3, np.flatnonzero(TAX.parent3 == two), leaf)):
            own = z[r, part]
            total += np.log(sum(np.exp(own[i]) for i in among)) - own[true]
    return total


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    rows, leaves, w = [rng.integers(0, 6, 8).tolist() for _ in range(5)] + [[]], np.array([0, 1, 2, 3, 4, 0]), rng.normal(size=(7, sum(TAX.sizes)))
    g = tagger.gradient(rows, leaves, w, TAX)
    for i, j in [(0, 0), (3, 2), (6, 1), (5, 9), (2, 6), (6, 4)]:
        step = np.zeros_like(w)
        step[i, j] = 1e-6
        assert g[i, j] == pytest.approx((loss(rows, leaves, w + step) - loss(rows, leaves, w - step)) / 2e-6, abs=1e-5)


def test_masks_and_confidence():
    w = np.zeros((2, sum(TAX.sizes)))
    w[1] = [0, 1, 5, 0, 0, 9, 9, 9, 0, 2]  # level 1: b; below it z alone; below that 3 and other
    [(one, two, leaf, sure)] = tagger.Model(TAX, w, 0).predict([[]])
    p1, order = np.exp(1) / (1 + np.exp(1)), [p[2] for p in TAX.labels[2][3:]]
    assert (one, two, leaf) == ("b", "z", order[1]) and sure == pytest.approx((p1 * np.exp(2) / (1 + np.exp(2))) ** (1 / 3))


def test_spark_and_twin_learn_the_same(spark):
    words = {"a": "red blue", "b": "sun moon"}
    rows = [(i, f"{words[a]} w{i % 3} {'long ' * (i % 2)}", a, a + str(i % 3), "o" if i % 2 else "e", "clash") for i in range(60) for a in "ab"]
    df = spark.createDataFrame(rows, "id int, text string, level1 string, level2 string, level3 string, idx string").withColumn("id", F.monotonically_increasing_id()).repartition(5)
    model = tagger.fit(df, "id", width=64, rounds=15)
    held = df.select("id", "level1", "level2", "level3", tagger.features(F.col("text"), 64).alias("idx")).collect()
    twin = tagger.fit_here([r["idx"] for r in held], np.array([model.taxonomy.number[r["level1"], r["level2"], r["level3"]] for r in held]), model.taxonomy, 64, 15, 2.0, 1e-5)
    assert np.allclose(model.weights, twin.weights, atol=1e-8) and model.held_rows == 120
    got = tagger.tagged(df, model).collect()
    assert got[0].asDict().keys() == {"id", "text", "idx", "level1", "level2", "level3", "confidence"}
    twins = dict(zip([r["id"] for r in held], twin.predict([r["idx"] for r in held]), strict=True))
    assert all((r["level1"], r["level2"], r["level3"]) == twins[r["id"]][:3] for r in got) and len(got) == len(twins)
    votes = {r["id"]: r for r in tagger.tagged_by_vote(df, model, "id").collect()}
    assert all(votes[r["id"]]["path"] == f"{r['level1']}/{r['level2']}/{r['level3']}" for r in got)


def test_every_row_is_learned_from(spark):
    """Labels that few of very many rows have are known, and the model is that of all rows."""
    rows = spark.range(25_000).selectExpr("id", "if(id % 5000 = 7, 'sun moon', concat('red w', id % 5)) AS text", "if(id % 5000 = 7, 'b', 'a') AS level1", "'x' AS level2", "if(id % 5000 = 7, 'rare', 'e') AS level3")
    model = tagger.fit(rows, "id", width=32, rounds=2)
    held = rows.select("level1", "level2", "level3", tagger.features(F.col("text"), 32).alias("idx")).collect()
    leaves = np.array([model.taxonomy.number[r["level1"], r["level2"], r["level3"]] for r in held])
    twin = tagger.fit_here([r["idx"] for r in held], leaves, model.taxonomy, 32, 2, 2.0, 1e-5)
    assert model.held_rows == 25_000 and np.allclose(model.weights, twin.weights, atol=1e-10)


def test_counts_have_the_gradient_of_their_rows():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 40, n).tolist() for n in (3, 0, 70, *rng.integers(1, 30, 150))]
    leaves, w = rng.integers(0, 5, len(rows)), rng.normal(size=(41, sum(TAX.sizes)))
    sizes, idx, n = tagger.counted(pa.array([[1], *rows, None], pa.list_(pa.int32())).slice(1, len(rows)), 40)
    assert sizes.tolist() == [len(set(r)) for r in rows] and n.sum() == sum(map(len, rows))
    assert np.allclose(tagger.gradient_of_counts(sizes, idx, n, leaves, w, TAX), tagger.gradient(rows, leaves, w, TAX), atol=1e-10)
    assert [tagger._unpacked(tagger._packed(np.array(x, np.int64)), len(x)).tolist() for x in ([0, 255], [256, 1], [1 << 40], [])] == [[0, 255], [256, 1], [1 << 40], []]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "red", "a", "x", "1"), (2, None, "a", "x", "2"), (2, "", "b", "z", "other"), (None, "sun", "b", "z", "3"), (3, "no path", None, "x", "1")], "id long, text string, level1 string, level2 string, level3 string")
    model = tagger.fit(df, "id", width=16, rounds=3)
    assert model.held_rows == 4 and model.taxonomy.sizes == (2, 2, 4)
    assert {r["level3"] for r in tagger.tagged(df, model, least=1.0).where("level1 = 'b'").collect()} <= {"other"}
    assert tagger.tagged(df.limit(0), model).count() == 0 and tagger.tagged(df, model).count() == 5
    assert tagger.tagged_by_vote(df, model, "id").where("id = 2").count() == 0
    with pytest.raises(ValueError):
        tagger.fit(df.limit(0), "id")


def test_held_out_accuracy(spark):
    truth = search.labelled_documents(spark, DATA).select("doc_id", *[F.col(c).alias(f"true_{c}") for c in tagger.LEVELS])
    rows = search.tagger_labels(spark, DATA).where("held_out").join(truth, "doc_id").where("true_level1 IS NOT NULL")
    n, *right = rows.agg(F.count("*"), *[F.avg((F.col(c) == F.col(f"true_{c}")).cast("double")) for c in tagger.LEVELS]).first()
    assert n > 150 and right[0] > 0.97 and right[1] > 0.97 and right[2] > 0.8, right


def test_snippets(spark):
    def of(text, **k):
        return spark.createDataFrame([(text,)], "t string").select(snippets(F.col("t"), **k)).first()[0]

    blocks = "\r\n\r\n".join(["head", "second", "short", "the longest block of all", "a  b", "longer block", "last"])
    assert of(blocks) == ["head", "second", "short", "a  b", "last"]
    assert of(blocks, most=9) == ["head", "second", "short", "a  b", "last", "the longest block of all", "longer block"]
    assert of("x\n\nx\n\nx") == ["x"] and of(None) == of(" \n ") == []
    assert of("abcdefghij", chars=4) == ["abcd", "defg", "ghij"] and of("abcdefgh", chars=4) == ["abcd"] and of("a  b", chars=4) == ["a b"]


def test_the_sample_is_chosen_by_few_rows(spark):
    rows = spark.range(60_000).select("id", F.xxhash64("id").alias("h"))
    some = tagger.among_first(rows, 500)
    assert 500 <= some.count() < 520
    assert some.orderBy("h").limit(500).collect() == rows.orderBy("h").limit(500).collect()
    assert tagger.among_first(rows, 70_000).count() == 60_000 and tagger.among_first(rows.limit(0), 5).count() == 0


def test_lists_are_judged_as_rows_are(spark):
    rng = np.random.default_rng(5)
    tax = tagger.Taxonomy([("a", "b", "c"), ("a", "b", "d"), ("e", "f", "g")])
    model = tagger.Model(tax, rng.normal(size=(17, sum(tax.sizes))), 0)
    rows = [list(map(int, rng.integers(0, 16, n))) for n in (0, 1, 5, 40, 200)]
    for some in (pa.array(rows, pa.list_(pa.int32())), pa.array([[3], *rows, [4]], pa.list_(pa.int32())).slice(1, 5)):
        got, want = model.predict_lists(some), model.predict(rows)
        assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_a_vote_reads_its_snippets_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (1, None, 0.5), (2, None, 1.0), (None, "a", 1.0)], "k long, l string, c double").mapInArrow(told, "k long, l string, c double")
    assert [tuple(r) for r in classify.vote(rows, "k", "l", "c").collect()] == [(1, "a", round(0.5 / 3, 6))] and seen.value == 5

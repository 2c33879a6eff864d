"""Every named query against its SQL on the small tables, and small cases of the operators."""

import datetime
import random
from pathlib import Path

import duckdb
import pytest

from docweave.functions import text as T
from docweave.operators import chunking, records, retrieval, scoring
from docweave.plans import named
from docweave.sources import readers
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x if x is None or isinstance(x, (str, bool)) else round(float(x), 6)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(named.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = named.QUERIES[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(named.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str) == sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=str)


def test_row_ranges():
    assert readers.row_ranges("10,1,3-5,4-7,8") == [(1, 1), (3, 8), (10, 10)]
    with pytest.raises(ValueError):
        readers.row_ranges("5-2")


def test_headings(spark):
    text = "front\n# A\nx\n## B {#b}\ny\n# C\nz"
    rows = chunking.headings(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()
    assert [(r["title"], list(r["ancestors"]), r["text"]) for r in rows] == [(None, [], "front"), ("A", [], "x"), ("B", ["A"], "y"), ("C", [], "z")]


def test_manual_points_keep_numbers(spark):
    docs = spark.createDataFrame([(1, "ab   cd"), (2, None)], "doc_id long, text string")
    rows = chunking.at_points(docs, F.array(F.lit(2), F.lit(5))).collect()
    assert [(r["part"], r["text"]) for r in rows] == [(1, "ab"), (3, "cd")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "x"}\nbroken\n')
    rows = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "q string").collect()
    assert sorted(str(r["q"]) for r in rows) == ["None", "x"]
    (tmp_path / "i.json").write_text('{"items": [{"q": "a"}, {"q": "b"}]}')
    assert sorted(r["q"] for r in readers.items_json(spark, str(tmp_path / "i.json"), "q: string").collect()) == ["a", "b"]
    (tmp_path / "s.json").write_text('{"data":[{"title":"t","paragraphs":[{"context":"c","qas":[{"id":"1","question":"q","answers":[{"text":"a","answer_start":0}]},{"id":"2","question":"r","answers":[]}]}]}]}')
    assert sorted((r["id"], r["answer"]) for r in readers.squad(spark, str(tmp_path / "s.json")).collect()) == [("1", "a"), ("2", None)]


def test_wall_attribution(spark):
    rows = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 5, 10), (1, "c", 3, 3)], "k long, s string, x long, y long")
    assert {r["s"]: r["seconds"] for r in records.attribute_wall(rows, "k", "x", "y", "s").collect()} == {"a": 7.5, "b": 2.5}


def test_searches_take_many_queries(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red red dog"), (3, "blue dog"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(10, "red fox"), (11, "Dog zebra dog"), (12, None)], "query_id long, query string")
    for each, one in ((retrieval.lexical_top_each, retrieval.lexical_scores), (retrieval.bm25_top_each, retrieval.bm25)):
        got = {(r["query_id"], r["doc_id"], r["score"]) for r in each(docs, queries, 5).collect()}
        assert got == {(q, r["doc_id"], r["score"]) for q, text in ((10, "red fox"), (11, "Dog zebra dog")) for r in one(docs, text).collect()}
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 9 = 0").selectExpr("vec_id query_id", "embedding query")
    got = {(r["query_id"], r["vec_id"]) for r in retrieval.vector_top_each(vectors, queries, 3, block=4).collect()}
    dot = lambda a, b: (a % 7) * (b % 7) + (a % 5) * (b % 5)
    assert got == {(q, i) for q in range(0, 40, 9) for i in sorted(range(40), key=lambda i: (-dot(q, i), i))[:3]}


def slow_wall(rows):
    out = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k and r[2] < r[3]]
        cuts = sorted({x for r in mine for x in r[2:]})
        for x, y in zip(cuts, cuts[1:]):
            active = {r[1] for r in mine if r[2] <= x and r[3] >= y}
            for s in active:
                out[k, s] = out.get((k, s), 0) + (y - x) / len(active)
    return out


def test_wall_attribution_of_many(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), rng.choice(["a", "b", "c", None]), x := rng.randrange(-500, 5000), x + rng.choice([0, 1, 40, 300, 2500])) for _ in range(400)]
    df = spark.createDataFrame([*rows, (None, "a", 0, 9), (1, "a", None, 9)], "k long, s string, x long, y long")
    for width in (100, 3600):
        got = {(r["k"], r["s"]): r["seconds"] for r in records.attribute_wall(df, "k", "x", "y", "s", width).collect()}
        assert got == pytest.approx(slow_wall(rows), abs=1e-5)


def test_wall_attribution_meets_no_interval_with_slices(spark):
    rows = spark.range(10).selectExpr("1L k", "'a' s", "id x", "id + 5 y")
    plan = records.attribute_wall(rows, "k", "x", "y", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_wall_attribution_reads_all_events(spark):
    events = readers.table(spark, DATA, "events")
    got = named.QUERIES["wall_interval_attribution_all"](spark, DATA).select("user_id", "stage").distinct().count()
    assert got == events.select("user_id", "event_type").distinct().count()


def test_scores_and_language(spark):
    rows = spark.createDataFrame([("A b", "a  B"), ("", ""), ("x x y", "x z"), (None, "a"), ("北京", "上海"), ("Москва", "москва!"), ("北京大学", "北京")], "a string, r string")
    got = [(r["exact"], r["f1"], r["bleu"], r["missing_reference"]) for r in scoring.answer_scores(rows, "a", "r").collect()]
    assert got[:4] == [(1, 1.0, 0.0, 0), (0, 0.0, 0.0, 1), (0, 0.4, 66.666667, 0), (0, 0.0, 0.0, 0)]
    assert got[4:] == [(0, 0.0, 0.0, 0), (1, 1.0, 83.333333, 0), (0, 0.666667, 50.0, 0)]
    langs = spark.createDataFrame([("中文字符",), ("abc",), ("123",)], "t string").select(T.language_of(F.col("t")).alias("l"))
    assert [r["l"] for r in langs.collect()] == ["zh", "en", "unknown"]


def test_stream_of_events(spark, tmp_path):
    from docweave.streaming.status import event_stream, windowed_counts

    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, 5), "a"), (2, datetime.datetime(2024, 1, 1, 0, 50), "a")], "event_id long, ts timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(event_stream(spark, str(tmp_path / "in"), rows.schema))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["n"] for r in spark.table("counted").collect()] == [2]


def test_fused_ratings_do_not_depend_on_the_order_of_rows(spark):
    from fractions import Fraction

    from docweave.operators import suite

    rows = [("u", i, v, str(v)) for i, v in enumerate([23.31, 20.49] * 6)] + [("w", i, v, str(v)) for i, v in enumerate([1e16, 0.1, 3.0, 0.2, 1e-9, 1e16, 7.7])] + [("z", 0, 0.0, "a"), ("z", 1, None, "b")]
    found = set()
    for parts in (1, 3, 7):
        for some in (rows, rows[::-1], sorted(rows, key=lambda r: (r[2] or 0, r[1]))):
            df = spark.createDataFrame(some, "k string, attempt int, score double, rating string").repartition(parts)
            means = {r["k"]: r["m"] for r in suite.exact_means(df.selectExpr("k", "if(score > 0, score, null) AS x"), ["k"], "x").collect()}
            assert means["z"] is None and means["u"] == float(sum(Fraction(v) for _, _, v, _ in rows[:12])) / 12
            found.add((means["u"], means["w"], *sorted(tuple(r) for r in suite.fused_ratings(df, "k").collect())))
    assert len(found) == 1 and ("u", 21.9, "20.49") in next(iter(found)) and ("z", 0.0, None) in next(iter(found))
    odd = spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("b", float("nan")), ("b", 1.0)], "k string, x double")
    assert {r["k"]: str(r["m"]) for r in suite.exact_means(odd, ["k"], "x").collect()} == {"a": "inf", "b": "nan"}


def test_ratings_of_repeated_scores_are_those_of_the_sql(spark, tmp_path):
    """The mean of six copies of two scores lies between them; which is nearer is decided by the order of addition."""
    con = duckdb.connect(config={"threads": 1})
    con.sql("create table events as select i as event_id, u as user_id, 'view' as event_type, cast([v + w, v][i % 2 + 1] as double) as value, '{\"k\": ' || i || '}' as props from range(12) r(i), (values (1, 20.49, 2.82), (2, 0.1, 0.2), (3, 1.1, 2.2), (4, -5.0, 5.0)) g(u, v, w)")
    con.sql("insert into events values (12, 1, 'view', NULL, 'x'), (13, 5, 'view', NULL, 'x')")
    con.sql(f"copy (from events order by event_id) to '{tmp_path}/events.parquet'")
    con.sql("drop table events")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql(named.ORACLE_SQL["rating_fusion"]).fetchall()
    df = named.QUERIES["rating_fusion"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.select("user_id", "event_type", "score", "rating").collect()) == sorted(want)


def test_searches_by_blocks_find_what_plain_products_find(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    side = lambda n: [np.unique(rng.zipf(1.3, 30) % 90) for _ in range(n)]
    flat = lambda rows: (np.array([len(r) for r in rows]), np.concatenate(rows).astype(np.int64), rng.random(sum(map(len, rows))))

    def dense(sizes, terms, weights):
        out = np.zeros((len(sizes), 90))
        out[np.repeat(np.arange(len(sizes)), sizes), terms] = weights
        return out

    q, d = flat(side(33)), flat(side(40))
    for step in (5, 1 << 21):
        assert np.allclose(retrieval.term_products(q, d, step), dense(*q) @ dense(*d).T)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(words[int(j) % 40] for j in rng.zipf(1.4, 12))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = docs.where("doc_id % 20 = 0").selectExpr("doc_id query_id", "text query")
    for each, one in ((retrieval.lexical_top_each, retrieval.lexical_scores), (retrieval.bm25_top_each, retrieval.bm25)):
        found = each(docs, queries, 4, block=7)
        got = [(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found.collect()]
        want = []
        for i, text in texts[::20]:
            best = sorted(((-r["score"], r["doc_id"]) for r in one(docs, text).collect()))[:4]
            want += [(i, doc, -score, n) for n, (score, doc) in enumerate(best, 1)]
        assert sorted(got) == sorted(want)


def test_queries_with_python_rows_bound_their_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for name in ("doc_recursive_split", "doc_markdown_split"):
            spark.conf.set(key, str(64 << 20))
            named.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get(key)) == 4 << 20
            spark.conf.set(key, "12345")
            named.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.set(key, before)


def test_bleu_shuffles_no_ngrams(spark):
    from docweave.operators import bleu

    pairs = spark.createDataFrame([(1, "a b c d e a b", "a b x c d e f"), (1, "a b c d e a b", "a b x c d e f"), (2, "a", None)], "i int, c string, r string")
    found = bleu.bleu(pairs, ["i"], "c", "r")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(r["i"] for r in found.collect()) == [1, 2]

"""Planning, models, grounding and splitting against plain Python."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from docweave.functions import signals as S
from docweave.functions.text import collapse
from docweave.operators import chunking, grounding, language_model, planning, scoring
from pyspark.sql import functions as F


def slow_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert scoring.common_subsequence(a, b) == slow_lcs(a, b)


def test_rouge_l(spark):
    rows = spark.createDataFrame([(1, "a b c", "a x c"), (2, "", None), (3, "a", ""), (4, None, "a")], "k long, a string, r string")
    assert {r["k"]: r["rouge_l"] for r in scoring.rouge_l(rows, "a", "r").collect()} == {1: 0.666667, 2: 1.0, 3: 0.0, 4: 0.0}
    rows = spark.createDataFrame([(1, "北京大学", "北大"), (2, "A b", "a b")], "k long, a string, r string")  # characters where there is no blank; case counts
    assert {r["k"]: r["rouge_l"] for r in scoring.rouge_l(rows, "a", "r").collect()} == {1: 0.666667, 2: 0.5}


def test_recursive_split(spark):
    assert chunking.pack_spans("aa bb cc dd", (" ", ""), 5) == ["aa bb", "cc dd"]
    assert chunking.pack_spans("aaaaaaa bb", (" ", ""), 3) == ["aaa", "aaa", "a", "bb"]
    assert chunking.pack_spans("p one\n\np two. x", ("\n\n", ". ", " "), 6) == ["p one", "p two", "x"]
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab .\n") for _ in range(rng.randrange(80)))
        got = chunking.pack_spans(text, chunking.SEPARATORS, 7)
        assert all(0 < len(x) <= 7 for x in got)
        letters = lambda s: [c for c in s if c in "ab"]
        assert letters("".join(got)) == letters(text)
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk_index"], r["text"]) for r in chunking.recursive(docs, 5, (" ",)).orderBy("doc_id", "chunk_index").collect()] == [(1, 0, "aa bb"), (1, 1, "cc")]
    with pytest.raises(ValueError):
        chunking.recursive(docs, 0)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngram_model(spark, n):
    texts = {1: "red fox red fox jumps", 2: "red fox", 3: None, 4: "", 5: "the red fox jumps over the red log"}
    words = {k: (t or "").split() for k, t in texts.items()}
    gram = lambda w, m: [tuple(w[i : i + m]) for i in range(len(w) - m + 1)]
    c, p = (Counter(g for w in words.values() for g in gram(w, m)) for m in (n, n - 1))
    base = lambda g: sum(c.values()) + len(c) if n == 1 else p[g[:-1]] + len(p)
    want = {k: round(sum(math.log2((c[g] + 1) / base(g)) for g in gram(w, n)) / max(1, len(gram(w, n))), 6) for k, w in words.items()}
    got = language_model.ngram_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n)
    assert {r["doc_id"]: r["score"] for r in got.collect()} == pytest.approx(want, abs=2e-6)


def test_units_and_budget(spark):
    long = "- " + "x" * 500 + "\n- " + "y" * 800
    rows = [(1, 0, 0, "one", "usable"), (1, 1, 0, "two", "usable"), (1, 2, 0, "three", "context_only"), (1, 3, 0, "four", "drop"), (1, 4, 1, long, "usable"), (1, 5, 2, "six", "usable"), (1, 6, 3, None, "usable"), (2, 0, 0, "x", "context_only"), (3, 0, None, "y", "usable")]
    units = planning.plan_units(spark.createDataFrame(rows, "doc_id long, chunk_index long, parent long, text string, status string"))
    got = sorted((r["doc_id"], r["anchor"], r["unit_type"], r["n_chunks"], r["potential"]) for r in units.collect())
    assert got == [(1, 0, "section", 3, 2), (1, 4, "virtual_parent", 1, 2), (1, 5, "leaf", 1, 1), (3, 0, "leaf", 1, 1)]
    for total, want in ((2, [1, 1]), (4, [2, 1, 1]), (9, [2, 2, 1])):
        shares = planning.allocate_budget(units, total).where("doc_id = 1").orderBy("anchor").collect()
        assert [r["budget"] for r in shares] == want


def test_largest_remainder(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", None)], "k string, n long")
    assert {r["k"]: r["quota"] for r in planning.largest_remainder(groups, "k", "n", 10).collect()} == {"a": 4, "b": 3, "c": 3, "d": 0}
    assert planning.largest_remainder(groups.where("false"), "k", "n", 10).count() == 0


def test_grounding(spark):
    source = "The tower was built in 1889.\nIt is 330 metres tall.\nIt stands in Paris."
    facts = [(1, "built in 1889"), (2, "It is 330 meters tall"), (3, "nothing of the kind"), (4, None), (5, "")]
    rows = spark.createDataFrame([(k, f, source) for k, f in facts], "k long, f string, s string")
    got = {r["k"]: (r["score"], r["matched"]) for r in grounding.grounding_scores(rows, "k", "f", "s").collect()}
    want = max(SequenceMatcher(None, "itis330meterstall", c).ratio() for c in ("thetowerwasbuiltin1889.", "itis330metrestall.", "itstandsinparis."))
    assert got[1][0] == 1.0 and got[2][0] == pytest.approx(want, abs=1e-6) and got[3][0] < 0.86 and got[4] == got[5] == (0.0, False)
    assert {r["k"]: r["grounded"] for r in grounding.grounded_points(rows, "k", "f", "s").collect()} == {1: True, 2: want >= 0.86, 3: False, 4: False, 5: False}
    sums = spark.createDataFrame([(1, "The tower was built in 1889; it is 330 metres tall", source), (2, "built in 1889", source), (3, "It was painted green; it fell in 2001", source), (4, None, source)], "k long, f string, s string")
    assert {r["k"]: r["grounded"] for r in grounding.grounded_summaries(sums, "k", "f", "s").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_lexical_anchor(spark):
    rows = spark.createDataFrame([("abc d", "B c"), ("abc", "abx"), ("abc", None), ("a", "b"), ("", "b"), ("北京市", "北京"), ("上海市", "北京"), ("abab", "ababab")], "u string, a string")
    assert [r["s"] for r in rows.select(scoring.lexical_anchor(F.col("u"), F.col("a")).alias("s")).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0]


def test_ngrams_go_through_one_shuffle_as_numbers(spark):
    """No n-gram travels as a text, nor to be counted by document first; frequent ones of many batches meet."""
    docs = spark.createDataFrame([(i, "the same words again the same " + "ab " * (i % 3)) for i in range(1500)] + [(0, "the same")], "doc_id long, text string")
    scores = language_model.ngram_scores(docs, 2)
    by_doc, model = language_model.ngram_log_probabilities(docs, 2)
    want = by_doc.join(model, "gram").groupBy("doc_id").agg((F.sum(F.col("tf") * F.col("log2p")) / F.sum("tf")).alias("s")).collect()
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    assert len(got) == 1500 and got == pytest.approx({r["doc_id"]: r["s"] for r in want}, abs=1e-6)
    exchanges = [x for x in scores._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert not [x for x in exchanges if "gram" in x]


def test_marks_of_texts_are_those_of_the_column_functions(spark):
    """All marks at once, as the columns that stand for each have them; a text is read by Arrow, not word by word."""
    rng = random.Random(3)
    words = ["", " ", "  ", "\n", "\r\n", "\t", "|", ",", "，", "- ", "1. ", "12) ", "一、", "第三章", "is", "island", "IS", "requires", "applies to", "2024-05", "5 kg", "5kgs", "图片", "image", "Figure", "流程", "standard", "term", "étage", "ß", "3.1 ", "…", "!", ":", "\u3000", "\u00a0", "x" * 50]
    texts = [("".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([1, 2, 3, 6, 40]))), rng.choice(["", "term", "a > is", "a>  "])) for _ in range(3000)] + [(None, None), ("", "a"), ("term", "b > term")]
    t, p = F.coalesce("t", F.lit("")), F.coalesce("p", F.lit(""))
    df = spark.createDataFrame(texts, "t string, p string").repartition(4)
    want = [S.has_facts(t), S.has_list(t), S.structure(t), S.placeholder(t), S.title_only(t, p), S.table_fragment(t), S.symbol_share(t), F.length(collapse(t))]
    rows = df.select("t", S.marks(F.col("t"), F.col("p")).alias("m"), F.array(*[w.cast("double") for w in want]).alias("w")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [float(x) for x in r["m"]] == r["w"], (r, r["t"])


def test_units_read_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(1, i, i // 4, f"text {i}", "usable") for i in range(12)]
    kind = "doc_id long, chunk_index long, parent long, text string, status string"
    units = planning.plan_units(spark.createDataFrame(rows, kind).mapInArrow(told, kind))
    assert {r["budget"] for r in planning.allocate_budget(units, 5).collect()} == {2, 1} and seen.value == 12

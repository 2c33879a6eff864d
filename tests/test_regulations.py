"""Numbered texts, and functions on questions, with hand-checked cases."""

import random
import time

from docweave.functions import questions as Q
from docweave.operators import regulations as R
from pyspark.sql import functions as F


def test_regulation_chunks(spark):
    text = "Footer\n前面的话。\n第一条 总则\n本办法适用于全部人员。\n（一）第一项内容；\n（二）第二项内容。\n— 3 —\nFooter\n第二条 附加\nFooter\nFooter\n2024-01-02\n12\n第三条 很长\n" + "这是一句话。" * 30
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain text only"), (4, "plain text only")], "doc_id long, text string")
    rows = R.regulation_chunks(docs.where("doc_id <= 3"), 60).orderBy("doc_id", "chunk_index").collect()
    got = [(r["heading"], r["text"]) for r in rows]
    assert got[:3] == [(None, "前面的话。"), ("第一条 总则", "本办法适用于全部人员。\n（一）第一项内容；\n（二）第二项内容。"), ("第二条 附加", "第二条 附加")]
    assert {h for h, _ in got[3:]} == {"第三条 很长"} and "".join(t for _, t in got[3:]) == "这是一句话。" * 30 and all(len(t) <= 60 for _, t in got)
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert R.regulation_chunks(docs.limit(0)).count() == 0


def packed_plainly(rows, target):
    """Greedy packing of (doc, part, block, heading, pieces), spelt out."""
    out, n = [], {}
    parts = {}
    for doc, part, block, heading, pieces in rows:
        parts.setdefault((doc, part), []).append((block, heading, pieces))
    for (doc, _), own in sorted(parts.items()):
        chunks = []
        for _, heading, pieces in sorted(own):
            for p in pieces:
                if chunks and len(chunks[-1]) + len(p) <= target:
                    chunks[-1] += p
                else:
                    chunks.append(p)
        for text in [c.strip() for c in chunks if c.strip()] or [heading or ""]:
            if text:
                out.append((doc, n.setdefault(doc, 0), heading, text))
                n[doc] += 1
    return out


def test_packing_by_plain_python(spark):
    rng = random.Random(4)
    rows = [(doc, part, block, f"h{part}" if part else None, ["x" * rng.randrange(1, 30) + rng.choice(["\n", " ", ""]) if rng.random() > 0.2 else " \n" for _ in range(rng.randrange(4))]) for doc in range(12) for part in range(rng.randrange(5)) for block in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "doc long, part long, block long, h string, p array<string>").repartition(5)
    got = sorted(map(tuple, R.packed(df, ["doc", "part", "block"], "p", "h", 40).collect()))
    assert got == sorted(packed_plainly(rows, 40))


def test_a_long_regulation_takes_time_in_proportion(spark):
    def seconds(n):
        text = "\n".join(f"第{i}条 标题{i}" if i % 400 == 0 else f"这是第{i}行的内容，没有别的意思。" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        chunks = R.regulation_chunks(df).collect()
        assert sum(len(c["text"].replace("\n", "")) for c in chunks) > 0.8 * len(text.replace("\n", ""))
        return time.time() - began

    seconds(1000)
    assert seconds(80_000) < 20


def test_hard_wrapped_lines_are_joined(spark):
    wrapped = "\n".join(f"这一行没有结束{i}\n到这里才结束。" for i in range(20)) + "\n第一条 标题\n正文在此"
    lines = R.joined_lines(R.text_lines(spark.createDataFrame([(1, wrapped), (2, "a\nb")], "doc_id long, text string")))
    got = [r["line"] for r in lines.where("doc_id = 1").orderBy("pos").collect()]
    assert got == [f"这一行没有结束{i}到这里才结束。" for i in range(20)] + ["第一条 标题", "正文在此"]
    assert [r["line"] for r in lines.where("doc_id = 2").orderBy("pos").collect()] == ["a", "b"]


def test_questions(spark):
    def of(values, f):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("c")).collect()]

    assert of(["第一句话。第二句话", "甲乙丙丁，戊己庚辛", "短"], Q.information_units) == [["第一句话", "第二句话"], ["甲乙丙丁", "戊己庚辛"], ["短"]]
    assert of(["材料是什么？期限多长？", "申请人和审批人", "x"], Q.question_segments) == [["材料是什么", "期限多长"], ["申请人", "审批人"], []]
    assert of(["12.5%", "2024年", "3月", "三月", None], Q.number_or_date) == [True, True, True, False, None]
    assert of(["A＞B", "A / B", "A", None], Q.first_level) == ["A", "A", "A", ""]
    assert of(["a a a b", "a b", "", None, "a b c"], Q.degenerate) == [True, False, True, True, False]
    assert of(["x | y | z", "plain", "a\tb\tc", "|---|---|", "a-b"], Q.has_table) == [True, False, True, True, False]
    assert of(["北京是首都", "共有3项", "会议在北京", "", "无从判断"], Q.template_question) == ["文中提到的北京是什么？", "文中提到的关键数值或时间是多少？", "文中描述的事件发生在何时或何地？", "", "文中与“无从判断”相关的内容是什么？"]
    assert of(["red fox"], lambda c: Q.highlighted(c, F.lit("fox "))) == ["red <hl> fox <hl>"] and of(["red"], lambda c: Q.highlighted(c, F.lit("dog"))) == ["red <hl> dog <hl>"]
    pairs = of(["[QA_PAIR] Q: a A: b [QA_PAIR] Q: c\nA: d\nTheme: t [QA_PAIR] Q: e A: f"], Q.tagged_pairs)[0]
    assert [tuple(p) for p in pairs] == [("c", "d", "t"), ("e", "f", "未分类")]
    kinds = spark.createDataFrame([("判断题", ""), ("", "是否可行"), ("", "可以吗"), ("简答题", "对吗")], "k string, q string").select(Q.is_judgement(F.col("k"), F.col("q")))
    assert [r[0] for r in kinds.collect()] == [True, True, True, False]


def test_numbers_and_repeats(spark):
    def of(values, f):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("c")).collect()]

    assert of(["12", "1.5", "1.5%", "2024年", "24年", "123月", "1日", "%", "年", "", "1.年", "x"], Q.number_or_date) == [True, True, True, True, False, False, True, False, False, False, False, False]
    assert of(["在此于彼", "于彼在此", "甲 是乙", "A是B", "12是什么", "是"], Q.template_question) == [
        "文中描述的事件发生在何时或何地？", "文中描述的事件发生在何时或何地？", "文中与“甲 是乙”相关的内容是什么？", "文中与“A是B”相关的内容是什么？", "文中提到的12是什么？", "文中与“是”相关的内容是什么？",
    ]
    assert of(["a " * 70_000 + "b " * 29_999, "a " * 69 + "b " * 31, "x y z"], Q.degenerate) == [True, False, False]

"""Column functions on texts and numbers, with hand-checked cases beyond Latin letters."""

import pytest

from docweave.functions import numbers as N
from docweave.functions import signals as S
from docweave.functions import text as T
from docweave.operators import items, scoring
from pyspark.sql import functions as F


def of(spark, values, *columns, schema="x string"):
    rows = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    got = [tuple(r) if len(columns) > 1 else r[0] for r in rows.collect()]
    return got


def test_tokens(spark):
    texts = ["Red FOX_1 a", "北京大学", "中", "中文", "go北京2b", None, ""]
    want = [["red", "fox_1"], ["北京", "京大", "大学", "北京大", "京大学"], ["中"], ["中文"], ["go", "北京", "2b"], None, []]
    assert of(spark, texts, T.lexical_tokens(F.col("x"))) == want
    assert of(spark, ["北京大学 北京", "ab ab"], T.quality_tokens(F.col("x"))) == [["北京", "京大", "大学"], ["ab"]]
    assert of(spark, ["a b  c", "北京", " ", None, "a"], T.metric_tokens(F.col("x"))) == [["a", "b", "c"], ["北", "京"], [], [], ["a"]]


def test_normal_forms(spark):
    assert of(spark, ["  Москва,　Париж! ", "北京。", None, "½ a_b"], T.normalised(F.col("x"))) == ["москва париж", "北京", None, "½ a_b"]
    assert of(spark, ["第 一条，（A）", None], T.grounding_form(F.col("x"))) == ["第一条,(a)", ""]
    assert of(spark, ["北京-A 1é", None], T.anchor_form(F.col("x"))) == ["北京a1", ""]
    assert of(spark, ["Hello, World  of {x}", "中文 标题"], T.slug(F.col("x"))) == ["hello-world-of-x", "中文-标题"]
    assert of(spark, ["a/b c.TXT", "", None, "x" * 200], T.safe_name(F.col("x"))) == ["a_b_c.TXT", "file", "file", "x" * 120]
    assert of(spark, ["/a/b.c.txt", "noext", "d\\e.md"], T.stem(F.col("x"))) == ["b.c", "noext", "e"]
    assert of(spark, ["é中a", "abc", ""], T.cut_bytes(F.col("x"), 4)) == ["é", "abc", ""] and of(spark, ["中文"], T.cut_bytes(F.col("x"), 3)) == ["中"]
    assert of(spark, ["a" * 5 + "b" * 5, "ab"], T.excerpt(F.col("x"), 4)) == ["aa...bb", "ab"]
    assert of(spark, ["A, b；a;\n C ", None], T.terms(F.col("x"))) == [["A", "b", "C"], None]
    assert of(spark, ["a > b ＞ c", "", None], T.title_parts(F.col("x")), T.parent_title(F.col("x"))) == [(["a", "b", "c"], "a > b"), ([], ""), ([], "")]
    assert of(spark, ["<b>x</b> **y** *z* `c`\n\n\n\n# H"], T.without_markdown(F.col("x"))) == ["x y z c\n\nH"]
    assert of(spark, ["一句。两句！three. four"], T.sentences(F.col("x"))) == [["一句。", "两句！", "three.", "four"]]


def test_images(spark):
    text = 'a <div><img src="imgs/p1.png"/></div> b <div><img src="seal_2.png"></div> c <div><img src="p2.jpg"></div>'
    marked = "a [[IMAGE_REF:p1]] b  c [[IMAGE_REF:p2]]"
    assert of(spark, [text], T.images_marked(F.col("x"))) == [marked]
    assert of(spark, [marked], T.image_refs(F.col("x"))) == [["p1", "p2"]]
    got = of(spark, [marked], T.around_image(F.col("x"), F.lit("p1"), 4), T.around_image(F.col("x"), F.lit("p9"), 4))[0]
    assert tuple(got[0]) == ("a ", " b  ") and got[1] is None


def test_source_labels(spark):
    rows = [("第一条 甲。第二条 乙。", 9), ("Article 3 says", 4), ("none", 2)]
    assert of(spark, rows, T.source_label(F.col("x"), F.col("n")), schema="x string, n int") == ["第二条", "Article 3", None]


def test_signals(spark):
    texts = ["1. one", "plain words", "it is so", "见附件", "第三章 总则", "a | b\nc | d", ""]
    assert of(spark, texts, S.has_list(F.col("x"))) == [True, False, False, False, False, False, False]
    assert of(spark, texts, S.has_sentence(F.col("x"))) == [False, False, True, False, False, False, False]
    assert of(spark, texts, S.placeholder(F.col("x"))) == [False, False, False, True, False, False, True]
    assert of(spark, texts, S.title_only(F.col("x"), F.lit(""))) == [True, True, False, True, True, True, True]
    assert of(spark, texts, S.table_fragment(F.col("x"))) == [False, False, False, False, False, True, False]
    assert of(spark, ["ab1-", "", None], S.symbol_share(F.col("x"))) == [0.5, 1.0, None]


def test_numbers(spark):
    values = ["0.5", "x", "nan", None]
    assert of(spark, values, N.number_or(F.col("x"))) == [0.5, 0.0, 0.0, 0.0]
    arrays = [([1.0, 1.0, None], [True, False, True])]
    assert of(spark, arrays, N.softmax(F.col("x")), N.softmax(F.col("x"), F.col("m")), schema="x array<double>, m array<boolean>") == [([0.5, 0.5, 0.0], [1.0, 0.0, 0.0])]
    docs = ['[{"q": "a"}]', '{"items": [{"q": "b"}]}', '{"item": {"q": "c"}}', '{"q": "d"}', "broken", None]
    assert [[i["q"] for i in r or []] for r in of(spark, docs, N.json_items(F.col("x"), "q: string"))] == [["a"], ["b"], ["c"], ["d"], [], []]
    assert of(spark, ['{"f": 0.5}', '{"f": {"score": 0.25}}', '{"scores": {"f": 2}}'], N.score_in(F.col("x"), "f")) == [0.5, 0.25, None]
    assert [str(x) for x in of(spark, ["2024-01-02T03:04:05", "1704164645", "1704164645000", "never"], N.when_was(F.col("x")))] == ["2024-01-02 03:04:05"] * 3 + ["None"]


def test_ambiguous_references(spark):
    zh = ["其中包括三项", "办法分为五章，其中第一章是总则", "该办法的范围", "其他事项", "北京的面积", None, ""]
    assert of(spark, zh, items.ambiguous(F.col("x"), "zh")) == [True, False, True, False, False, False, False]
    en = ["This requires a form", "This permit application requires a form", "the rules above", "Plain question?", "that is it", None]
    assert of(spark, en, items.ambiguous(F.col("x"), "en")) == [True, False, True, False, True, False]
    assert of(spark, ["有哪些内容？", "申请材料包括哪些证件？"], items.shallow_list(F.col("x"), "zh")) == [True, False]
    assert of(spark, ["What items are there?", "Which permits must a builder hold?"], items.shallow_list(F.col("x"), "en")) == [True, False]


def test_normal_types_and_answers(spark):
    assert of(spark, ["选择题", "True/False", "", None, "calc math", "（判断）"], items.question_type(F.col("x"))) == ["单选题", "判断题", "简答题", "简答题", "计算题", "判断题"]
    assert of(spark, ["easy", "困难的", None], items.difficulty(F.col("x"))) == ["简单", "困难", "中等"]
    assert of(spark, ["正确。", "不是", "True", "maybe", None], items.judge_answer(F.col("x"), "zh")) == ["正确", "错误", "正确", None, None]
    assert of(spark, ["Yes.", "F", "对"], items.judge_answer(F.col("x"), "en")) == ["True", "False", None]
    texts = ["A. one\nB. two\nC、three\nD: four", "A.one B.two C.three D.four", "A. one\nB. two"]
    assert of(spark, texts, items.options_of_text(F.col("x"))) == [["one", "two", "three", "four"]] * 2 + [None]
    four = F.array(*map(F.lit, ("red", "green", "blue", "pink")))
    cases = [("b", ""), ("2", ""), ("选项 D", ""), (None, "Green"), (None, "C. blue"), (None, "none"), ("9", None)]
    assert of(spark, cases, items.correct_option(F.col("x"), F.col("a"), four), schema="x string, a string") == ["B", "C", "D", "B", "C", None, None]


@pytest.mark.parametrize("kind", ["text", "map", "list"])
def test_items_are_judged(spark, kind):
    four = ["red", "green", "blue", "pink"]
    value = {"text": "A. red\nB. green\nC. blue\nD. pink", "map": dict(zip("abcd", four, strict=True)), "list": four}[kind]
    none = {"text": "", "map": {"a": "red"}, "list": ["red"]}[kind]
    schema = {"text": "string", "map": "map<string,string>", "list": "array<string>"}[kind]
    base = dict(q="Which color is it?", answer="B", explanation="Green it is", fact="The color is green", type="mcq")
    change = [{}, {"q": " "}, {"explanation": None}, {"fact": ""}, {"options": none}, {"answer": "none"}, {"type": "判断", "answer": "maybe"}, {"type": "short", "answer": ""}, {"type": "short", "answer": "see above"}, {"type": "short", "answer": "green"}]
    rows = [{**base, "options": value, "n": i, **c} for i, c in enumerate(change)]
    df = spark.createDataFrame([tuple(r[c] for c in ("n", "q", "answer", "explanation", "fact", "type", "options")) for r in rows], f"n int, q string, answer string, explanation string, fact string, type string, options {schema}")
    got = items.validated(df, "en", options="options").orderBy("n").collect()
    assert [r["reason"] for r in got] == [
        "ok", "missing_question", "missing_answer_explanation", "missing_source_fact_text", "mcq_invalid_options", "mcq_invalid_correct_option", "judge_invalid_answer", "missing_answer", "ambiguous_reference_answer", "ok",
    ]
    assert (got[0]["item"]["answer"], got[0]["item"]["correct_option"], got[0]["item"]["options"]) == ("green", "B", four) and got[1]["item"] is None and got[9]["item"]["options"] is None


def test_anchored_and_shapes(spark):
    rows = [("The tower is tall", "", "the tower  is tall."), ("a; the tower is tall", "", "The tower is tall"), ("the towers are tall", "the tower was tall", "x"), ("none", "", "other"), (None, None, None)]
    assert of(spark, rows, items.anchored(F.col("x"), F.col("a"), F.col("s")), schema="x string, a string, s string") == [True, False, True, False, False]
    assert of(spark, ["one. two. three.", "one", "a;b", "a\nb", ""], items.fact_shape(F.col("x"), "point", "en")) == ["point_source_fact_multi_sentence", "ok", "point_source_fact_has_semicolon", "point_source_fact_multiline", "missing_source_fact_text"]


def test_reading_scores(spark):
    rows = [("a", "北京大学", ["北京", "上海"]), ("b", "red fox", ["the red fox", "red fox"]), ("c", "x", []), ("d", None, ["y"])]
    got = {r["k"]: (r["f1"], r["em"]) for r in scoring.reading_scores(spark.createDataFrame(rows, "k string, a string, r array<string>"), "k", "a", "r").collect()}
    assert got == {"a": (66.666667, 0.0), "b": (100.0, 100.0), "c": (0.0, 0.0), "d": (0.0, 0.0)}


def test_word_boundaries_are_those_of_ascii(spark):
    from docweave.functions import signals
    from docweave.operators import items

    df = spark.createDataFrame([("ñare here",), ("areé x",), ("xare",), ("are_",), ("It are",)], "t string")
    got = [tuple(r) for r in df.select(signals.has_sentence(F.col("t")), signals.has_facts(F.col("t"))).collect()]
    assert got == [(True, True), (True, True), (False, False), (False, False), (True, True)]
    assert [r[0] for r in spark.createDataFrame([("éwhat are items",), ("xwhat are items",)], "t string").select(items.shallow_list(F.col("t"), "en")).collect()] == [True, False]

"""Profiles of hand-made documents, and rules that read them."""

import sys
import time

from docweave.operators import classify, profile

DOCS = [
    ("a.docx", "国家电网有限公司文件\n国家电网办〔2021〕12号\n关于印发安全生产\n管理办法的通知\n各部门、各单位：\n现将办法印发。\n第一条 总则\n第二条 适用\n"),
    ("b.pdf", "— 1 —\nQ/GDW 1234—2020\n电力设备检修导则\n2020年1月1日发布\n目录\n"),
    ("dir/c.txt", "第一条 为了管理，制定本规定。\n第二条 本规定适用于全部人员。\n"),
    ("d.txt", None),
    (None, "GB/T 1234 apply\nWordDocument\nﬁne text here, with commas, and more.\n\n\n\nend  of\ttext"),
    ("e.txt", "值班日志\n日期 天气 值班记录 均已填写\n"),
    ("f.txt", "安全管理规定安全管理规定\n正文"),
]


def test_titles_and_signals(spark):
    df = spark.createDataFrame(DOCS, "source string, text string")
    got = {r["filename"]: r for r in profile.profiles(df, "source").collect()}
    assert got["a.docx"]["title"] == "关于印发安全生产管理办法的通知"
    assert got["a.docx"]["signals"].split() == ["law_style", "normative_title", "notice_style", "state_grid_name"]
    assert got["b.pdf"]["title"] == "电力设备检修导则" and got["b.pdf"]["signals"].split() == ["standard_qgdw", "standard_style"]
    assert got["dir/c.txt"]["title"] == "c" and "law_style" in got["dir/c.txt"]["signals"]
    assert (got["d.txt"]["title"], got["d.txt"]["text"], got["d.txt"]["signals"]) == ("d", "", "")
    assert got[""]["text"] == "GB/T 1234 apply\nfine text here, with commas, and more.\n\nend of text" and got[""]["signals"].split() == ["standard_gb_t", "standard_style"]
    assert got["e.txt"]["title"] == "值班日志日期天气值班记录均已填写" and "log_template" in got["e.txt"]["signals"]
    assert got["f.txt"]["title"] == "安全管理规定" and got["f.txt"]["title_head"].startswith("安全管理规定\n安全管理规定安全")


def test_spans_compete(spark):
    texts = ["城市供水\n管理条例\n第一章 总则", "关于供水的\n某某人民政府\n别的内容在此", "x\ny", "管理办法（2020年修订）管理办法\n附件", "".join(map(chr, range(0x4E00, 0x4E64)))]
    df = spark.createDataFrame([(f"s{i}.txt", t) for i, t in enumerate(texts)], "source string, text string")
    got = {r["filename"]: r["title"] for r in profile.profiles(df, "source").collect()}
    assert got == {"s0.txt": "城市供水管理条例", "s1.txt": "关于供水的", "s2.txt": "s2", "s3.txt": "管理办法(2020年修订)", "s4.txt": texts[4]}


def test_rules_read_profiles(spark):
    labels = [classify.Label("law", "a", "b", "c", rules=(classify.Rule(("law_style",), scope="signals", weight=3.0), classify.Rule(("办法",), scope="title", weight=3.0))), classify.Label("std", "a", "b", "d", rules=(classify.Rule(("standard_qgdw",), scope="signals", weight=5.0),))]
    out = classify.classify(profile.profiles(spark.createDataFrame(DOCS, "source string, text string"), "source"), labels)
    assert {r["filename"]: r["label_id"] for r in out.where("label_id IS NOT NULL").collect()} == {"a.docx": "law", "b.pdf": "std"}
    assert profile.profiles(spark.createDataFrame(DOCS, "source string, text string").limit(0), "source").count() == 0


def test_points_of_lines_without_chinese():
    points = {"Kopf": 3.0, "Kopf1": 2.5, "Kopf➊": 2.5, "Kopf١": 2.5, "Kopf;": 0.0, "a,b,c": 0.0, "ab,cd": 3.0, "《Kopf》": 1.5, "Kopf、b": 0.5, "GB1": -5.0, "ab": -5.0, "é" * 91: -1.5, "办法": -5.0, "é办法": 5.0}
    assert {x: profile.title_points(x) for x in points} == points


def test_lines_are_judged_in_few_steps():
    """Twenty lines cost the same number of calls whatever their length (it was 11,443 and 47,983: one for every character, and every pattern was tried on every span)."""

    def steps(text):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            assert profile.title_of(text, "a.txt")
        finally:
            sys.setprofile(None)
        return n

    short, long = (steps("\n".join(f"{chr(97 + i)} " + ", ".join(["a text without any digit"] * n) for i in range(20))) for n in (5, 50))
    assert short == long < 3000


def test_long_lines_take_time_in_proportion():
    began = time.perf_counter()
    line = "关于供水" * 10000
    assert profile.normal_title(f"一{line}令") == f"一{line}令" and profile.normal_title(f"一{line}国务院令") == f"一{line}" and profile.normal_title(f"一{line}公告（第3号）") == ""
    assert time.perf_counter() - began < 1  # was 4 s: every place of the line was tried as the start of an order's number

"""Column functions on questions, answers and what models return. Null in, null out, unless they say otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, given, strip

# Marks and words that questions are cut at (fixed values).
MARKS = "，。？！；,;?!"
JOINERS = ("和", "与", "以及", "还有", "或者", "或", "及")


def _parts(text: Column, marks: str) -> Column:
    return F.filter(F.transform(F.split(text, f"[{marks}]"), strip), lambda x: x != "")


def information_units(text: Column) -> Column:
    """Sentences, or clauses between commas where there is one sentence, of over three characters; the whole text if none is left."""
    ends, commas = _parts(text, "。；！？;!?"), _parts(text, "，,")
    long = F.filter(F.when(F.size(ends) <= 1, commas).otherwise(ends), lambda x: F.length(x) > 3)
    return F.when(F.size(long) > 0, long).otherwise(F.array(text))


def question_segments(question: Column) -> Column:
    """What stands between marks, else around the first joining word there is; segments of over two characters."""
    out = _parts(question, MARKS)
    joined = F.lit(None).cast("array<string>")
    for word in reversed(JOINERS):
        joined = F.when(F.contains(question, F.lit(word)), _parts(F.replace(question, F.lit(word), F.lit("，")), "，")).otherwise(joined)
    return F.filter(F.when(F.size(out) > 1, out).otherwise(F.coalesce(joined, out)), lambda x: F.length(x) > 2)


#: Marks that may follow a bare number: of a share, a year with four digits, a month or day with up to two (fixed values).
NUMBER_MARKS = (("%", "digits"), ("年", "four"), ("月", "two"), ("日", "two"))


def number_or_date(text: Column) -> Column:
    """Whether a text is nothing but a number, with decimals or not, a share, a year, a month or a day."""
    last = F.right(text, F.lit(1))
    bare = F.substring(text, F.lit(1), F.length(text) - 1)
    kinds = {"digits": lambda c: c.rlike(r"^\d+(\.\d+)?$"), "four": lambda c: c.rlike(r"^\d+$") & (F.length(c) == 4), "two": lambda c: c.rlike(r"^\d+$") & (F.length(c) <= 2)}
    marked = [(last == mark) & kinds[kind](bare) for mark, kind in NUMBER_MARKS]
    return reduce(lambda a, b: a | b, marked, kinds["digits"](text))


def first_level(category: Column) -> Column:
    """The part of a category before its first separator; empty for null."""
    return strip(F.element_at(F.split(F.regexp_replace(F.coalesce(category, F.lit("")), "[＞／>\\\\]", "/"), "/"), 1))


def is_judgement(kind: Column, question: Column) -> Column:
    """Whether an item asks for true or false, by its type or else by its question."""
    k, q = strip(F.coalesce(kind, F.lit(""))), strip(F.coalesce(question, F.lit("")))
    return F.when(k != "", F.contains(k, F.lit("判断")) | (k == "是非题")).otherwise(q.rlike("^是否|[吗么]$"))


def degenerate(response: Column) -> Column:
    """Whether a response is blank, or one word is over 70 % of its three words or more."""
    words = F.array_sort(F.filter(F.split(strip(F.coalesce(response, F.lit(""))), f"[{WHITE}]+"), lambda x: x != ""))
    # a word that is over half of all is the middle one of the sorted words
    share = lambda ws: given(F.get(ws, F.floor(F.size(ws) / 2).cast("int")), lambda m: F.size(F.filter(ws, lambda w: w == m)) / F.greatest(F.size(ws), F.lit(1)))
    return given(words, lambda ws: (F.size(ws) == 0) | ((F.size(ws) >= 3) & (share(ws) > 0.7)))


def has_table(response: Column) -> Column:
    """Whether a line has two bars, two tabs, or is a rule of a table."""
    return response.rlike(r"(?m)^[^\n|]*\|[^\n|]*\||^[^\n\t]*\t[^\n\t]*\t|^[ \t]*[|+:\- ]*-{3,}[|+:\- ]*$")


# Questions about a statement, around the part of it that they name (fixed values).
ASK_WHAT, ASK_NUMBER, ASK_PLACE, ASK_ABOUT = "文中提到的%s是什么？", "文中提到的关键数值或时间是多少？", "文中描述的事件发生%s何时或何地？", "文中与“%s”相关的内容是什么？"


def template_question(sentence: Column) -> Column:
    """A question about a statement: what something is, a number, a time or place, or the content beside its beginning. Empty for an empty one.

    Each form has the part that it names, null where the form doesn't fit; the first form that fits asks.
    """
    subject = strip(F.regexp_extract(sentence, "(?s)^(.*?)是", 1))
    where = F.nullif(F.regexp_extract(F.concat_ws("", *[F.when(F.contains(sentence, F.lit(w)), w) for w in ("在", "于")]), "^(.)", 1), F.lit(""))
    forms = [
        (ASK_WHAT, F.when(F.length(subject).between(2, 24), subject)), (ASK_NUMBER, F.when(sentence.rlike("[0-9]"), "")), (ASK_PLACE, where), (ASK_ABOUT, F.substring(sentence, 1, 24)),
    ]
    asked = [F.when(part.isNotNull(), F.format_string(form, part) if "%s" in form else F.lit(form)) for form, part in forms]
    return F.when(sentence == "", "").otherwise(F.coalesce(*asked))


def highlighted(context: Column, answer: Column) -> Column:
    """The context with marks around the answer's first place, or the marked answer behind it; unchanged for a blank answer."""
    a = strip(F.coalesce(answer, F.lit("")))
    at, mark = F.instr(context, a), F.concat(F.lit("<hl> "), a, F.lit(" <hl>"))
    inside = F.concat(F.substring(context, F.lit(1), at - 1), mark, F.substring(context, at + F.length(a), F.length(context)))
    return F.when(a == "", context).when(at > 0, inside).otherwise(F.concat_ws(" ", context, mark))


def tagged_pairs(response: Column) -> Column:
    """Array of q, a, theme of the tagged pairs of a response but the first, which repeats what was asked for."""
    blocks = F.slice(F.split(response, r"\[QA_PAIR\]"), 3, 10**6)
    field = lambda b, p: strip(F.regexp_extract(b, p, 1))
    theme = lambda b: F.when(field(b, r"(?s)Theme:\s*(.*)$") == "", "未分类").otherwise(field(b, r"(?s)Theme:\s*(.*)$"))
    pairs = F.transform(blocks, lambda b: F.struct(field(b, r"(?s)Q:\s*(.*?)\s*A:").alias("q"), field(b, r"(?s)A:\s*(.*?)\s*(?:Theme:.*)?$").alias("a"), theme(b).alias("theme")))
    return F.filter(pairs, lambda p: (p["q"] != "") & (p["a"] != ""))

"""Answer spans of a context, and the excerpt of a premise that speaks of a hypothesis. Column expressions; all lists are bounded by the text they come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import CJK, WHITE, given, strip

# What an answer looks like: titles, dates, sums, shares, counted things, institutions and masked names (fixed values).
SPAN_PATTERNS = (
    "《[^》]{2,60}》", r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{4}年\d{1,2}月", r"\d{4}年", r"\d{1,2}月\d{1,2}日", r"\d+(?:\.\d+)?(?:万|亿)?元", r"\d+(?:\.\d+)?%",
    r"\d+(?:\.\d+)?(?:万|亿)?(?:人|次|个|条|份|公里|米|吨|小时|分钟|天|岁)", f"[{CJK}]{{2,20}}(?:公司|法院|医院|银行|基金|大学|学院|委员会|集团|有限公司)", f"[{CJK}]{{1,4}}[xX×]{{1,3}}\\d*",
)
# What makes a span likely, and by how much (fixed values).
LIKELY = ((6, "《.*》|》.*《"), (4, r"\d"), (2, "[一二三四五六七八九十百千万亿零〇两]"), (2, "年|月|日|元|%|人|次|公里|米|吨"), (2, "公司|法院|银行|医院|基金|大学|学院|委员会|集团"), (1, "[xX×]"))
MARKUP = "<hl>|<answer>"


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]+", " "))


def span_score(span: Column) -> Column:
    """How much a span looks like an answer; length counts for 2 to 8 characters and against more than 20. -999 for a blank one."""
    points = reduce(lambda a, b: a + b, [F.when(span.rlike(p), n).otherwise(0) for n, p in LIKELY])
    points = points + F.when(F.length(span).between(2, 8), 1).when(F.length(span) > 20, -1).otherwise(0)
    return F.when(F.coalesce(span, F.lit("")) == "", -999).otherwise(points)


def answer_spans(context: Column, patterns: tuple[str, ...] = SPAN_PATTERNS, most: int = 20, least: int = 2, longest: int = 30) -> Column:
    """Array of span, place (from 1, in the context with its white space collapsed), score: the ``most`` likeliest spans, longer ones first among equals, then by pattern and place.

    Patterns are tried one after the other and their spans may overlap; a text that several find counts once. Spans of fewer than ``least`` or more than ``longest`` characters and
    those with marks of a prompt are left out. Empty for a null or blank context.
    """

    def of(flat: Column) -> Column:
        found = F.flatten(F.array(*[F.regexp_extract_all(flat, F.lit(p), F.lit(0)) for p in patterns]))
        fit = F.filter(F.array_distinct(F.transform(found, strip)), lambda s: F.length(s).between(least, longest) & ~s.rlike(MARKUP))
        rated = F.transform(fit, lambda s, i: F.struct((-span_score(s)).alias("a"), (-F.length(s)).alias("b"), i.alias("i"), s.alias("s")))
        return F.transform(F.slice(F.array_sort(rated), 1, most), lambda x: F.struct(x["s"].alias("span"), F.instr(flat, x["s"]).alias("place"), (-x["a"]).alias("score")))

    return given(collapsed(context), of)


def question_of(output: Column) -> Column:
    """The question in a generator's output: its first line without a heading and marks around it, with a question mark. Empty for a blank one."""
    first = strip(F.element_at(F.split(strip(F.coalesce(output, F.lit(""))), "\r\n|\r|\n"), 1))
    bare = F.regexp_replace(F.regexp_replace(first, "^(?:question:|Question:|问题:|问题：)", ""), "^[ \t\r\n：:，,]+|[ \t\r\n：:，,]+$", "")
    return F.when(bare == "", "").when(bare.rlike("[?？]$"), bare).otherwise(F.concat(bare, F.lit("？")))


# ---- premises

SENTENCE_ENDS, CLAUSE_ENDS = "。！？!?；;", "，,；;"
MARKS_ZH = "[，,。.！？!?；;：:\\x{3000}“”\"'‘’（）()《》【】\\[\\]…\\-—_]+"


def _parts(text: Column, ends: str) -> Column:
    """Pieces that end behind one of ``ends``, trimmed, without blank ones."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+$"), F.lit(0)), strip), lambda p: p != "")


def premise_units(text: Column, least: int = 8, most: int = 256) -> Column:
    """Array of a premise's units: sentences of runs of white-space-free lines, or clauses of a sentence of 160 characters or more that stands alone; units of under ``least`` characters and repeats are left out.

    White space is one space first, so the premise is one line. Empty for a null or blank text. ``most`` units, as the excerpt reads no more of a premise than that.
    """

    def cut(flat: Column) -> Column:
        sentences = _parts(flat, SENTENCE_ENDS)
        clauses = _parts(flat, CLAUSE_ENDS)
        units = F.when((F.size(sentences) <= 1) & (F.length(flat) >= 160) & (F.size(clauses) > 0), clauses).otherwise(sentences)
        return F.array_distinct(F.slice(F.filter(units, lambda u: F.length(u) >= least), 1, most))

    return given(collapsed(text), cut)


def signature(text: Column, language: str) -> Column:
    """Set of signature tokens: bigrams of Chinese without marks and white space, or runs of a-z and 0-9 (256 of them, with repeats, at most)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if language == "zh":
        compact = F.regexp_replace(F.regexp_replace(low, f"[{WHITE}]+", ""), MARKS_ZH, "")
        pairs = given(compact, lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
        return given(compact, lambda c: F.when(c == "", F.array().cast("array<string>")).when(F.length(c) <= 2, F.array(c)).otherwise(F.array_distinct(pairs)))
    return F.array_distinct(F.slice(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), 1, 256))


def premise_excerpt(premise: Column, hypothesis: Column, language: str, ranked: int = 2, neighbours: int = 1, chars: int = 360, least: int = 8) -> Column:
    """Struct excerpt, units (how many there are), chosen (numbers, from 0, of those in the excerpt), best (struct score, unit of each chosen one, 220 characters, best first, 8 at most).

    The ``ranked`` units that share the largest part of the hypothesis's signature, the earlier ones among equals, are taken with their ``neighbours`` on either side; runs that
    touch become one. They are joined by line ends in order until ``chars`` would be passed; the first one is always whole. Without units, the premise's first ``chars``
    characters. Nulls count as blank.
    """

    def of_units(units: Column, told: Column) -> Column:
        share = lambda u: F.when(F.size(told) == 0, 0.0).otherwise(F.size(F.array_intersect(told, signature(u, language))) / F.size(told))
        rated = F.transform(units, lambda u, i: F.struct((-share(u)).alias("s"), i.alias("i"), u.alias("u")))
        return given(rated, lambda rs: of_rated(rs, F.transform(F.slice(F.array_sort(rs), 1, ranked), lambda x: x["i"])))

    def of_rated(rs: Column, top: Column) -> Column:
        near = F.filter(rs, lambda r: F.exists(top, lambda t: F.abs(t - r["i"]) <= neighbours))
        begin = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast(KEPT).alias("kept"))

        def take(state: Column, r: Column) -> Column:
            n = state["n"] + F.length(r["u"]) + F.when(F.size(state["kept"]) > 0, 1).otherwise(0)
            full = state["full"] | ((F.size(state["kept"]) > 0) & (n > chars))
            return F.struct(F.when(full, state["n"]).otherwise(n).alias("n"), full.alias("full"), F.when(full, state["kept"]).otherwise(F.array_append(state["kept"], r)).alias("kept"))

        return F.aggregate(near, begin, take, lambda s: s["kept"])

    def whole(flat: Column) -> Column:
        units = premise_units(flat, least)
        kept = given(units, lambda us: given(signature(hypothesis, language), lambda told: of_units(us, told)))
        best = lambda ks: F.transform(F.slice(F.array_sort(ks), 1, 8), lambda k: F.struct((-k["s"]).alias("score"), F.substring(k["u"], 1, 220).alias("unit")))
        text = lambda ks: F.when(F.size(ks) == 0, F.substring(flat, 1, chars)).otherwise(F.array_join(F.transform(ks, lambda k: k["u"]), "\n"))
        return given(kept, lambda ks: F.struct(text(ks).alias("excerpt"), F.size(units).alias("units"), F.transform(ks, lambda k: k["i"]).alias("chosen"), best(ks).alias("best")))

    return given(collapsed(premise), whole)


KEPT = "array<struct<s:double,i:int,u:string>>"

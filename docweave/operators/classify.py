"""Classification of documents by rules, and its evaluation.

The rules are configuration: a bounded list that is compiled into column expressions, so that documents
meet no table of rules and nothing is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import collapse

ALGORITHMS = ("none", "any", "all", "exact", "regex", "fuzzy")
_SCORED = "array<struct<score:double,priority:int,id:string,level1:string,level2:string,level3:string>>"


@dataclass(frozen=True)
class Rule:
    """``terms`` in the text of ``scope`` (a column) add ``weight``; a regular expression is the single term of its rule."""

    terms: tuple[str, ...]
    algorithm: str = "any"
    weight: float = 1.0
    scope: str = "text"
    threshold: float = 0.85
    case_sensitive: bool = False

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"no algorithm: {self.algorithm}")


@dataclass(frozen=True)
class Label:
    id: str
    level1: str
    level2: str
    level3: str
    priority: int = 0
    rules: tuple[Rule, ...] = ()
    excludes: tuple[Rule, ...] = field(default=())


@pandas_udf(StringType())
def compatible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC form; Spark has no function for it."""
    for texts in parts:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def matching_form(text: Column, case_sensitive: bool = False) -> Column:
    """NFKC with single blanks, in lower case unless case counts; ASCII texts stay in the JVM."""
    form = F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(compatible(text))
    return collapse(form if case_sensitive else F.lower(form))


def _form(term: str, case_sensitive: bool) -> str:
    out = " ".join(unicodedata.normalize("NFKC", term).split())
    return out if case_sensitive else out.lower()


def closest(needle: str, text: str) -> float:
    """Largest matching-blocks ratio of the needle with a window of its own length; windows begin where its characters are found."""
    if needle in text:
        return 1.0
    n, best = len(needle), 0.0
    m = SequenceMatcher(None, "", needle)
    for at in sorted({max(0, min(b - a, len(text) - n)) for a, b, size in SequenceMatcher(None, needle, text, autojunk=False).get_matching_blocks() if size}):
        m.set_seq1(text[at : at + n])
        best = max(best, m.ratio())
    return best


def matches(rule: Rule, raw: Column, form: Column) -> Column:
    """Whether a rule holds; a regular expression reads the raw text, all others the matching form. False for empty texts, terms and algorithm none."""
    terms = [t for t in (_form(t, rule.case_sensitive) for t in rule.terms) if t]
    if rule.algorithm == "none" or not terms:
        return F.lit(False)
    if rule.algorithm == "regex":
        return F.coalesce(raw.rlike(("" if rule.case_sensitive else "(?i)") + "|".join(rule.terms)), F.lit(False))
    if rule.algorithm == "fuzzy":

        @pandas_udf("boolean")
        def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield texts.map(lambda t: bool(t) and max(closest(n, t) for n in terms) >= rule.threshold).astype(bool)

        return near(form)
    found = [F.contains(form, F.lit(t)) for t in ([" ".join(terms)] if rule.algorithm == "exact" else terms)]
    return F.coalesce(reduce((lambda a, b: a & b) if rule.algorithm == "all" else (lambda a, b: a | b), found), F.lit(False))


def classify(docs: DataFrame, labels: list[Label], least: float = 4.0, fallback: tuple[str, str, str] = ("", "", "")) -> DataFrame:
    """``docs`` with label_id, level1, level2, level3, score, and the confidences route, level2_confidence, level3_confidence, label_confidence.

    A label scores the weights of its rules that hold, less those of its excludes, plus a hundredth of its priority; below ``least`` it scores
    nothing. The best label, by score and priority, then by id, gives all three levels; a confidence is top / (top + second + 1), where the second
    is the best of another first level, of another second level in that first level, and so on. Without a label: the fallback and 0.
    """
    scopes = sorted({(r.scope, r.case_sensitive) for x in labels for r in (*x.rules, *x.excludes)})
    forms = {s: f"__form{i}" for i, s in enumerate(scopes)}
    rows = docs.withColumns({forms[s]: matching_form(F.coalesce(F.col(s[0]), F.lit("")), s[1]) for s in scopes})
    points = lambda rules: reduce(lambda a, b: a + b, [F.when(matches(r, F.col(r.scope), F.col(forms[r.scope, r.case_sensitive])), r.weight).otherwise(0.0) for r in rules], F.lit(0.0))
    scored = [F.struct(F.round(points(x.rules) - points(x.excludes) + 0.01 * x.priority, 4).alias("score"), F.lit(x.priority).alias("priority"), *[F.lit(getattr(x, c)).alias(c) for c in ("id", "level1", "level2", "level3")]) for x in labels]
    rows = rows.withColumn("__s", F.filter(F.array(*scored).cast(_SCORED) if scored else F.array().cast(_SCORED), lambda x: (x["score"] > 0) & (x["score"] >= least)))
    # sorting ascending by (-score, -priority, id) puts the best first
    best = F.array_sort("__s", lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["priority"] != b["priority"], F.when(a["priority"] > b["priority"], -1).otherwise(1)).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    rows = rows.withColumn("__s", best).withColumn("__b", F.try_element_at("__s", F.lit(1)))
    b = F.col("__b")
    same = lambda x, *cs: reduce(lambda p, q: p & q, [x[c] == b[c] for c in cs], F.lit(True))
    second = lambda test: F.coalesce(F.array_max(F.transform(F.filter("__s", test), lambda x: x["score"])), F.lit(0.0))
    sure = lambda other: F.when(b.isNull(), 0.0).otherwise(F.round(b["score"] / (b["score"] + other + 1), 4))
    out = rows.withColumns({
        "label_id": b["id"], **{c: F.coalesce(b[c], F.lit(f)) for c, f in zip(("level1", "level2", "level3"), fallback, strict=True)}, "score": F.coalesce(b["score"], F.lit(0.0)),
        "route": sure(second(lambda x: ~same(x, "level1"))), "level2_confidence": sure(second(lambda x: same(x, "level1") & ~same(x, "level2"))),
        "level3_confidence": sure(second(lambda x: same(x, "level1", "level2") & ~same(x, "level3"))), "label_confidence": sure(F.coalesce(F.try_element_at("__s", F.lit(2))["score"], F.lit(0.0))),
    })
    return out.drop("__s", "__b", *forms.values())


#: Prefixes of standard numbers and what they say, the first that is found (fixed values).
STANDARDS = (("国家标准(推荐)", r"\bGB/T\s*\d"), ("国家标准(指导)", r"\bGB/Z\s*\d"), ("国家标准", r"\bGB\s*\d"), ("团体标准", r"\bT/[A-Z]{2,}\s*\d"), ("企业标准", r"\bQ/[A-Z]{2,}\s*\d"), ("地方标准", r"\bDB\d{2}(?:/T)?\s*\d?"))


def standard_kind(text: Column) -> Column:
    """The kind of standard whose number a text mentions, by the first pattern that matches; null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(STANDARDS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def vote(snippets: DataFrame, key: str, label: str, confidence: str) -> DataFrame:
    """``key``, ``label``, ``confidence``: the label with the largest sum of confidences over the key's rows, ties by the smaller label; its sum over all rows, 1 at most."""
    sums = snippets.groupBy(F.col(key).alias("k"), F.col(label).alias("l")).agg(F.sum(confidence).alias("s"), F.count("*").alias("n"))  # the snippets are read once
    sums = sums.where(F.col("k").isNotNull()).withColumn("n", F.sum("n").over(Window.partitionBy("k"))).where(F.col("l").isNotNull())
    best = Window.partitionBy("k").orderBy(F.desc("s"), "l")
    rows = sums.withColumn("r", F.row_number().over(best)).where("r = 1")
    return rows.select(F.col("k").alias(key), F.col("l").alias(label), F.round(F.least(F.lit(1.0), F.col("s") / F.col("n")), 6).alias(confidence))


def evaluation(rows: DataFrame, truth: str, predicted: str, confidence: str, source: str) -> DataFrame:
    """``source`` (null over all), ``n``, ``accuracy``, ``mean_confidence`` of predictions. A null prediction is wrong."""
    right = F.coalesce((F.col(truth) == F.col(predicted)).cast("double"), F.lit(0.0))
    return rows.rollup(source).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(confidence), 6).alias("mean_confidence"))


def top_accuracy(rows: DataFrame, truth: str, ranked: str, k: int) -> DataFrame:
    """One row: share of rows whose truth is among the first ``k`` of the array ``ranked``."""
    return rows.agg(F.round(F.avg(F.coalesce(F.array_contains(F.slice(ranked, 1, k), F.col(truth)), F.lit(False)).cast("double")), 6).alias("accuracy"))


def confusions(rows: DataFrame, truth: str, predicted: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent pairs of a truth and another prediction, with ``n``; ties by the names."""
    wrong = rows.where(~F.col(truth).eqNullSafe(F.col(predicted))).groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), truth, predicted).limit(k)


def label_ids(labels: DataFrame, *levels: str) -> DataFrame:
    """``labels`` with the number (from 0, by name) of each level's value: a column ``<level>_id`` each. A table of labels, not of documents."""
    out = labels
    for level in levels:
        names = labels.select(level).distinct().withColumn(f"{level}_id", F.row_number().over(Window.orderBy(level)) - 1)
        out = out.join(names, level)
    return out

"""Whether a stated fact is found in its source text."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.text import grounding_form, strip

#: Marks that end a clause, from the first division that is tried to the last; the last marks stay with what they end (fixed values).
CLAUSE_ENDS = ("；;\n", "，,、", "。.!?！？")
SENTENCE_ENDS = "。！？；.!?;"


def _between(text: Column, marks: str) -> Column:
    """What stands between the marks, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, f"[{marks}]+"), strip), lambda x: x != "")


def _ended(text: Column, marks: str) -> Column:
    """Stretches that end with one of the marks, or with the text, trimmed, without blanks."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"([^{marks}]*[{marks}]|[^{marks}]+)"), F.lit(1)), strip), lambda x: x != "")


def _first_division(tries: list[Column], text: Column) -> Column:
    """The first of the arrays that has two elements; else the whole text, if it has any."""
    whole = F.filter(F.array(strip(text)), lambda x: x != "")
    return F.coalesce(*[F.when(F.size(t) >= 2, t) for t in tries], whole)


def candidates(source: Column) -> Column:
    """Lines where there are two or more, else sentences, else the whole."""
    return _first_division([_between(source, "\r\n"), _ended(source, SENTENCE_ENDS)], source)


def segments(fact: Column, least: int = 8) -> Column:
    """Clauses of a summary: the first division of ``CLAUSE_ENDS`` that gives two clauses of ``least`` characters, blanks not counted."""
    *loose, last = CLAUSE_ENDS
    tries = [_between(fact, marks) for marks in loose] + [_ended(fact, last)]
    return _first_division([F.filter(t, lambda x: F.length(grounding_form(x)) >= least) for t in tries], fact)


def likeness(fact: str, part: str, n: int = 3) -> float:
    """The larger of the fact's n-gram recall in the part and the ratio of matching blocks, which is computed only where its bounds leave it a chance."""
    grams = [fact[i : i + n] for i in range(len(fact) - n + 1)]
    least = sum(g in part for g in grams) / len(grams) if grams else float(fact in part)
    m = SequenceMatcher(None, fact, part)
    return max(least, m.ratio()) if m.real_quick_ratio() > least and m.quick_ratio() > least else least


@pandas_udf(DoubleType())
def _likeness(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([likeness(*x) for x in zip(a, b, strict=True)], dtype="float64")


def grounding_scores(rows: DataFrame, key: str, fact: str, source: str) -> DataFrame:
    """``key``, ``score``, ``matched`` of the best part of ``source`` for each fact.

    1 where a part contains the fact, else the larger of 3-gram recall and matching-blocks ratio; a part of
    eight characters or more inside the fact matches too. Texts are compared with ASCII marks, in lower case, without white space. Only pairs without containment reach Python. Null or
    empty facts and sources score 0. ``key`` names the fact: rows that repeat it count as one.
    """
    facts = rows.select(F.col(key), grounding_form(F.col(fact)).alias("f"), candidates(F.col(source)).alias("c"))
    pairs = facts.select(key, "f", F.explode("c").alias("c")).select(key, "f", grounding_form(F.col("c")).alias("c")).where("f <> '' AND c <> ''").distinct()
    pairs = pairs.withColumn("inside", F.contains("c", "f"))
    sure = pairs.where("inside").select(key, F.lit(1.0).alias("s"), F.lit(True).alias("m"))
    rest = pairs.where("NOT inside").select(key, _likeness("f", "c").alias("s"), (F.contains("f", "c") & (F.length("c") >= 8)).alias("m"))
    best = sure.unionByName(rest).groupBy(key).agg(F.max("s").alias("s"), F.max("m").alias("m"))
    return rows.select(key).distinct().join(best, key, "left").select(key, F.coalesce(F.round("s", 6), F.lit(0.0)).alias("score"), F.coalesce("m", F.lit(False)).alias("matched"))


def grounded_points(rows: DataFrame, key: str, fact: str, source: str, least: float = 0.86) -> DataFrame:
    """``key``, ``grounded``: whether the whole fact matches or scores ``least``."""
    return grounding_scores(rows, key, fact, source).select(key, (F.col("matched") | (F.col("score") >= least)).alias("grounded"))


def grounded_summaries(rows: DataFrame, key: str, fact: str, source: str, least: float = 0.76, share: float = 0.66) -> DataFrame:
    """``key``, ``grounded``: at least two segments of the fact, and ``share`` of them, match or score ``least``.

    Facts of fewer than two segments are not grounded. ``key`` is unique.
    """
    parts = rows.select(F.col(key), F.col(source).alias("src"), F.posexplode_outer(segments(F.col(fact))).alias("pos", "seg"))
    parts = parts.select(key, F.struct(F.col(key), F.coalesce("pos", F.lit(-1)).alias("pos")).alias("part"), "seg", "src")
    found = grounding_scores(parts, "part", "seg", "src").withColumn("ok", (F.col("matched") | (F.col("score") >= least)).cast("int"))
    sums = found.groupBy(F.col(f"part.{key}").alias(key)).agg(F.sum("ok").alias("ok"), F.count("*").alias("n"))
    return sums.select(key, ((F.col("n") >= 2) & (F.col("ok") >= 2) & (F.col("ok") / F.col("n") >= share)).alias("grounded"))

"""Scores of question/answer items: of each item, of groups of one context, over a suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, number_or


def _mean(c: str) -> Column:
    """Mean of the values that are numbers, in 0..1; 0 without any."""
    return clamp(F.coalesce(F.avg(F.col(c).try_cast("double")), F.lit(0.0)))


def group_scores(items: DataFrame, group: str, order: str, precision: str = "answerability") -> DataFrame:
    """``group``, ``n_items``, ``p``, ``r``, ``f1``: the mean of the items' precision, the first recall there is (by ``order``), and 2PR / (P + R).

    ``items``: group, answerability, faithfulness, coverage_recall. Precision is answerability, its product with faithfulness, or the smaller of both.
    Scores that are missing or no numbers count 0, all are kept in 0..1. Aggregates before it shuffles, so one hot context is no single task.
    """
    a, f = number_or(F.col("answerability")), number_or(F.col("faithfulness"))
    p = clamp({"product": a * f, "min": F.least(a, f)}.get(precision, a))
    first = F.min_by("coverage_recall", F.when(F.col("coverage_recall").isNotNull(), F.col(order)))
    out = items.groupBy(group).agg(F.count("*").alias("n_items"), F.avg(p).alias("p"), clamp(number_or(first)).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return out.select(group, "n_items", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(f1, 6).alias("f1"))


def with_group_scores(items: DataFrame, group: str, order: str, precision: str = "answerability") -> DataFrame:
    """``items`` with the recall and F1 of their group."""
    scores = group_scores(items, group, order, precision).select(group, F.col("r").alias("group_recall"), F.col("f1").alias("group_f1"))
    return items.join(scores, group)


def suite_scores(items: DataFrame, group: str, order: str) -> DataFrame:
    """One row: the means over groups of the groups' means of faithfulness, p (answerability), coverage_self and coverage_score, of recall and of F1; and n_groups."""
    means = items.groupBy(group).agg(*[_mean(c).alias(c) for c in ("faithfulness", "coverage_self", "coverage_score")])
    rows = means.join(group_scores(items, group, order), group)
    names = ("faithfulness", "p", "r", "coverage_self", "coverage_score", "f1")
    return rows.agg(F.count("*").alias("n_groups"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names])


def metric_summary(rows: DataFrame, *metrics: str) -> DataFrame:
    """``metric``, ``n``, ``mean``, ``smallest``, ``largest`` of each column, nulls left out."""
    long = rows.select(F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value")).where("value IS NOT NULL")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("smallest"), F.max("value").alias("largest"))


def item_average(*metrics: str) -> Column:
    """Mean of the metrics that are not null; null without any."""
    there = F.filter(F.array(*[F.col(m).cast("double") for m in metrics]), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def map_average(scores: Column) -> Column:
    """Mean of the numbers among the values of a map of texts; null without any."""
    there = F.filter(F.transform(F.map_values(scores), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.round(F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there), 6))


def exact_means(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``m``: the mean of the values that are not null, the same however the rows are dealt and ordered.

    Values are added up as whole multiples of a power of two, which is exact, by their binary exponent; a group's few sums are added from the largest down.
    """
    x = F.col(value).cast("double")
    place = F.when((x != 0) & (F.abs(x) < float("inf")), F.floor(F.log2(F.abs(x))).cast("int"))
    sums = rows.select(*keys, x.alias("x"), place.alias("e")).groupBy(*keys, "e").agg(
        F.sum(F.when(F.col("e").isNotNull(), F.col("x") * F.pow(F.lit(2.0), 53 - F.col("e"))).cast("long").cast("decimal(20,0)")).alias("s"), F.count("x").alias("n"), F.sum("x").alias("plain")
    )
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("e", "s"))), asc=False), lambda p: p["s"].cast("double") * F.pow(F.lit(2.0), p["e"] - 53))
    out = sums.groupBy(*keys).agg(parts.alias("parts"), F.sum("n").alias("n"), F.sum("plain").alias("plain"))
    whole = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p)
    odd = F.isnan("plain") | (F.abs("plain") == float("inf"))
    return out.select(*keys, F.when(F.col("n") > 0, F.when(odd, F.col("plain")).otherwise(whole) / F.col("n")).alias("m"))


def ordered_means(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``keys``, ``m``: the mean of the values that are not null, added up as doubles one by one by ``order``, as a reader of a table in that order does.

    A group's rows are sorted and streamed in one task, since each sum depends on the one before it.
    """
    x = F.col(value).cast("double")
    upto = Window.partitionBy(*keys).orderBy(order, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(*keys, F.sum(x).over(upto).alias("s"), F.count(x).over(upto).alias("n")).groupBy(*keys).agg(F.max_by("s", "n").alias("s"), F.max("n").alias("n"))
    return sums.select(*keys, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("m"))


def fused_ratings(ratings: DataFrame, *keys: str, in_order: bool = False) -> DataFrame:
    """``keys``, ``score``, ``rating``: the mean of the positive scores of repeated ratings, and the rating nearest to it (ties by attempt); 0 and null without any.

    ``ratings``: keys, attempt, score, rating. The mean is exact, or that of scores added by attempt if ``in_order``: where two ratings lie equally far from it, its last digit decides.
    """
    scores = ratings.select(*keys, "attempt", F.when(F.col("score") > 0, F.col("score")).alias("__x"))
    means = ordered_means(scores, list(keys), "__x", "attempt") if in_order else exact_means(scores, list(keys), "__x")
    near = F.when((F.col("score") > 0), F.struct(F.abs(F.col("score") - F.col("m")), "attempt"))
    best = ratings.join(means, list(keys)).groupBy(*keys, "m").agg(F.min_by("rating", near).alias("rating"))
    return best.select(*keys, F.round(F.coalesce("m", F.lit(0.0)), 6).alias("score"), "rating")


def primary_score(method: str, llm: Column, metrics: Column, unsupervised: Column) -> Column:
    """The score that an item is filtered by: of the method llm, nlp or unsupervised; null for none."""
    return {"llm": llm, "nlp": metrics, "unsupervised": unsupervised}.get(method, F.lit(None).cast("double"))


def write_back(records: DataFrame, results: DataFrame, key: str, threshold: float | None = None, force: bool = False) -> DataFrame:
    """``records`` (key, method, average, filtered) with the results (key, method, average) of those not yet evaluated, or of all if ``force``.

    With a threshold, filtered becomes whether the new average reaches it. Records without a result stay as they are.
    """
    new = results.select(key, F.col("method").alias("__m"), F.col("average").alias("__a"))
    rows = records.join(new, key, "left")
    take = F.col("__m").isNotNull() & (F.lit(force) | (F.coalesce(F.trim("method"), F.lit("")) == ""))
    passed = F.col("filtered") if threshold is None else F.when(take, F.coalesce(F.col("__a") >= threshold, F.lit(False))).otherwise(F.col("filtered"))
    return rows.withColumns({"filtered": passed, "average": F.when(take, F.col("__a")).otherwise(F.col("average")), "method": F.when(take, F.col("__m")).otherwise(F.col("method"))}).drop("__m", "__a")


def with_summary_row(rows: DataFrame, key: str, *metrics: str, name: str = "__AVERAGE__") -> DataFrame:
    """``rows`` (key and metrics) and one more row called ``name`` with the means; null metrics are left out of a mean."""
    means = rows.agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics]).select(F.lit(name).alias(key), *metrics)
    return rows.select(F.col(key).cast("string").alias(key), *metrics).unionByName(means)


def aligned(pairs: DataFrame, key: str, least: float = 0.7, keep_best: bool = False) -> DataFrame:
    """The best generated item of each reference: ``key``, ``item``, ``alignment``, ``below``.

    ``pairs``: key, item, question_similarity, answer_similarity (null without a reference answer). alignment = 0.65 q + 0.35 a, or q alone; the
    first item wins ties. Below ``least`` the reference is dropped, or flagged if ``keep_best``.
    """
    q, a = F.col("question_similarity"), F.col("answer_similarity")
    rows = pairs.withColumn("alignment", F.round(F.when(a.isNull(), q).otherwise(0.65 * q + 0.35 * a), 6))
    best = rows.groupBy(key).agg(F.max_by(F.struct("item", "alignment"), F.struct("alignment", -F.col("item"))).alias("x")).select(key, "x.item", "x.alignment")
    out = best.withColumn("below", F.col("alignment") < least)
    return out if keep_best else out.where(~F.col("below"))


def timing(files: DataFrame, count: str, *seconds: str) -> DataFrame:
    """One row: sums of the seconds, and the seconds for each counted item (null for no item)."""
    sums = files.agg(F.sum(count).alias(count), *[F.round(F.sum(s), 3).alias(s) for s in seconds])
    return sums.select("*", *[F.round(F.when(F.col(count) > 0, F.col(s) / F.col(count)), 3).alias(f"{s}_each") for s in seconds])

"""How well questions and answers cover the units of their context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.shared import stored
from ..functions.text import WHITE, anchor_form, given
from .retrieval import dot, vector_top_each
from .scoring import anchor_counts

#: Width of the buckets that similarities in 0..1 are counted in.
BUCKETS = 1024


def context_id(text: Column) -> Column:
    """Group of a context: a digest of its text with one space for all white space; null is the empty text."""
    return F.concat(F.lit("sha1:"), F.sha1(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]+", " ")).cast("binary")))


def _dots(a: pa.Array, b: pa.Array) -> np.ndarray:
    """As ``dot``, row by row; 0 for a null array. Added up in order of the components, so that the results are the same."""
    n, sides = len(a), []
    for side in (a, b):
        size = side.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sides.append((size, side.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)))
    common, out = np.minimum(sides[0][0], sides[1][0]), np.zeros(n)
    start = [np.cumsum(size) - size for size, _ in sides]
    for j in range(int(common.max(initial=0))):
        here = np.flatnonzero(common > j)
        out[here] += sides[0][1][start[0][here] + j] * sides[1][1][start[1][here] + j]
    return out


def compared(pairs: DataFrame, dots: dict[str, tuple[str, str]], anchor: tuple[str, str] | None = None) -> DataFrame:
    """``pairs`` with inner products of the named columns and, of two columns in their anchor form, ``hits`` and ``grams``, as ``anchor_counts`` has them; the compared columns are dropped."""
    used = list(dict.fromkeys([c for ab in dots.values() for c in ab] + list(anchor or ())))
    kept = [c for c in pairs.columns if c not in used]
    added = [(n, DoubleType()) for n in dots] + ([("hits", LongType()), ("grams", LongType())] if anchor else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                columns = [pa.array(_dots(part.column(a), part.column(b))) for a, b in dots.values()]
                if anchor:
                    columns += [pa.array(x, pa.int64()) for x in anchor_counts(*(part.column(c).to_pylist() for c in anchor))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, *(n for n, _ in added)])

    schema = StructType([*(pairs.schema[c] for c in kept), *(StructField(n, t) for n, t in added)])
    return pairs.select(*kept, *used).mapInArrow(run, schema)


def best_similarity(units: DataFrame, answers: DataFrame, group: str, unit: str = "unit") -> DataFrame:
    """``group``, ``unit``, ``s``: the largest inner product of each unit's vector with an answer's vector of its group, 0 at least and without any."""
    pairs = units.select(group, unit, F.col("vector").alias("u")).join(answers.select(group, F.col("vector").alias("a")), group, "left")
    return compared(pairs, {"s": ("u", "a")}).groupBy(group, unit).agg(F.round(F.greatest(F.lit(0.0), F.max("s")), 6).alias("s"))


def centroids(units: DataFrame, group: str) -> DataFrame:
    """``group`` and the unit vector of the mean of its vectors (zero if the mean is)."""
    at = units.select(group, F.posexplode("vector").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return mean.select(group, given(norm, lambda n: F.transform("mean", lambda x: F.when(n > 0, x / n).otherwise(0.0))).alias("centroid"))


def nearest_other(centres: DataFrame, group: str) -> DataFrame:
    """``group``, ``other``: the group with the most similar centroid that is another one, ties by the smaller id. Ids are whole numbers. Compared in blocks."""
    rows = centres.select(F.col(group).cast("long").alias("g"), "centroid")
    best = vector_top_each(rows, rows.select(F.col("g").alias("query_id"), F.col("centroid").alias("query")), 2, "g", "centroid", 2048)
    return best.where("query_id <> g").groupBy(F.col("query_id").alias(group)).agg(F.min_by("g", "rank").alias("other"))


def negatives(units: DataFrame, answers: DataFrame, group: str, most: int = 24, seed: str = "negative") -> DataFrame:
    """``s``: what units would score by chance: the best similarity of up to ``most`` units of a group, first by a hash, with the answers of the group nearest to it."""
    other = nearest_other(centroids(units, group), group)
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.concat_ws("/", F.lit(seed), group, "unit"))))
    drawn = units.withColumn("__n", first).where(F.col("__n") <= most).join(other, group)
    far = answers.select(F.col(group).alias("other"), "vector")
    return best_similarity(drawn.select("other", F.struct(group, "unit").alias("unit"), "vector"), far, "other").select("s")


def share_at_most(values: DataFrame, sample: DataFrame, s: str = "s") -> DataFrame:
    """``values`` with ``share``, the share of the sample's values that are not larger; 0 for an empty sample.

    Both are counted by value and bucket first, so the running counts are taken over distinct values of one bucket at a time.
    """
    bucket = F.floor(F.col(s) * BUCKETS)
    counts = sample.groupBy(s, bucket.alias("b")).agg(F.count("*").alias("n"))
    sums = counts.groupBy("b").agg(F.sum("n").alias("n"))  # BUCKETS + 1 rows at most
    total = sums.agg(F.sum("n").alias("total"))  # one row
    wanted = values.select(s, bucket.alias("b")).distinct().withColumn("n", F.lit(0).cast("long"))
    both = counts.select(s, "b", "n").unionByName(wanted).groupBy(s, "b").agg(F.sum("n").alias("n"))
    shares = both.withColumn("here", F.sum("n").over(Window.partitionBy("b").orderBy(s))).join(F.broadcast(_prefix(both.select("b").distinct(), sums)), "b").join(F.broadcast(total))
    shares = shares.select(s, F.coalesce((F.col("before") + F.col("here")) / F.col("total"), F.lit(0.0)).alias("share"))
    return values.join(shares, s, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def _prefix(buckets: DataFrame, sums: DataFrame) -> DataFrame:
    """``b``, ``before``: values of the sums in smaller buckets; at most a row for each bucket of either."""
    rows = buckets.join(sums, "b", "full").select("b", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def coverage_recall(best: DataFrame, chance: DataFrame, group: str) -> DataFrame:
    """``group``, ``recall``, ``n``: the mean over units of sqrt(s * share of negatives that are not larger than s)."""
    rows = share_at_most(best, chance).withColumn("p", F.sqrt(F.least(F.lit(1.0), F.col("s")) * F.col("share")))
    return rows.groupBy(group).agg(F.round(F.avg("p"), 6).alias("recall"), F.count("*").alias("n"))


def coverage_self(units: DataFrame, items: DataFrame, chance: DataFrame, recall: DataFrame, group: str) -> DataFrame:
    """``group``, ``item``, ``self``, ``score``: how far an item covers the units that are relevant to it, and sqrt(recall * self).

    ``units``: group, unit, text, vector. ``items``: group, item, answer, question_vector, answer_vector, vector (of question and answer). The relevance
    of a unit is the mean of its similarity to the question, the larger of its similarity to the answer and the lexical anchor, and
    p = sqrt(s * share). Weights are what relevance exceeds its mean over the units, else relevance itself, else equal.
    """
    u = units.select(group, "unit", anchor_form(F.col("text")).alias("t"), F.col("vector").alias("u"))
    pairs = u.join(items.select(group, "item", "vector", "question_vector", "answer_vector", anchor_form(F.col("answer")).alias("answer")), group)
    pairs = compared(pairs, {"s": ("u", "vector"), "q": ("u", "question_vector"), "a": ("u", "answer_vector")}, ("t", "answer"))
    near = lambda c: F.greatest(F.lit(0.0), F.col(c))
    rows = pairs.select(group, "unit", "item", F.round(near("s"), 6).alias("s"), near("q").alias("q"), F.greatest(near("a"), F.round(F.col("hits") / F.col("grams"), 6)).alias("a"))
    rows = stored(rows, "pairs")  # read four times
    rows = share_at_most(rows, chance).withColumn("p", F.sqrt(F.least(F.lit(1.0), F.col("s")) * F.col("share"))).withColumn("r", (F.col("q") + F.col("a") + F.col("p")) / 3)
    means = rows.groupBy(group, "item").agg(F.avg("r").alias("mean"), F.sum("r").alias("mass"), F.avg("p").alias("flat"))
    rows = rows.join(means, [group, "item"]).withColumn("c", F.greatest(F.lit(0.0), F.col("r") - F.col("mean")))
    out = rows.groupBy(group, "item").agg(F.sum("c").alias("cm"), F.sum(F.col("c") * F.col("p")).alias("cp"), F.first("mass").alias("mass"), F.sum(F.col("r") * F.col("p")).alias("rp"), F.first("flat").alias("flat"))
    own = F.when(F.col("cm") > 1e-12, F.col("cp") / F.col("cm")).when(F.col("mass") > 0, F.col("rp") / F.col("mass")).otherwise(F.col("flat"))
    out = out.withColumn("self", own).join(recall.select(group, "recall"), group, "left")
    return out.select(group, "item", F.round("self", 6).alias("self"), F.round(F.sqrt(F.coalesce("recall", F.lit(0.0)) * F.least(F.lit(1.0), F.col("self"))), 6).alias("score"))


def worst_units(best: DataFrame, group: str, k: int = 5) -> DataFrame:
    """The ``k`` units of each group with the smallest ``s``, ties by the unit."""
    order = Window.partitionBy(group).orderBy("s", "unit")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

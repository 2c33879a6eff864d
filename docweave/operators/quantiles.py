"""Exact quantiles without a task that holds a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import shared_folder

#: Bins that a range is cut into in a round, and rounds at most: 64 bits are narrowed to one value.
BINS = 256
ROUNDS = 12


def exact_quantiles(rows: DataFrame, value: str, quantiles: list[float], *keys: str) -> DataFrame:
    """``keys``, ``q`` and ``quantile``: the quantiles of a numeric column by key, interpolated between the two nearest values (as a double); null where a key has no value.

    The two values around a quantile are found by rank: the range in which each lies is cut into bins, the bins are counted, and the one with the rank becomes the range, until it
    holds a single value. A round is a partial aggregate over at most ``BINS`` bins for each key and quantile. Nulls and NaN are left out; null keys are keys.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "quantiles")
    names = [f"__k{i}" for i in range(len(keys))]
    rows.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).write.parquet(f"{folder}/values")
    held = spark.read.parquet(f"{folder}/values")
    sizes = held.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), ((F.col("n") - 1) * q).alias("at")) for q in quantiles]))
    asked = sizes.select(*names, "n", "lo", "hi", ranks.alias("x")).select(*names, "n", "lo", "hi", "x.q", "x.at")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("at").alias("rank"))))
    ranges = asked.where("n > 0").select(*names, "q", "lo", "hi", sides.alias("s")).select(*names, "q", "lo", "hi", "s.side", "s.rank")
    ranges.write.parquet(f"{folder}/0")
    for i in range(ROUNDS):
        now = spark.read.parquet(f"{folder}/{i}")
        if now.where("lo < hi").isEmpty():
            break
        spans = now.where("lo < hi").select(*names, "lo", "hi").distinct().withColumnsRenamed({n: f"{n}r" for n in names})
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names], F.lit(True))
        inside = held.join(F.broadcast(spans) if not names else spans, same & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        width = F.col("hi") / BINS - F.col("lo") / BINS
        place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("lo")) / width)))
        counted = inside.groupBy(*[f"{n}r" for n in names], "lo", "hi", F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        bins = counted.groupBy(*[f"{n}r" for n in names], "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("bin", "c", "least", "most"))).alias("bins")).withColumnsRenamed({"lo": "lo_", "hi": "hi_"})
        both = now.join(bins, same & (F.col("lo") == F.col("lo_")) & (F.col("hi") == F.col("hi_")), "left")
        begin = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(0).cast("long").alias("rank"))
        inner = lambda s, x: F.when(s["a"].isNotNull(), s).when(F.col("rank") < s["before"] + x["c"], F.struct(s["before"], x["least"].alias("a"), x["most"].alias("b"), (F.col("rank") - s["before"]).alias("rank"))).otherwise(F.struct((s["before"] + x["c"]).alias("before"), s["a"], s["b"], s["rank"]))
        found = F.aggregate("bins", begin, inner)
        narrowed = both.withColumn("f", F.when(F.col("bins").isNotNull(), found))
        narrowed.select(*names, "q", F.coalesce("f.a", "lo").alias("lo"), F.coalesce("f.b", "hi").alias("hi"), "side", F.coalesce("f.rank", "rank").alias("rank")).write.parquet(f"{folder}/{i + 1}")
    else:
        i = ROUNDS
    last = spark.read.parquet(f"{folder}/{i}").groupBy(*names, "q").agg(F.max(F.when(F.col("side") == 0, F.col("lo"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("lo"))).alias("b"))
    last = last.withColumnsRenamed({**{n: f"{n}r" for n in names}, "q": "q_"})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names], F.lit(True))
    part = F.col("at") - F.floor("at")
    out = asked.join(last, same & (F.col("q") == F.col("q_")), "left")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keys, strict=True)], "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part).alias("quantile"))

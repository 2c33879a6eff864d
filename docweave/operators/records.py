"""Records: upserts, defaults, pages, tops, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from .quantiles import exact_quantiles


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win, null new values keep the old one. Columns that only one side has are kept, null for the other's rows. Null keys meet nothing.

    A key that ``new`` has more than once is one row there: of each column the value that isn't null, by the row whose JSON text sorts last; ``old`` is taken as it is.
    """
    some = new.where(F.col(key).isNotNull())
    rest = [c for c in new.columns if c != key]
    last = F.to_json(F.struct(*new.columns))
    once = some.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), last)).alias(c) for c in rest]) if rest else some.distinct()
    new = once.unionByName(new.where(F.col(key).isNull()))
    n = new.select(*[F.col(c).alias(c if c == key else f"__n_{c}") for c in new.columns])
    out = old.join(n, key, "full_outer")
    every = [*old.columns, *[c for c in new.columns if c not in old.columns]]
    value = lambda c: F.coalesce(*[F.col(x) for x, there in ((f"__n_{c}", c in new.columns), (c, c in old.columns)) if there]).alias(c)
    return out.select(key, *[value(c) for c in every if c != key])


def replace_by_id(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; repeated keys of ``new`` stay repeated, null keys replace nothing."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(rows: DataFrame, key: str, ids: DataFrame, **values) -> DataFrame:
    """``rows`` with the given values in the rows whose key is in ``ids``; all other rows and columns as they are."""
    marked = rows.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    out = marked.withColumns({c: F.when(F.col("__hit"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})
    return out.select(*rows.columns)


def soft_delete(meta: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``meta`` with the rows of ``ids`` inactive and their review status deleted; ids without a row get one."""
    gone = ids.select(key).distinct().select(key, F.lit(False).alias("is_active"), F.lit("deleted").alias("review_status"))
    return upsert(meta, gone, key)


def hard_delete(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left without the ids, and what was taken out, to be kept as a backup."""
    return rows.join(ids.select(key), key, "left_anti"), rows.join(ids.select(key), key, "left_semi")


def with_defaults(rows: DataFrame, side: DataFrame, key: str, defaults: dict) -> DataFrame:
    """``rows`` with the columns of ``side`` (unique keys), and the defaults where there is no row or a null."""
    return rows.join(side, key, "left").fillna(defaults)


def conjunction(conditions: list[Column]) -> Column:
    """All of the conditions; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filters(columns: dict[str, object], evaluated: Column | None = None) -> Column:
    """Conjunction of conditions by column: a list is any of, a pair ("min", x) at least, a Boolean or value equal; None means any."""
    made = []
    for name, want in columns.items():
        if want is None:
            continue
        c = F.col(name)
        made.append(c.isin(*want) if isinstance(want, list) else c >= want[1] if isinstance(want, tuple) else c == F.lit(want))
    return conjunction(made + ([] if evaluated is None else [evaluated]))


def contains_anywhere(needle: str, *columns: str) -> Column:
    """Whether any of the columns, read as one text, has the needle in any case; an empty needle is in every row."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower()))


def tri_state(column: str, state: str) -> Column:
    """all, true or false of a Boolean column; a null counts as false."""
    value = F.coalesce(F.col(column), F.lit(False))
    return {"true": value, "false": ~value}.get(state.lower(), F.lit(True))


def evaluated(method: str, scores: str) -> Column:
    """Whether an item has an evaluation: a method, or scores other than an empty JSON value."""
    return (F.coalesce(F.trim(method), F.lit("")) != "") | ~F.coalesce(F.trim(scores), F.lit("")).isin("", "{}", "null")


def page(rows: DataFrame, number: int, size: int, newest: str, key: str, most: int = 200) -> DataFrame:
    """One page, newest first, then by key descending."""
    size, number = max(1, min(size, most)), max(1, number)
    return rows.orderBy(F.desc(newest), F.desc(key)).offset((number - 1) * size).limit(size)


def top_per_key(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, the null key included; Spark cuts each task's rows to n before it shuffles."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("__r") <= n).drop("__r")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Last row by key; aggregates before it shuffles."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(key, "__x.*")


def in_ranges(number: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a number lies in one of the ranges, ends included; false for no range."""
    return reduce(lambda a, b: a | b, [number.between(a, b) for a, b in ranges], F.lit(False))


def stats(rows: DataFrame, value: str, *keys: str, exact: bool = True) -> DataFrame:
    """mean, p50 (interpolated), largest and n (rows with a null included) by key.

    The exact median is found by narrowing ranges (``quantiles.exact_quantiles``), in memory that the values don't fill; without ``exact`` it is approximate.
    """
    plain = rows.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile_approx(value, 0.5, 10_000).cast("double"), 6).alias("p50"), F.max(value).alias("largest"), F.count("*").alias("n"))
    if not exact:
        return plain
    half = exact_quantiles(rows, value, [0.5], *keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.round("quantile", 6).alias("p50"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    return plain.drop("p50").join(half, same, "left").select(*keys, "mean", "p50", "largest", "n")


def numbered(rows: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """``rows`` with their number (from 1) in the order, over the whole table: ranges of a sort are counted, then numbered on their own.

    The ranges are written to the shared folder, so that those that are counted are those that are numbered.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}).withColumn("__i", F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)))
    folder = shared_folder(spark, "numbered")
    parts.write.parquet(folder)
    parts = spark.read.parquet(folder)
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    start = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    return parts.join(F.broadcast(start), "__p").withColumn(name, F.col("__s") + F.col("__i") + 1).drop("__p", "__i", "__s")


def attribute_wall(intervals: DataFrame, key: str, start: str, stop: str, stage: str, width: int = 3600, gap: str | None = None) -> DataFrame:
    """Time of each key that each stage is charged with: slices between boundaries, shared by the stages active in them.

    ``gap`` names a stage that gets what is left of the time from a key's first start to its last stop. Times are whole numbers.

    Starts and stops are +1 and -1 of running sums; no slice meets an interval. Intervals are cut at the borders
    of windows of ``width`` seconds, which changes no share, so that a key with many rows is many groups.
    """
    rows = intervals.where(F.col(key).isNotNull() & (F.col(start) < F.col(stop))).select(F.col(key).alias("k"), F.col(stage).alias("s"), F.col(start).alias("a"), F.col(stop).alias("b"))
    window = lambda c: F.floor(c / width)
    parts = rows.withColumn("w", F.explode(F.sequence(window(F.col("a")), F.greatest(window(F.col("a")), F.ceil(F.col("b") / width) - 1))))
    parts = parts.select("k", "s", "w", F.greatest(F.col("a"), F.col("w") * width).alias("a"), F.least(F.col("b"), (F.col("w") + 1) * width).alias("b"))
    ends = parts.select("k", "s", "w", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    ends = ends.groupBy("k", "s", "w", "x.at").agg(F.sum("x.d").alias("d"))
    # the spells in which a stage has any interval: they begin and end where its running sum leaves and meets zero
    ends = ends.withColumn("n", F.sum("d").over(Window.partitionBy("k", "s", "w").orderBy("at")))
    turns = ends.withColumn("turn", F.when(F.col("n") == F.col("d"), F.signum("n")).when(F.col("n") == 0, -1.0).cast("int")).where("turn <> 0")
    # charge: seconds over number of active stages, summed up to a boundary; a spell costs the difference of its ends
    order = Window.partitionBy("k", "w").orderBy("at")
    cuts = turns.groupBy("k", "w", "at").agg(F.sum("turn").alias("turn"), F.collect_list(F.struct("s", "turn")).alias("stages"))
    cuts = cuts.withColumns({"n": F.sum("turn").over(order), "next": F.lead("at").over(order)})
    cuts = cuts.withColumn("share", F.when(F.col("n") > 0, (F.col("next") - F.col("at")) / F.col("n")).cast("decimal(38,18)"))
    cuts = cuts.withColumn("charge", F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,18)"))
    spent = cuts.select("k", "charge", F.explode("stages").alias("x"))
    spent = spent.groupBy("k", "x.s").agg(F.sum(F.when(F.col("x.turn") < 0, F.col("charge")).otherwise(-F.col("charge"))).alias("seconds"))
    spent = spent.select("k", "s", F.round(F.col("seconds").cast("double"), 6).alias("seconds"))
    if gap is not None:
        whole = rows.groupBy("k").agg((F.max("b") - F.min("a")).cast("double").alias("whole"))
        used = spent.groupBy("k").agg(F.sum("seconds").alias("used"))
        rest = whole.join(used, "k").select("k", F.lit(gap).alias("s"), F.round(F.greatest(F.lit(0.0), F.col("whole") - F.col("used")), 3).alias("seconds"))
        spent = spent.unionByName(rest)
    return spent.select(F.col("k").alias(key), F.col("s").alias(stage), "seconds")

"""Units of generation: which chunks belong together, and how a budget is shared among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..functions.signals import LIST_ITEM
from ..functions.text import collapse


def inner_parts(text: Column) -> Column:
    """List lines or paragraphs of a chunk, whichever are more."""
    lists = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(LIST_ITEM)))
    paragraphs = F.size(F.filter(F.split(text, r"\n\s*\n"), lambda x: collapse(x) != ""))
    return F.greatest(lists, paragraphs)


def plan_units(chunks: DataFrame, chunk_size: int = 600, most: int = 6000, id_col: str = "doc_id") -> DataFrame:
    """One row per unit: document, unit_type, anchor (first chunk_index), n_chunks, n_usable, potential.

    ``chunks`` has chunk_index, parent, text and status (usable, context_only, drop). Chunks of one
    parent that are not dropped make a section where there are two of them, two are usable and all
    fit in ``most`` characters. Of the usable rest, long chunks of several parts are virtual parents, the
    others leaves. Groups are aggregated and joined back, so a parent of very many chunks is
    never in one task. Chunks with a null parent or text are in no section; empty tables give no unit.
    What is known of a chunk is stored without its text, which is read once.
    """
    size = F.length(collapse(F.col("text")))
    virtual = (F.col("__n") >= max(900, 2 * chunk_size)) & (inner_parts(F.col("text")) >= 2)
    known = stored(chunks.withColumn("__n", size).select(id_col, "chunk_index", "parent", "status", "__n", virtual.alias("__virtual")), "known")  # filters follow, as they would work out the status anew
    kept = known.where((F.col("status") != "drop") & (F.col("__n") > 0)).withColumn("__u", (F.col("status") == "usable").cast("int"))
    groups = kept.where(F.col("parent").isNotNull()).groupBy(id_col, "parent").agg(
        F.min("chunk_index").alias("anchor"), F.count("*").alias("n_chunks"), F.sum("__u").alias("n_usable"), F.sum("__n").alias("__chars")
    )
    sections = groups.where((F.col("n_chunks") >= 2) & (F.col("n_usable") >= 2) & (F.col("__chars") <= max(1000, most)))
    alone = kept.where("__u = 1").join(sections.select(id_col, "parent"), [id_col, "parent"], "left_anti")
    alone = alone.select(id_col, F.when(F.col("__virtual"), "virtual_parent").otherwise("leaf").alias("unit_type"), F.col("chunk_index").alias("anchor"), F.lit(1).cast("long").alias("n_chunks"), F.lit(1).cast("long").alias("n_usable"))
    units = sections.select(id_col, F.lit("section").alias("unit_type"), "anchor", "n_chunks", "n_usable").unionByName(alone)
    return units.withColumn("potential", F.when(F.col("unit_type") == "section", F.least(F.lit(3), F.col("n_usable"))).when(F.col("unit_type") == "virtual_parent", 2).otherwise(1).cast("long"))


def allocate_budget(units: DataFrame, total: int, id_col: str = "doc_id") -> DataFrame:
    """``units`` that get a share of their document's ``total``, with ``budget``.

    The first ``total`` units by place get one each. What is left goes round by round to units below
    their potential, sections and virtual parents first. A unit's further shares are rows, numbered by
    round and place, of which the first that remain are granted: no loop.
    """
    place = Window.partitionBy(id_col).orderBy("anchor", "unit_type")
    picked = stored(units.withColumn("__at", F.row_number().over(place)).where(F.col("__at") <= total), "picked")  # read three times
    left = picked.groupBy(id_col).agg((F.lit(total) - F.count("*")).alias("__left"))
    asks = picked.where("potential > 1").select(id_col, "__at", "anchor", (F.col("unit_type") == "leaf").cast("int").alias("__late"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("potential") - 1)).alias("__round"))
    turn = Window.partitionBy(id_col).orderBy("__round", "__late", "anchor", "__at")
    granted = asks.withColumn("__turn", F.row_number().over(turn)).join(left, id_col).where("__turn <= __left").groupBy(id_col, "__at").agg(F.count("*").alias("__more"))
    return picked.join(granted, [id_col, "__at"], "left").withColumn("budget", 1 + F.coalesce("__more", F.lit(0))).drop("__at", "__more")


def largest_remainder(groups: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``key`` and ``quota``: ``total`` shared in proportion to ``weight``, leftovers to the largest remainders.

    ``groups`` holds a row per group (an aggregate, not the data). Ties go to the smaller key. Null or
    zero weights get nothing. Remainders are counted by bucket first, and rows ranked inside their bucket, so that many groups are many tasks.
    """
    rows = groups.select(F.col(key).alias("k"), F.coalesce(F.col(weight), F.lit(0)).alias("w"))
    sums = rows.agg(F.sum("w").alias("s")).where("s > 0")  # one row
    exact = F.col("w") * F.lit(total)
    rows = rows.join(F.broadcast(sums)).select("k", F.floor(exact / F.col("s")).cast("long").alias("base"), (exact % F.col("s")).alias("r"), "s")
    rows = rows.withColumn("b", F.floor(F.col("r") * 1024 / F.col("s")))
    spare = rows.agg((F.lit(total) - F.sum("base")).alias("spare"))  # one row
    counts = rows.groupBy("b").agg(F.count("*").alias("n"))  # 1024 rows at most
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("b", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    place = F.col("above") + F.row_number().over(Window.partitionBy("b").orderBy(F.desc("r"), F.asc_nulls_last("k")))
    out = rows.join(F.broadcast(counts), "b").join(F.broadcast(spare)).withColumn("place", place)
    return out.select(F.col("k").alias(key), (F.col("base") + (F.col("place") <= F.col("spare")).cast("int")).cast("long").alias("quota"))


def typed_plan(quotas: DataFrame, key: str, seed: str = "plan") -> DataFrame:
    """A slot for each granted share: ``slot`` (from 1), ``key``; in an order shuffled by a hash of the seed. ``quotas`` as :func:`largest_remainder` returns them."""
    each = quotas.where("quota > 0").select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("i"))
    return each.select(F.row_number().over(Window.orderBy(F.md5(F.concat_ws("/", F.lit(seed), key, F.col("i").cast("string"))))).cast("long").alias("slot"), key)


def match_plan(plan: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """``items`` with the ``slot`` they fill: the n-th item of a type takes the n-th slot of that type; items and slots left over are dropped."""
    nth = lambda rows, by: rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(by)))
    return nth(items, order).join(nth(plan, "slot"), [key, "nth"]).drop("nth")


def batch_limits(files: DataFrame, key: str, total: int) -> DataFrame:
    """``files`` (one row each) with ``limit``: ``total`` in equal parts, the remainder one each to the first by ``key``."""
    n = files.agg(F.count("*").alias("n"))  # one row
    first = files.select(key).orderBy(key).limit(max(0, total)).withColumn("place", F.row_number().over(Window.orderBy(key)))
    rows = files.join(first, key, "left").join(F.broadcast(n))
    return rows.withColumn("limit", (F.floor(F.lit(total) / F.col("n")) + F.coalesce((F.col("place") <= F.lit(total) % F.col("n")).cast("int"), F.lit(0))).cast("long")).drop("place", "n")


def unit_modes(units: DataFrame, mode: str = "auto") -> DataFrame:
    """``units`` with ``mode``: as given, or for auto summary for sections and virtual parents and point for leaves."""
    return units.withColumn("mode", F.when(F.col("unit_type") == "leaf", "point").otherwise("summary") if mode == "auto" else F.lit(mode))


def plan_summary(units: DataFrame) -> DataFrame:
    """``kind``, ``value``, ``n``: how many units there are of each unit_type and mode."""
    rows = units.select(F.explode(F.create_map(F.lit("unit_type"), "unit_type", F.lit("mode"), "mode")).alias("kind", "value"))
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"))

"""Joins that put a question/answer item together from what the steps of a pipeline left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

PAIR = ("question", "answer")


def record_id(*parts: Column, between: str = "") -> Column:
    """Digest of the parts, null as empty: of an item from task, file, question and answer, of a fact from task, file and fact."""
    return F.sha1(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), between).cast("binary"))


def document_id(filename: Column, text: Column) -> Column:
    """Digest of a trimmed file name and the digest of the text."""
    return record_id(strip(filename), F.sha1(text.cast("binary")), between="|||")


def last_of_key(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of rows that repeat the keys the last by ``order``; the others' columns are dropped with them. Null keys are keys."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__x")).select(*keys, "__x.*") if rest else rows.distinct()


def overlaid(left: DataFrame, full: DataFrame, order: str, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Every row of ``left`` with what the last row of ``full`` of the same keys has more; where both have a column, the left value counts unless it is null."""
    side = last_of_key(full, order, *keys).select(*keys, *[F.col(c).alias(f"__f_{c}") for c in full.columns if c not in keys])
    rows = left.join(side, list(keys), "left")
    both = [c for c in left.columns if c in full.columns and c not in keys]
    more = [c for c in full.columns if c not in left.columns]
    return rows.select(*keys, *[c for c in left.columns if c not in keys and c not in both], *[F.coalesce(c, f"__f_{c}").alias(c) for c in both], *[F.col(f"__f_{c}").alias(c) for c in more])


def with_variants(primary: DataFrame, variants: DataFrame, key: str, of: str, order: str, least: float | None = None, score: str = "score", name: str = "variants") -> DataFrame:
    """``primary`` with the array ``name`` of its variants' columns, in order; empty without any. With ``least`` only variants of that score."""
    kept = variants if least is None else variants.where(F.col(score) >= least)
    inner = [c for c in variants.columns if c != of]
    nested = kept.groupBy(F.col(of).alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*inner).alias("v")))).alias("x"))
    nested = nested.select(key, F.transform("x", lambda x: x["v"]).alias(name))
    kind = dict(nested.dtypes)[name]
    return primary.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def flattened_variants(rows: DataFrame, name: str = "variants", of: str = "variant_of", key: str = "id") -> DataFrame:
    """A row for every primary (``of`` null) and one for each of its variants."""
    primary = rows.drop(name).withColumn(of, F.lit(None).cast(dict(rows.dtypes)[key]))
    each = rows.select(F.col(key).alias(of), F.explode(name).alias("v")).select(of, "v.*")
    return primary.unionByName(each, allowMissingColumns=True)


def filtered_after(top: DataFrame, meta: DataFrame, key: str, defaults: dict, condition: str) -> DataFrame:
    """Search hits with their side table, filtered after the search cut them, so that fewer may be left."""
    return top.join(meta, key, "left").fillna(defaults).where(condition)


def best_facts(facts: DataFrame, fact: str, confidence: str, order: str) -> DataFrame:
    """Of each fact the row with the largest confidence, the first of equals. Null confidences come last."""
    best = Window.partitionBy(fact).orderBy(F.desc_nulls_last(confidence), order)
    return facts.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def first_of_key(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of rows that repeat the keys the first by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__x")).select(*keys, "__x.*") if rest else rows.distinct()


def marker_places(chunks: DataFrame, markers: Column, order: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``marker``, and the first chunk (by ``order``) that has it."""
    each = chunks.select(id_col, order, F.explode(markers).alias("marker"))
    return each.groupBy(id_col, "marker").agg(F.min(order).alias(order))


def chunk_report(chunks: DataFrame, items: DataFrame, meta: DataFrame, chunk: str = "chunk_id", id_col: str = "doc_id") -> DataFrame:
    """``chunks`` with the number of their items and the metadata of their document; chunks without either stay."""
    counts = items.groupBy(chunk).agg(F.count("*").alias("n_items"))
    return chunks.join(counts, chunk, "left").join(meta, id_col, "left").fillna({"n_items": 0})

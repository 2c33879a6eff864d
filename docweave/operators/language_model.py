"""Count-based language model of word n-grams with add-one smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.text import lexical_tokens


def _grams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def ngram_log_probabilities(docs: DataFrame, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts ``id_col``, gram, tf by document, and the model ``gram``, ``log2p``.

    P = (c(gram) + 1) / (c(prefix) + number of different prefixes), for n = 1 (c + 1) / (length of the corpus + number of different words).
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    tokens = docs.select(F.col(id_col), lexical_tokens(F.col(text_col)).alias("__t"))
    by_doc = tokens.select(id_col, F.explode(_grams(F.col("__t"), n)).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("tf"))
    counts = by_doc.groupBy("gram").agg(F.sum("tf").alias("c"))
    if n == 1:
        sums = counts.agg((F.sum("c") + F.count("*")).alias("base"))
        return by_doc, counts.join(F.broadcast(sums)).select("gram", F.log2((F.col("c") + 1) / F.col("base")).alias("log2p"))
    prefixes = tokens.select(F.explode(_grams(F.col("__t"), n - 1)).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("cp"))
    different = prefixes.agg(F.count("*").alias("v"))  # one row
    model = counts.withColumn("prefix", F.regexp_replace("gram", " [^ ]*$", "")).join(prefixes, "prefix").join(F.broadcast(different))
    return by_doc, model.select("gram", F.log2((F.col("c") + 1) / (F.col("cp") + F.col("v"))).alias("log2p"))


def _hashed(words: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` words that begin at each place, from the hashes of the words."""
    out = np.full(len(at), seed, np.uint64)
    for i in range(n):
        out = (out ^ words[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _counted(doc: np.ndarray, at: np.ndarray, words: np.ndarray, n: int, used: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, 96 bits of hash, occurrences and ``used`` ones of each different sequence of ``n`` words of a document."""
    h = _hashed(words, at, n, 2 * n + 1)
    order = np.lexsort((h, doc))
    doc, h, used, at = doc[order], h[order], used[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    more = (_hashed(words, at[first], n, 2 * n + 1 << 32) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    sizes = np.diff(np.append(first, len(h)))
    return doc[first], h[first].view(np.int64), more, sizes, np.add.reduceat(used, first) if len(first) else used


def _occurrences(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``k``, ``m`` (a hash of 96 bits), ``tf``, ``used`` of every n-gram of each row (``used`` is null) and of every n-1-gram (``used``: how often it is a prefix)."""
    hashes = F.transform(F.coalesce(lexical_tokens(F.col(text_col)), F.array().cast("array<string>")), lambda t: F.xxhash64(t))
    rows = docs.select(id_col, hashes.alias("h"))
    names = [id_col, "k", "m", "tf", "used"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the end of the text
                for size in (n, n - 1) if n > 1 else (n,):
                    at = np.flatnonzero(left >= size)
                    d, k, m, tf, used = _counted(doc[at], at, words, size, (left[at] >= n).astype(np.int64))
                    used = pa.nulls(len(d), pa.int64()) if size == n else pa.array(used, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(k), pa.array(m), pa.array(tf, pa.int64()), used], names)

    schema = StructType([rows.schema[id_col], StructField("k", LongType()), StructField("m", IntegerType()), StructField("tf", LongType()), StructField("used", LongType())])
    return rows.mapInArrow(run, schema)


def ngram_scores(docs: DataFrame, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score``: mean log2 probability over the n-grams of each document.

    Documents that are null or have fewer than ``n`` words score 0. Rows that repeat an id count as one document.

    The model is that of ``ngram_log_probabilities``. N-grams meet by 96 bits of hash, so that each goes once through a shuffle, as numbers, with its document; log2 P is taken as the
    difference of the logarithms of n-gram and prefix, and what a task knows of a document is added up there.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    rows = _occurrences(docs, n, id_col, text_col)
    prefixes = rows.where("used IS NOT NULL") if n > 1 else rows
    base = prefixes.groupBy("k", "m").agg(F.sum("tf").alias("c")).agg((F.count("*") + (F.lit(0) if n > 1 else F.sum("c"))).alias("base"))  # one row
    rows = rows.withColumn("c", F.sum("tf").over(Window.partitionBy("k", "m"))).join(F.broadcast(base))
    gram = F.col("tf") * (F.log2(F.col("c") + 1) - (F.lit(0.0) if n > 1 else F.log2(F.col("base").cast("double"))))
    part = F.when(F.col("used").isNull(), gram).otherwise(-F.col("used") * F.log2(F.col("c") + F.col("base")))
    means = rows.groupBy(id_col).agg((F.sum(part) / F.sum(F.when(F.col("used").isNull(), F.col("tf")))).alias("score"))
    return docs.select(id_col).distinct().join(means, id_col, "left").select(id_col, F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score"))

"""A tagger of three levels that is trained here.

Texts are bags of hashed tokens; each level has a multinomial model over them, and the labels below the first level only compete with
those that have the same parent. Training goes in rounds: every task adds up the gradient of its rows, Spark adds up the
tasks' gradients in blocks, and the driver, which has the weights alone, makes the step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.shared import shared_folder
from ..functions.snippets import snippets
from ..functions.text import lexical_tokens
from .classify import vote

#: Leaves that a model may have, at most; cells of a gradient that travel together.
MOST_LEAVES = 2_000
BLOCK = 1 << 14
#: Rows that are stored together, and rows that a table of all features has.
STORED, TABLE = 512, 64
#: Tasks that the training rows are dealt to, at least.
PARTS = 16
LEVELS = ("level1", "level2", "level3")
#: Names of leaves that stand for whatever is left (fixed values).
REST = ("其他", "其他主题", "other")


@dataclass(frozen=True)
class Taxonomy:
    """``paths``: the leaves as (level1, level2, level3), sorted. Numbers of labels run over a level; ``parent2`` and ``parent3`` name a label's parent."""

    paths: list[tuple[str, str, str]]

    def __post_init__(self):
        ones = sorted({p[:1] for p in self.paths})
        twos = sorted({p[:2] for p in self.paths})
        object.__setattr__(self, "labels", (ones, twos, sorted(self.paths)))
        object.__setattr__(self, "parent2", np.array([ones.index(p[:1]) for p in twos]))
        object.__setattr__(self, "parent3", np.array([twos.index(p[:2]) for p in sorted(self.paths)]))
        object.__setattr__(self, "number", {p: i for i, p in enumerate(sorted(self.paths))})

    @property
    def sizes(self) -> tuple[int, int, int]:
        return tuple(len(x) for x in self.labels)


def features(text: Column, width: int) -> Column:
    """Numbers of a text's tokens below ``width``, repeats kept; none for null."""
    return F.transform(F.coalesce(lexical_tokens(text), F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))


def bags(rows, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the filled cells: log(1 + count), scaled to length 1, and a constant feature at ``width``."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    cells, n = np.unique(np.repeat(np.arange(len(rows)), sizes) * (width + 1) + flat, return_counts=True)
    at, v = cells // (width + 1), np.log1p(n)
    v = v / np.sqrt(np.maximum(np.bincount(at, v * v, len(rows)), 1e-24))[at]
    every = np.arange(len(rows))
    return np.concatenate([at, every]), np.concatenate([cells % (width + 1), np.full(len(rows), width)]), np.concatenate([v, np.ones(len(rows))])


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``at``."""
    return np.stack([np.bincount(at, values[:, c], n) for c in range(values.shape[1])], axis=1)


def _logits(bag: tuple, n: int, weights: np.ndarray) -> np.ndarray:
    at, idx, v = bag
    return _summed(at, v[:, None] * weights[idx], n)


def logits(rows, weights: np.ndarray) -> np.ndarray:
    return _logits(bags(rows, len(weights) - 1), len(rows), weights)


def masked_softmax(z: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Probabilities among the allowed columns of each row; 0 elsewhere."""
    z = np.where(allowed, z, -np.inf)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _parts(tax: Taxonomy) -> tuple[slice, slice, slice]:
    a, b, c = tax.sizes
    return slice(0, a), slice(a, a + b), slice(a + b, a + b + c)


def errors(z: np.ndarray, leaves: np.ndarray, tax: Taxonomy) -> np.ndarray:
    """Gradient of the summed cross entropy of the three levels by the logits; below the first, among the true parent's children."""
    s1, s2, s3 = _parts(tax)
    two = tax.parent3[leaves]
    one = tax.parent2[two]
    d = np.zeros_like(z)
    everywhere = np.ones((len(leaves), tax.sizes[0]), bool)
    for part, allowed, true in ((s1, everywhere, one), (s2, tax.parent2[None, :] == one[:, None], two), (s3, tax.parent3[None, :] == two[:, None], leaves)):
        p = masked_softmax(z[:, part], allowed)
        p[np.arange(len(true)), true] -= 1
        d[:, part] = p
    return d


def gradient_of(bag: tuple, leaves: np.ndarray, weights: np.ndarray, tax: Taxonomy) -> np.ndarray:
    at, idx, v = bag
    return _summed(idx, v[:, None] * errors(_logits(bag, len(leaves), weights), leaves, tax)[at], len(weights))


def counted(rows: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow array of lists: how many different features each has, the features by row, and their counts."""
    at = np.repeat(np.arange(len(rows)), rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = at * width + rows.flatten().to_numpy(zero_copy_only=False)
    found = [np.zeros((3, 0), np.int64)]
    for lo in range(0, len(rows), TABLE):
        a, b = np.searchsorted(at, [lo, lo + TABLE])
        n = np.bincount(flat[a:b] - lo * width)
        cells = np.flatnonzero(n)
        found.append(np.stack([cells // width + lo, cells % width, n[cells]]))
    row, idx, n = np.concatenate(found, axis=1)
    return np.bincount(row, minlength=len(rows)), idx, n


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each in as many bytes as the largest needs."""
    return x.astype(np.min_scalar_type(x.max(initial=0))).tobytes()


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"u{len(x) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def gradient_of_counts(sizes: np.ndarray, idx: np.ndarray, n: np.ndarray, leaves: np.ndarray, weights: np.ndarray, tax: Taxonomy) -> np.ndarray:
    """The same gradient for rows as :func:`counted` has them, ``TABLE`` rows with all their features at a time."""
    width = len(weights) - 1
    row, v = np.repeat(np.arange(len(sizes)), sizes), np.log1p(n)
    v /= np.sqrt(np.maximum(np.bincount(row, v * v, len(sizes)), 1e-24))[row]
    cells, ends = row * (width + 1) + idx, np.concatenate([[0], np.cumsum(sizes)])
    total, table = np.zeros_like(weights), np.zeros((TABLE, width + 1))
    table[:, width] = 1
    for lo in range(0, len(sizes), TABLE):
        hi = min(lo + TABLE, len(sizes))
        part = slice(ends[lo], ends[hi])
        here = cells[part] - lo * (width + 1)
        table.reshape(-1)[here] = v[part]
        x = table[: hi - lo]
        total += x.T @ errors(x @ weights, leaves[lo:hi], tax)
        table.reshape(-1)[here] = 0
    return total


def gradient(rows, leaves: np.ndarray, weights: np.ndarray, tax: Taxonomy) -> np.ndarray:
    return gradient_of(bags(rows, len(weights) - 1), leaves, weights, tax)


@dataclass
class Model:
    taxonomy: Taxonomy
    weights: np.ndarray
    held_rows: int

    def predict_lists(self, rows: pa.Array) -> list[tuple[str, str, str, float]]:
        """The same for an Arrow array of lists, by way of a table of all features; for a few hundred rows at a time."""
        width = len(self.weights) - 1
        at = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        v = np.log1p(np.bincount(at * width + flat, minlength=len(rows) * width).reshape(len(rows), width))
        v /= np.sqrt(np.maximum((v * v).sum(axis=1), 1e-24))[:, None]
        return self._named(v @ self.weights[:width] + self.weights[width])

    def predict(self, rows) -> list[tuple[str, str, str, float]]:
        """Label of each level, chosen from above, and the cube root of the product of their probabilities; ties go to the first by name."""
        return self._named(logits(rows, self.weights))

    def _named(self, z: np.ndarray) -> list[tuple[str, str, str, float]]:
        tax, (s1, s2, s3) = self.taxonomy, _parts(self.taxonomy)
        p1 = masked_softmax(z[:, s1], np.ones((len(z), tax.sizes[0]), bool))
        one = p1.argmax(axis=1)
        p2 = masked_softmax(z[:, s2], tax.parent2[None, :] == one[:, None])
        two = p2.argmax(axis=1)
        p3 = masked_softmax(z[:, s3], tax.parent3[None, :] == two[:, None])
        leaf = p3.argmax(axis=1)
        at = np.arange(len(z))
        sure = np.cbrt(p1[at, one] * p2[at, two] * p3[at, leaf])
        return [(*tax.labels[2][i], float(c)) for i, c in zip(leaf, sure, strict=True)]


def _step(weights: np.ndarray, g: np.ndarray, speed: np.ndarray, rate: float, decay: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A step with momentum. It is linear in the gradient, so that the order in which tasks are added up stays in the last digits."""
    speed = 0.9 * speed - rate * (g / max(n, 1) + decay * weights)
    return weights + speed, speed


def fit_here(rows: list, leaves: np.ndarray, tax: Taxonomy, width: int, rounds: int, rate: float, decay: float) -> Model:
    """The same training on rows that are here already."""
    weights = np.zeros((width + 1, sum(tax.sizes)))
    speed, bag = np.zeros_like(weights), bags(rows, width)
    for _ in range(rounds):
        weights, speed = _step(weights, gradient_of(bag, leaves, weights, tax), speed, rate, decay, len(rows))
    return Model(tax, weights, len(rows))


def taxonomy_of(labelled: DataFrame) -> Taxonomy:
    """The paths of three labels that occur; rows with a null label have none. Raises where there are more than ``MOST_LEAVES`` or none."""
    paths = labelled.where(" AND ".join(f"{c} IS NOT NULL" for c in LEVELS)).select(*[F.col(c).cast("string") for c in LEVELS]).distinct().limit(MOST_LEAVES + 1).collect()
    if not 0 < len(paths) <= MOST_LEAVES:
        raise ValueError(f"1 to {MOST_LEAVES} leaves, not {len(paths)}")
    return Taxonomy(sorted(tuple(p) for p in paths))


def among_first(rows: DataFrame, n: int) -> DataFrame:
    """Rows among which are the ``n`` with the smallest 64-bit hash ``h``, and few others: those of the first of 65,536 ranges of hashes that hold so many."""
    top, held = F.shiftright("h", 48), 0
    for x in sorted(rows.groupBy(top.alias("b")).agg(F.count("*").alias("n")).collect()):  # 65,536 rows at most
        held += x["n"]
        if held >= n:
            return rows.where(top <= x["b"])
    return rows


def fit(labelled: DataFrame, key: str, text_col: str = "text", width: int = 4096, rounds: int = 40, rate: float = 2.0, decay: float = 1e-5) -> Model:
    """Trains on every row with ``level1``, ``level2``, ``level3``; rows without a full path are left out, a null text is an empty one.

    The rows lie in the shared folder as counts of hashed tokens while rounds read them; an executor's loss costs the tasks it had. The number of columns a worker holds is
    ``width`` times the labels. ``key`` names the rows and has no part in the training.
    """
    tax = taxonomy_of(labelled)
    spark = labelled.sparkSession
    known = labelled.where(" AND ".join(f"{c} IS NOT NULL" for c in LEVELS))
    names = spark.createDataFrame([(*p, i) for p, i in tax.number.items()], "level1 string, level2 string, level3 string, leaf int")
    rows = known.select(*[F.col(c).cast("string").alias(c) for c in LEVELS], F.col(text_col).alias("text")).join(F.broadcast(names), list(LEVELS))
    folder = shared_folder(spark, "tagger")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STORED):
                part = batch.slice(at, STORED)
                sizes, idx, n = counted(part.column(1), width)
                small = [_packed(x) for x in (part.column(0).to_numpy(), sizes, idx, n)]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([len(idx)]), *(pa.array([x], pa.binary()) for x in small)], ["rows", "cells", "leaves", "sizes", "idx", "n"])

    counts = rows.select("leaf", features(F.col("text"), width).alias("idx")).mapInArrow(stored, "rows long, cells long, leaves binary, sizes binary, idx binary, n binary")
    counts.repartition(max(PARTS, 4 * spark.sparkContext.defaultParallelism)).write.parquet(folder)
    held = spark.read.parquet(folder)
    n = held.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    weights = np.zeros((width + 1, sum(tax.sizes)))
    speed = np.zeros_like(weights)

    def adding(now: np.ndarray):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(now)
            for part in parts:
                for x in part.itertuples(index=False):
                    total += gradient_of_counts(_unpacked(x.sizes, x.rows), _unpacked(x.idx, x.cells), _unpacked(x.n, x.cells), _unpacked(x.leaves, x.rows), now, tax)
            flat = total.ravel()
            yield pd.DataFrame({"block": range(0, len(flat), BLOCK), "g": [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]})

        return run

    def summed(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key_[0]], "g": [np.sum([np.frombuffer(g) for g in rows["g"]], axis=0).tobytes()]})

    for _ in range(rounds):
        blocks = held.mapInPandas(adding(weights), "block int, g binary").groupBy("block").applyInPandas(summed, "block int, g binary").collect()  # as large as the weights
        g = np.concatenate([np.frombuffer(b["g"]) for b in sorted(blocks, key=lambda b: b["block"])]).reshape(weights.shape) if blocks else np.zeros_like(weights)
        weights, speed = _step(weights, g, speed, rate, decay, n)
    return Model(tax, weights, n)


def tagged(rows: DataFrame, model: Model, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """``rows`` with ``level1``, ``level2``, ``level3`` and ``confidence`` (4 decimals). A null text is judged as an empty one.

    Below the confidence ``least``, the leaf is that of the chosen second level which stands for the rest, if it has one. Earlier columns of these names are replaced. The
    weights go to every worker once.
    """
    tax, width = model.taxonomy, len(model.weights) - 1
    rest = {p[:2]: p[2] for p in tax.paths if p[2] in REST}
    plain = rows.drop(*LEVELS, "confidence")
    names = [*plain.columns, *LEVELS, "confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = model.predict_lists(part.column(part.num_columns - 1))
                named = [(a, b, rest.get((a, b), c) if sure < least else c, round(sure, 4)) for a, b, c, sure in found]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*named, strict=True), [pa.string()] * 3 + [pa.float64()], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names)

    name = "__idx"
    while name in plain.columns:
        name += "_"
    schema = StructType([*plain.schema, *(StructField(c, StringType()) for c in LEVELS), StructField("confidence", DoubleType())])
    return plain.withColumn(name, features(F.col(text_col), width)).mapInArrow(run, schema)


def tagged_by_vote(rows: DataFrame, model: Model, key: str, text_col: str = "text") -> DataFrame:
    """``key``, ``path`` (level1/level2/level3) and ``confidence``: the path with the largest sum of confidences over a text's snippets. Texts without a snippet have no row."""
    pieces = rows.select(F.col(key), F.explode(snippets(F.col(text_col))).alias("text"))
    found = tagged(pieces, model).withColumn("path", F.concat_ws("/", *LEVELS))
    return vote(found, key, "path", "confidence")

"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a row of a table: its Hamming distances to a fixed set of reference
fingerprints (pivots), computed once and kept. All that follows reads the table. By the triangle inequality two fingerprints within ``k`` bits differ by at
most ``k`` in every coordinate, so a pair whose largest coordinate difference is over ``k`` is
discarded without a comparison; survivors are verified on the 64 bits.

The pivots are a base fingerprint, its copies with one bit flipped, and some with half of the bits
flipped. A one-bit coordinate is one more or one less than the base coordinate, and two rows within ``k``
bits agree in all but ``k`` of these 64 differences. They are dealt to ``blocks`` groups; the pair agrees in at
least ``blocks - k`` whole groups. For every choice of so many groups their coordinates are one equality
key that Spark can shuffle on: the search is exact, and a key has half of the bits (two of four groups for
``k`` = 2), so that it stays rare in a table of 10^9 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, checkpoint, connected_components, free_name

BASE = 0x9E3779B97F4A7C15
#: Pivots with half of the bits flipped, that serve the largest-difference test alone.
HALVES = 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for null or a text with no word."""
    data = (text or "").encode("utf-8", "replace").lower()
    words = data.split()
    if not words:
        return 0
    k = shingle_words
    grams = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), dtype=">u8")
    n = len(hashes)
    cells = hashes.view(np.uint8).reshape(n, 8) + _COLUMN
    ones = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).ravel()).tobytes(), "big")


def fingerprint_column(text: Column, shingle_words: int = 3, seed: int = 42) -> Column:
    """Fingerprint as a signed long holding the 64 bits."""

    def start():
        return lambda texts: [_signed(fingerprint(t, shingle_words, seed)) for t in texts]

    return arrow_column("long", start, text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def half_masks() -> list[int]:
    """Masks of about half of the bits: those of multiples of an odd constant."""
    return [(BASE * (2 * i + 3)) & ((1 << 64) - 1) for i in range(HALVES)]


def families(k: int, blocks: int) -> list[list[int]]:
    """For every choice of ``blocks - k`` of the blocks, the one-bit pivots (bit numbers) whose coordinates make the key."""
    if not 0 < blocks - k:
        raise ValueError("more blocks than differing bits are needed")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [[b for g in chosen for b in range(edges[g], edges[g + 1])] for chosen in combinations(range(blocks), blocks - k)]


def pivots() -> list[int]:
    """The base, its 64 copies with one bit flipped, and those with about half of the bits flipped."""
    return [BASE, *(BASE ^ (1 << b) for b in range(64)), *(BASE ^ m for m in half_masks())]


def distance_table(fp: Column) -> Column:
    """Row of the table: Hamming distances of a fingerprint to all pivots, in their order."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("tinyint") for p in pivots()])


def one_bit_coordinates(table: Column) -> Column:
    """Which one-bit pivots are nearer than the base, as the bits of a long: a one-bit coordinate is the base coordinate less one or plus one."""
    nearer = [F.when(table[1 + b] < table[0], F.lit(_signed(1 << b))).otherwise(F.lit(0).cast("long")) for b in range(64)]
    while len(nearer) > 1:  # a tree of sums, as deep as six
        nearer = [x.bitwiseOR(y) for x, y in zip(nearer[::2], nearer[1::2], strict=True)]
    return nearer[0]


def pivot_keys(table: Column, k: int, blocks: int) -> Column:
    """Array of the families' keys; each is made of the family's coordinates in the table."""
    out = []
    for number, bits in enumerate(families(k, blocks)):
        mask = _signed(sum(1 << b for b in bits))
        out.append(F.struct(F.lit(number).alias("family"), table.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*out)


def largest_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest coordinate difference of pairs of table rows: no pair is nearer than that."""
    return np.abs(a - b).max(axis=1) if len(a) else np.empty(0, np.int8)


def _runs(group: np.ndarray, fp: np.ndarray, table: np.ndarray, node: np.ndarray, side: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs among neighbours of equal group (rows sorted by it), step by step."""
    left, right = [], []
    at, step = np.arange(len(fp)), 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        far = (side[at] != 2) & (side[at] == side[at + step])
        i = at[~far]
        i = i[largest_difference(table[i], table[i + step]) <= k]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= k]
        left.append(node[i])
        right.append(node[i + step])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The links that join two trees; the others say nothing new about reachability."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    u, v = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            u.append(x)
            v.append(y)
    return u, v


def _search(k: int):
    width = len(pivots())

    def rows_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        flat = [batch[c].to_numpy(zero_copy_only=False) for c in ("family", "key", "lo", "hi", "fp", "node", "side")]
        return [*flat, batch["table"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        last = False
        source = iter(batches)
        while not last:
            batch = next(source, None)
            last = batch is None
            if not last and not batch.num_rows:
                continue
            cols = rows_of(batch) if not last else None
            if rest:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)] if cols else rest
            if not cols:
                return
            family, key, lo, hi, fp, node, side, table = cols
            new = np.ones(len(fp), bool)
            new[1:] = (np.diff(family) != 0) | (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
            group = np.cumsum(new)
            cut = len(fp) if last else int(np.searchsorted(group, group[-1]))
            rest = [c[cut:] for c in cols]
            u, v = _forest(*_runs(group[:cut], fp[:cut].view(np.uint64), table[:cut], node[:cut], side[:cut], k))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def similar_pairs(prints: DataFrame, k: int = 2, blocks: int | None = None, group_size: int = 1024) -> DataFrame:
    """Links ``u``, ``v`` (enough to keep reachability) between distinct fingerprints within k bits.

    ``prints``: one row per fingerprint, long columns ``node`` and ``fp``, and its ``table`` row, which is made where it is missing. ``blocks`` is k + 2 if not given. A key with more than
    ``group_size`` fingerprints is split in chunks, and each pair of chunks is a group of its own, so
    that a common key is spread over many tasks and no pair is lost.
    """
    tabled = prints if "table" in prints.columns else prints.withColumn("table", distance_table(F.col("fp")))
    coordinates = tabled.select("node", "fp", "table", one_bit_coordinates(F.col("table")).alias("nearer"))
    keyed = coordinates.select("node", "fp", "table", F.explode(pivot_keys(F.col("nearer"), k, blocks or k + 2)).alias("x")).select("node", "fp", "table", "x.family", "x.key")
    large = keyed.groupBy("family", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_size)
    large = large.select("family", "key", F.ceil(F.col("n") / group_size).cast("int").alias("chunks"))
    dealt = keyed.join(large, ["family", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(
        "family", "key", "fp", "table", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    # within one chunk (side 2) all pairs count; between two chunks only those of different sides
    dealt = dealt.repartition("family", "key", "lo", "hi").sortWithinPartitions("family", "key", "lo", "hi")
    return dealt.mapInArrow(_search(k), "u long, v long")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """``id``, ``fp`` (long) of every row."""
    return df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle_words, seed).alias("fp"))


def _classes(prints: DataFrame, best: Column, k: int) -> DataFrame:
    """``fp``, its ``component`` (a fingerprint) and the least ``best`` of the component's rows; nulls in ``best`` don't count.

    A fingerprint is a node of its own, so rows without an id link like any other.
    """
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(best).alias("rep")).withColumn("table", distance_table(F.col("fp"))))
    found = connected_components(similar_pairs(nodes.select(F.col("fp").alias("node"), "fp", "table"), k)).select(F.col("node").alias("fp"), "component")
    nodes = nodes.drop("table")
    linked = nodes.join(found, "fp")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    grouped = linked.select("fp", "component").join(least, "component").select("fp", "component", "least")
    alone = nodes.join(found, "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("rep").alias("least"))
    return grouped.unionByName(alone)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` of every row.

    The component is the smallest id of all rows linked to the row; null where none of them has an id.
    Null or wordless texts have fingerprint zero and link like any other. Rows with a null id have
    a fingerprint and a component like any other. Equal fingerprints collapse
    before the search, so any number of exact copies costs one row. Repeated ids return repeated
    rows. An empty table returns no row. Other columns are ignored.
    """
    prints = checkpoint(fingerprints(df, id_col, text_col, shingle_words, seed))
    classes = _classes(prints, F.col("id"), k).select("fp", F.col("least").alias("component_id"))
    out = prints.join(classes, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group of near copies, with all columns of ``df``: that with the smallest id, null ids last, then by a digest of the row.

    Rows that are equal in all columns are one row.
    """
    row = free_name(df.columns, "row")
    keyed = df.withColumn(row, F.unhex(F.sha2(F.to_json(F.struct(*[df[c] for c in df.columns])), 256)))
    prints = checkpoint(keyed.select(F.col(id_col).alias("id"), F.col(row).alias("row"), fingerprint_column(F.col(text_col), shingle_words, seed).alias("fp")))
    kept = _classes(prints, F.struct(F.col("id").isNull(), "id", "row"), k).select("component", "least").distinct().select(F.col("least.row").alias(row))
    # equal rows collapse before they are dealt, and the join needs no other shuffle
    return keyed.dropDuplicates([row]).join(kept, row, "left_semi").drop(row)

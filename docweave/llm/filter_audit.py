"""What every order of a chain of filters removes, and which filter deserves the credit.

Spark reduces the documents of each part to a cell for each combination of failed filters: how many documents fail
exactly these, and how many of them are labelled. With n filters a part has at most 2**n cells, whatever its size.
All orders are then visited by exchanging two neighbours at a time, so that only the two steps that changed places are
worked out anew, from the cells; a filter's Shapley value gathers along the walk what it removes in each order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name

#: Filters of a chain at most: nine have 362,880 orders.
MOST_FILTERS = 9
SPACE = r"[\x20\x09-\x0D]+"


def exchanges(n: int) -> Iterator[int]:
    """Places i such that exchanging i and i + 1, one after the other, visits all orders of ``n`` things once.

    The last thing sweeps through the others from end to end; between sweeps the others make one exchange of their own.
    """
    if n < 2:
        return
    inner, left = exchanges(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if left else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + left
        left = not left


def orders(names: str | list[str], cells: dict[int, list[int]]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, *lost, shapley) of each step of each order.

    ``cells`` has, for each mask of failed filters (bit i: ``names[i]``), the number of documents and of each kind that should not be lost.
    """
    n = len(names)
    kinds = len(next(iter(cells.values()), [0]))
    # of a mask of earlier filters: what is kept after them, by kind
    kept = {m: [0] * kinds for m in range(1 << n)}
    for mask, sums in cells.items():
        for m in kept:
            if not m & mask:
                kept[m] = [a + b for a, b in zip(kept[m], sums, strict=True)]
    total = kept[0][0]
    fails = [total - kept[1 << f][0] for f in range(n)]
    alone = [cells.get(1 << f, [0])[0] for f in range(n)]

    def step(before: int, f: int) -> tuple:
        here, after = kept[before], kept[before | 1 << f]
        removed, *lost = (a - b for a, b in zip(here, after, strict=True))
        return after[0], removed, fails[f] - removed, alone[f], *lost

    order, before = list(range(n)), [(1 << i) - 1 for i in range(n)]
    steps = [step(b, f) for b, f in zip(before, order, strict=True)]
    credit, since, seen = [0] * n, [0] * n, 0
    visited = [(tuple(order), tuple(steps))]
    for i in exchanges(n):
        seen += 1
        for j in (i, i + 1):  # what these two removed held for the orders since they last changed places
            credit[order[j]] += steps[j][1] * (seen - since[order[j]])
            since[order[j]] = seen
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        steps[i], steps[i + 1] = step(before[i], order[i]), step(before[i + 1], order[i + 1])
        visited.append((tuple(order), tuple(steps)))
    for f, s in zip(order, steps, strict=True):
        credit[f] += s[1] * (seen + 1 - since[f])
    return [("".join(names[f] for f in o), k + 1, *s, credit[o[k]]) for o, every in visited for k, s in enumerate(every)]


def audit(masked: DataFrame, names: str, part: str = "part", mask: str = "mask", lost: list[str] | None = None) -> DataFrame:
    """A row for each part, order of the filters ``names`` (a letter each) and step.

    ``masked`` has the columns ``part``, ``mask`` (bit i set: fails ``names[i]``) and, named by ``lost``, booleans of kinds whose losses are counted
    (null: not of the kind). A null part is the empty string; a null mask fails nothing. No row, no part. Columns of the result: part, filter_order, step, kept, removed,
    redundant, unique_fails, ``lost``..., shapley (the sum over all orders). Counts reach the workers, documents don't: at most 2**n rows a part.
    """
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    lost = lost or []
    sums = [F.count("*").alias("k0"), *(F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(f"k{i + 1}") for i, c in enumerate(lost))]
    cells = masked.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(mask), F.lit(0)).cast("int").alias("mask")).agg(*sums)
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"]

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = orders(names, {int(m): [int(x) for x in counts] for m, *counts in rows.drop(columns="part").itertuples(index=False)})
        out = pd.DataFrame(found, columns=columns)
        out.insert(0, "part", key[0])
        return out

    kinds = ", ".join(f"`{c}` {'string' if c == 'filter_order' else 'int' if c == 'step' else 'long'}" for c in columns)
    return cells.groupBy("part").applyInPandas(walk, f"part string, {kinds}")


def masks(text: Column) -> Column:
    """Bits 0 to 3 of the four filters on a text of its own: few words, few distinct words, many capitals, marks. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((c.cast("int") * (1 << i) for i, c in enumerate(conditions)), F.lit(0))


def fails_as_copy(df: DataFrame, id_col: str, digest: str, name: str) -> DataFrame:
    """``df`` with boolean ``name``: whether a row with a smaller id has the same ``digest``.

    A null id is smaller than none and has none below it, so such rows never fail and make none fail. Smallest ids are found by a
    partial aggregate; the join brings them back by digest, and Spark splits the partition of a frequent one.
    """
    at, first = free_name(df.columns, "digest_of_first"), free_name(df.columns, "smallest_id")
    smallest = df.groupBy(F.col(digest).alias(at)).agg(F.min(id_col).alias(first), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = df.join(smallest, F.col(digest) == F.col(at), "left")
    return joined.withColumn(name, F.coalesce(F.col(id_col) > F.col(first), F.lit(False))).drop(at, first)


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The five filters ABCDE in all orders, for each source.

    A to D are those of ``masks``; E fails texts that a smaller id has, wherever it lies. Null texts are empty and so copies of one another; null
    and empty sources are the part ''; a row without an id has no label. A document that ``labels`` has more than once is good or toxic if any of its rows says so;
    repeated documents count as often as they occur. Texts are read once, and what is kept of them is a digest and four bits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), masks(text).alias("mask"))
    known = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good_lost"), F.max(F.col("toxic") == 1).alias("toxic_lost"))
    rows = checkpoint(narrow)
    found = fails_as_copy(rows, "id", "digest", "copy").join(known, F.col("id") == F.col("label_id"), "left")
    masked = found.select("part", (F.col("mask") + F.col("copy").cast("int") * 16).alias("mask"), "good_lost", "toxic_lost")
    return audit(masked, "ABCDE", lost=["good_lost", "toxic_lost"])

"""BLEU of pairs of texts with orders 1 to 4."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import metric_tokens

ORDERS = (1, 2, 3, 4)


@pandas_udf(ArrayType(LongType()))
def _hits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For each order the n-grams that two lists of tokens share, as multisets."""
    grams = lambda x, n: Counter(zip(*[x[i:] for i in range(n)], strict=False))
    for c, r in pairs:
        yield pd.Series([[(grams(x, n) & grams(y, n)).total() for n in ORDERS] for x, y in zip(map(list, c), map(list, r), strict=True)])


def bleu(pairs: DataFrame, keys: list[str], candidate: str, reference: str, smooth: bool = True) -> DataFrame:
    """``keys`` and ``bleu`` (0 to 100, 6 decimals): the geometric mean of the clipped precisions of the orders 1 to 4 that the candidate is long enough for, times the brevity penalty.

    With ``smooth`` an order without a hit counts 1/2 hit, the next one 1/4 and so on; without, the score is 0. It is 0 in any case where no word is shared. Tokens are those of ``metric_tokens``;
    null and blank texts have none and score 0. Null keys are keys; rows that repeat in keys and texts are one row. N-grams are counted
    where the texts lie, in time and memory in proportion to a pair; sizes and hits alone are shuffled.
    """
    rows = pairs.select(F.struct(*keys).alias("k"), metric_tokens(F.col(candidate)).alias("c"), metric_tokens(F.col(reference)).alias("r"))
    found = rows.select("k", F.xxhash64("c", "r").alias("h"), F.size("c").alias("size"), F.size("r").alias("length"), _hits("c", "r").alias("hits"))
    both = found.dropDuplicates(["k", "h"]).select("k", "size", "length", *[F.col("hits")[i].alias(f"hit{n}") for i, n in enumerate(ORDERS)])
    logs, half, orders, missed = F.lit(0.0), F.lit(1.0), F.lit(0), F.lit(False)
    for n in ORDERS:
        total, hit = F.col("size") - (n - 1), F.coalesce(F.col(f"hit{n}"), F.lit(0))
        miss = (total > 0) & (hit == 0)
        half = F.when(miss, half / 2).otherwise(half)
        logs = logs + F.when(total > 0, F.log(F.when(miss, half).otherwise(hit) / total)).otherwise(0.0)
        orders, missed = orders + (total > 0).cast("int"), missed | miss
    penalty = F.when(F.col("size") >= F.col("length"), 1.0).otherwise(F.exp(1 - F.col("length") / F.col("size")))
    nothing = (F.col("size") == 0) | (F.coalesce(F.col("hit1"), F.lit(0)) == 0)
    if not smooth:
        nothing = nothing | missed
    return both.select("k.*", F.when(nothing, 0.0).otherwise(F.round(100 * penalty * F.exp(logs / orders), 6)).alias("bleu"))

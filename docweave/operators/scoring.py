"""Metrics of answers against references, quality of chunks, and stable splits."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from ..functions import signals as S
from ..functions.text import anchor_form, collapse, given, grams, metric_tokens, normalised, quality_tokens


@pandas_udf(IntegerType())
def overlap_size(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Size of the multiset intersection of two arrays, in time proportional to them."""
    for a, b in pairs:
        yield pd.Series([sum((Counter(x) & Counter(y)).values()) for x, y in zip(a, b, strict=True)], dtype="int32")


def answer_scores(rows: DataFrame, answer: str, reference: str) -> DataFrame:
    """``rows`` with exact, f1, bleu and missing_reference; a blank or null reference scores 0 with missing_reference 1.

    exact and f1 compare normalised texts (two empty ones agree), bleu is the share of the answer's own tokens that
    the reference has, times 100. Tokens are what stands between white space, or characters where there is none.
    """
    null_free = lambda c: F.coalesce(F.col(c), F.lit(""))
    a, r = null_free(answer), null_free(reference)
    rows = rows.withColumns({"__a": metric_tokens(normalised(a)), "__r": metric_tokens(normalised(r)), "__t": metric_tokens(a), "__s": metric_tokens(r)})
    rows = rows.withColumn("__o", overlap_size("__a", "__r"))
    both, missing = F.size("__a") + F.size("__r"), collapse(r) == ""
    hits = F.size(F.filter("__t", lambda x: F.array_contains("__s", x)))
    score = lambda c: F.when(missing, 0.0).otherwise(F.round(c, 6))
    return rows.withColumns(
        {
            "exact": F.when(missing, 0).otherwise((normalised(a) == normalised(r)).cast("int")),
            "f1": score(F.when(both == 0, 1.0).otherwise(2 * F.col("__o") / both)),
            "bleu": score(F.when(F.size("__t") == 0, 0.0).otherwise(100 * hits / F.size("__t"))),
            "missing_reference": missing.cast("int"),
        }
    ).drop("__a", "__r", "__t", "__s", "__o")


def ngram_recall(needle: Column, hay: Column, n: int = 3) -> Column:
    """Share of the needle's n-grams, repeats counted, that the hay contains; containment for shorter needles; 0 for empty or null texts."""
    every = grams(needle, n)
    share = given(hay, lambda h: F.round(F.size(F.filter(every, lambda g: F.contains(h, g))) / F.size(every), 6))
    empty = (F.coalesce(F.length(needle), F.lit(0)) == 0) | (F.coalesce(F.length(hay), F.lit(0)) == 0)
    return F.when(empty, 0.0).when(F.size(every) == 0, F.contains(hay, needle).cast("double")).otherwise(share)


def adjacent_similarity(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``chunks`` with ``adjacent``, the largest Jaccard of quality tokens with the chunk before or after; 0 where there is none, or no token.

    Chunks are shuffled by their document without tokens; those meet by their 64-bit hash.
    """
    order = Window.partitionBy(id_col).orderBy("chunk_index")
    rows = chunks.repartition(id_col).withColumn("__t", F.array_distinct(F.transform(quality_tokens(F.col("text")), lambda t: F.xxhash64(t))))
    rows = rows.withColumns({"__p": F.lag("__t").over(order), "__n": F.lead("__t").over(order)})

    def score(other: str) -> Column:
        sizes = F.array_size("__t") + F.array_size(other)
        share = given(F.array_size(F.array_intersect("__t", other)), lambda common: F.when(sizes == common, 0.0).otherwise(common / (sizes - common)))
        return F.coalesce(share, F.lit(0.0))

    return rows.withColumn("adjacent", F.round(F.greatest(score("__p"), score("__n")), 6)).drop("__t", "__p", "__n")


def chunk_quality(chunks: DataFrame, title: str | None = None) -> DataFrame:
    """``chunks`` (text, adjacent) with quality in 0..1, status (usable, context_only, drop) and the reasons for marks taken off.

    ``title`` names a column with title paths. Null texts count as empty and are dropped.
    """
    path = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    rows = chunks.withColumn("__m", S.marks(F.col("text"), path))
    titled, size, copied = path != "", F.col("__m.size"), F.col("adjacent")
    facts, only_title, filler, table = (F.col(f"__m.{c}") for c in ("facts", "title", "filler", "table"))
    faults = [
        ("short_without_structure", 0.35, (size < 80) & ~titled & ~F.col("__m.lists")), ("title_only", 0.30, only_title), ("table_fragment_without_fact_sentence", 0.25, table),
        ("placeholder_without_qa_text", 0.25, filler), ("high_adjacent_duplicate", 0.20, copied >= 0.84), ("symbol_digit_ratio_abnormal", 0.15, (F.col("__m.odd") >= 0.48) & (size < 320)),
    ]
    score = F.lit(1.0)
    for _, off, found in faults:
        score = score - F.when(found, off).otherwise(0.0)
    for more in (titled, F.col("__m.structure") | S.structure(path) | facts, copied.between(0.18, 0.72) & titled):
        score = score + F.when(more, 0.10).otherwise(0.0)
    rows = rows.withColumn("quality", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))
    status = F.when((size == 0) | filler | (only_title & ~facts), "drop").when(table | (F.col("quality") < 0.52) | ((copied >= 0.90) & ~facts), "context_only").otherwise("usable")
    reasons = F.array_compact(F.array(*[F.when(found, name) for name, _, found in faults]))
    return rows.withColumns({"status": status, "reasons": reasons}).drop("__m")


def split_of(key: Column, shares: tuple[float, float] = (0.8, 0.1), seed: str = "split") -> Column:
    """train, dev or test by a hash of the key: stable under growth and order. Null for a null key."""
    h = F.conv(F.substring(F.sha1(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 6), 16, 10).cast("double") / (1 << 24)
    return F.when(h < shares[0], "train").when(h < shares[0] + shares[1], "dev").otherwise("test")


def stratified_split(rows: DataFrame, key: str, label: str, dev: float = 0.1, test: float = 0.1, least: int = 1, seed: str = "split") -> DataFrame:
    """``rows`` with ``split``: of each label the first by hash are test, then dev, the rest train; null labels train.

    A label of n distinct keys gives each part ``floor(n * share)`` of them, but ``least`` where it has enough to leave one for
    training. Rows of one key stay together. Ranks come from counts of hash buckets, so a label with a third of all rows is many groups.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    keys = rows.select(F.col(label).alias("l"), F.col(key).alias("k"), h.alias("h")).distinct().withColumn("b", F.substring("h", 1, 3))
    buckets = keys.groupBy("l", "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("l").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a label
    buckets = buckets.select("l", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("l")).alias("total"))
    joined = keys.join(buckets, ["b", "l"])
    place = F.col("start") + F.row_number().over(Window.partitionBy("l", "b").orderBy("h", "k"))
    share = lambda s: F.greatest(F.floor(F.col("total") * s), F.when(F.col("total") > 2 * least, least).otherwise(0))
    part = F.when(F.col("p") <= share(test), "test").when(F.col("p") <= share(test) + share(dev), "dev").otherwise("train")
    parts = joined.withColumn("p", place).select(F.col("k").alias(key), F.col("l").alias(label), part.alias("split"))
    return rows.join(parts, [key, label], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: one addition of a number of len(a) bits for each word of b."""
    places: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        places[w] |= 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@pandas_udf(IntegerType())
def _common(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of tokens that both lists have, by growing run lengths of earlier matches."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(b):
        places[w].append(j)
    best, before = 0, {}
    for w in a:
        here = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
        best = max(best, max(here.values(), default=0))
        before = here
    return best


@pandas_udf(IntegerType())
def _run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([common_run(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(rows: DataFrame, answer: str, reference: str) -> DataFrame:
    """``rows`` with ``rouge_l``: F1 of the longest common subsequence of tokens as they are; two empty texts agree, null is empty."""
    rows = rows.withColumns({"__a": metric_tokens(F.col(answer)), "__r": metric_tokens(F.col(reference))})
    rows = rows.withColumn("__l", _common("__a", "__r"))
    both = F.size("__a") + F.size("__r")
    return rows.withColumn("rouge_l", F.when(both == 0, 1.0).otherwise(F.round(2 * F.col("__l") / both, 6))).drop("__a", "__r", "__l")


def reading_tokens(text: Column) -> Column:
    """Single CJK characters, and runs of other characters between white space and marks, in lower case; "=" is a token too."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{P}\p{S}&&[^=]]+", " ")
    return F.regexp_extract_all(low, F.lit(r"([一-鿿]|=|[\p{L}\p{N}&&[^一-鿿]]+)"), F.lit(1))


def reading_scores(rows: DataFrame, key: str, answer: str, references: str) -> DataFrame:
    """``key``, ``f1``, ``em`` (both in 0..100): the best over the array of ``references``, by the longest common run of tokens and by equality.

    Rows with no reference score 0. ``key`` is unique.
    """
    pairs = rows.select(F.col(key).alias("k"), reading_tokens(F.col(answer)).alias("a"), F.explode_outer(references).alias("ref"))
    pairs = pairs.withColumn("r", reading_tokens(F.col("ref"))).withColumn("n", _run("a", "r"))
    both = F.size("a") + F.size("r")
    f1 = F.when(F.col("ref").isNull() | (F.col("n") == 0), 0.0).otherwise(200 * F.col("n") / both)
    em = F.when(F.col("ref").isNotNull() & (F.col("a") == F.col("r")), 100.0).otherwise(0.0)
    return pairs.groupBy(F.col("k").alias(key)).agg(F.round(F.max(f1), 6).alias("f1"), F.max(em).alias("em"))


def lexical_anchor(unit: Column, answer: Column) -> Column:
    """1 where the unit contains the answer, else the share of the answer's character bigrams, repeats counted, that are bigrams of the unit.

    Both as ASCII letters, digits and CJK. 0 for empty or null texts; a single character is its own bigram.
    """
    whole = lambda t: F.when(F.length(t) <= 2, F.array(t)).otherwise(grams(t, 2))

    def score(u: Column, a: Column) -> Column:
        share = given(whole(a), lambda mine: F.round(F.size(F.filter(mine, lambda g: F.contains(u, g))) / F.size(mine), 6))  # two characters are a bigram where they stand
        return F.when((F.length(u) == 0) | (F.length(a) == 0), 0.0).when(F.contains(u, a), 1.0).otherwise(share)

    return given(F.struct(anchor_form(unit).alias("u"), anchor_form(answer).alias("a")), lambda x: score(x["u"], x["a"]))


def anchor_counts(units: list[str], answers: list[str]) -> tuple[list[int], list[int]]:
    """For pairs of texts in their anchor form, how many of the answer's bigrams the unit has, and of how many: their quotient is ``lexical_anchor``. Texts that come again are cut once."""
    own, sets = {}, {}
    hits, sizes = [], []
    for u, a in zip(units, answers, strict=True):
        if u in own:
            mine = own[u]
        else:
            mine = own[u] = {u[i : i + 2] for i in range(len(u) - 1)}
        if a in sets:
            every = sets[a]
        else:
            every = sets[a] = [a[i : i + 2] for i in range(len(a) - 1)]
        if not u or not a or a in u or len(a) <= 2:
            hits.append(int(bool(u and a) and a in u))
            sizes.append(1)
        else:
            hits.append(sum(map(mine.__contains__, every)))
            sizes.append(len(every))
    return hits, sizes

"""Pieces of a text that stand for the whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, given, strip


def _spaced(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{WHITE}]+", " "))


def _first_seen(parts: Column, most: int) -> Column:
    """The first ``most`` pieces that are not blank and differ from all before them in more than white space."""
    keyed = F.transform(F.filter(parts, lambda p: strip(p) != ""), lambda p: F.struct(strip(p).alias("p"), _spaced(p).alias("k")))
    return given(keyed, lambda ks: F.slice(F.filter(F.transform(ks, lambda x, i: F.when(~F.exists(F.slice(ks, F.lit(1), i), lambda y: y["k"] == x["k"]), x["p"])), lambda p: p.isNotNull()), 1, most))


def snippets(text: Column, most: int = 5, chars: int = 2200) -> Column:
    """Array of pieces: of three or more blocks between blank lines, the first two, those at the start, a third, two thirds and the end, and the two longest; else windows of
    ``chars`` at the start and, of texts over twice as long, in the middle and at the end. No piece twice; none for a null or blank text. Blocks end after three times ``chars``.
    """

    def of_blocks(blocks: Column) -> Column:
        n = F.size(blocks)
        at = [F.lit(0), F.lit(1), F.lit(0), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"), n - 1]
        longest = F.transform(F.slice(F.array_sort(F.transform(blocks, lambda b, i: F.struct((-F.length(b)).alias("n"), i.alias("i"), b.alias("b")))), 1, 2), lambda x: x["b"])
        return _first_seen(F.transform(F.concat(F.array(*[blocks[i] for i in at]), longest), lambda b: F.substring(b, 1, 3 * chars)), most)

    def of_windows(flat: Column) -> Column:
        n = F.length(flat)
        middle = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - chars // 2)
        windows = F.array(F.substring(flat, 1, chars), F.when(n > 2 * chars, F.substring(flat, middle + 1, F.lit(chars))).otherwise(""), F.when(n > 2 * chars, F.right(flat, F.lit(chars))).otherwise(""))
        return _first_seen(windows, 3)

    lines = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    blocks = F.filter(F.transform(F.split(lines, "\n\n"), strip), lambda b: b != "")
    return given(blocks, lambda bs: F.when(F.size(bs) >= 3, of_blocks(bs)).otherwise(given(_spaced(lines), of_windows)))

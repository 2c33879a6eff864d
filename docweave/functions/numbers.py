"""Column functions on numbers, dates and JSON. Null in, null out, unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def number_or(c: Column, default: float = 0.0) -> Column:
    """The value as a finite double, else the default."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def rounded(c: Column, digits: int = 4) -> Column:
    """Rounded half to even; null for what is not finite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.bround(x, digits))


def sigmoid(c: Column, centre: float = 0.0, temperature: float = 1.0) -> Column:
    """Logistic function, its argument clamped to +-30."""
    return 1 / (1 + F.exp(-clamp((c - centre) / temperature, -30.0, 30.0)))


def softmax(values: Column, mask: Column | None = None) -> Column:
    """Softmax over an array; where ``mask`` (an array of Booleans) is false or null, 0. All zeros if nothing is left."""
    kept = values if mask is None else F.zip_with(values, mask, lambda x, m: F.when(m, x))
    top = F.array_max(kept)
    powers = F.transform(kept, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def to_unit(similarity: Column, mapping: str = "clip0") -> Column:
    """A similarity in -1..1 as a number in 0..1: linear01, or the positive part."""
    return clamp((similarity + 1) / 2) if mapping == "linear01" else clamp(similarity)


def fused(a: Column, b: Column) -> Column:
    """Geometric mean of two numbers in 0..1."""
    return F.sqrt(clamp(a) * clamp(b))


def perplexity(mean_log2: Column) -> Column:
    return F.pow(F.lit(2.0), -mean_log2)


def fluency(ppl: Column, alpha: float = 0.01, beta: float = 0.8) -> Column:
    """1 for a perplexity of 0, falling with it; 0 for null and what is not finite."""
    good = ppl.isNotNull() & ~F.isnan(ppl) & (ppl != float("inf"))
    return F.when(good, 1 / (1 + alpha * F.pow(F.greatest(ppl, F.lit(0.0)), F.lit(beta)))).otherwise(0.0)


def blended(a: Column, size_a: Column, b: Column, size_b: Column) -> Column:
    """Mean of two numbers by the square roots of the sizes they come from; 0 for two empty ones."""
    wa, wb = F.sqrt(size_a), F.sqrt(size_b)
    return F.when(wa + wb > 0, (wa * a + wb * b) / (wa + wb)).otherwise(0.0)


def grammar(errors: Column) -> Column:
    """Square root of 1 less a tenth for each error, 0 at least; 0.8 where nothing was counted."""
    return F.when(errors.isNull(), 0.8).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - 0.1 * errors)))


def when_was(c: Column) -> Column:
    """Timestamp of ISO text or of epoch seconds or milliseconds written as text; null for anything else."""
    number = c.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_seconds(seconds)).otherwise(F.try_to_timestamp(c))


def elapsed(start: Column, stop: Column) -> Column:
    """Seconds from one timestamp to the other, 0 at least, to the millisecond."""
    return F.round(F.greatest(F.lit(0.0), stop.cast("double") - start.cast("double")), 3)


def json_or_empty(c: Column, schema: str) -> Column:
    """The JSON object in a text; an empty one for null, blank or broken text."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit("{}"), schema))


def json_items(c: Column, schema: str) -> Column:
    """Array of the objects in a JSON text: a list, or an object with the list ``items`` or ``results`` or ``data``, the object ``item``, or the object alone.

    Empty for broken text.
    """
    kind = f"array<struct<{schema}>>"
    inside = lambda name: F.from_json(F.get_json_object(c, f"$.{name}"), kind)
    one = F.from_json(F.coalesce(F.get_json_object(c, "$.item"), c), f"struct<{schema}>")
    return F.when(F.ltrim(c).startswith("["), F.coalesce(F.from_json(c, kind), F.array().cast(kind))).otherwise(F.coalesce(inside("items"), inside("results"), inside("data"), F.when(F.get_json_object(c, "$").isNotNull(), F.array(one)), F.array().cast(kind)))


def score_in(c: Column, name: str) -> Column:
    """A score in 0..1 from JSON that has it as a number, as an object with a score, or under scores; null for others."""
    found = F.coalesce(*[F.get_json_object(c, p).try_cast("double") for p in (f"$.{name}", f"$.{name}.score", f"$.scores.{name}", f"$.scores.{name}.score")])
    return F.when(found.between(0, 1), found)

"""Column expressions: confidences, ranking, the gate, answers and urges. Integers only, and total orders everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels.decide import PROFILES

RANKED = "array<struct<option:int,confidence:int>>"


def confidence(c: Column) -> Column:
    """Held within 0..1000."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), c)).cast("int")


def millis(c: Column) -> Column:
    """Held within -1000..1000."""
    return F.greatest(F.lit(-1000), F.least(F.lit(1000), c)).cast("int")


def halved(c: Column) -> Column:
    return F.call_function("div", c.cast("long"), F.lit(2).cast("long")).cast("int")


def quotient(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def valid_confidence(c: Column) -> Column:
    return F.coalesce(c.between(0, 1000), F.lit(False))


def label_fault(c: Column) -> Column:
    """Why a label is refused, or null: it must be trimmed, not empty, and of at most 256 bytes."""
    return F.when(c.isNull() | (F.trim(c) == ""), "empty").when(F.trim(c) != c, "untrimmed").when(F.octet_length(c) > 256, "too long")


def span_fault(start: Column, end: Column) -> Column:
    return F.when(start > end, "start after end").when(start < 0, "negative start")


def span_slice(text: Column, start: Column, end: Column) -> Column:
    """The text of a span of bytes."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def spans_overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def span_contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def span_text(a: Column) -> Column:
    return F.concat_ws("..", a["start"], a["end"])


def span_cover(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["start"], b["start"]).alias("start"), F.greatest(a["end"], b["end"]).alias("end"))


def least_confidence(profile: Column) -> Column:
    return F.create_map(*(F.lit(x) for name, low, _ in PROFILES for x in (name, low)))[profile]


def least_margin(profile: Column) -> Column:
    return F.create_map(*(F.lit(x) for name, _, margin in PROFILES for x in (name, margin)))[profile]


def ranked(scores: Column) -> Column:
    """An array of one confidence per option as (option, confidence), best first, ties to the lower option."""
    keyed = F.transform(scores, lambda c, i: F.struct((-c).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["i"].cast("int").alias("option"), (-x["k"]).cast("int").alias("confidence")))


def answer(order: Column, profile: Column, shape: str = "choice") -> Column:
    """The gate over a ranking: a struct with the tag *answer* and what belongs to it; other fields are null."""
    low, margin = least_confidence(profile), least_margin(profile)
    top, second = order[0]["confidence"], F.coalesce(F.get(order, F.lit(1))["confidence"], F.lit(0))
    kind = F.when(F.size(order) == 0, "no_candidates").when(top < low, "low_confidence").when(top - second < margin, "low_margin")
    chosen, best = kind.isNull(), F.get(order, F.lit(0))["option"]
    value = F.when(kind == "low_confidence", top).when(kind == "low_margin", top - second)
    why = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), value.cast("int").alias("value"), F.when(kind == "low_confidence", low).when(kind == "low_margin", margin).alias("min")))
    return F.struct(
        F.when(chosen, F.lit(shape)).otherwise("abstain").alias("answer"),
        F.when(chosen & F.lit(shape == "choice"), best).alias("option"),
        F.when(chosen & F.lit(shape == "score"), best).alias("level"),
        F.when(chosen & F.lit(shape == "noul"), best == 1).alias("yes"),
        F.when(chosen, F.get(order, F.lit(0))["confidence"]).alias("confidence"),
        why.alias("why"),
        order.alias("ranked"),
    )


def chosen(answered: Column) -> Column:
    """The option an answer names, or null."""
    return F.coalesce(answered["option"], answered["level"], answered["yes"].cast("int"))


def is_abstain(answered: Column) -> Column:
    return answered["answer"] == "abstain"


def ranked_text(order: Column) -> Column:
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["option"], x["confidence"])), ",")


def reason_text(why: Column) -> Column:
    return (
        F.when(why["kind"] == "low_confidence", F.format_string("low confidence %d < %d", why["value"], why["min"]))
        .when(why["kind"] == "low_margin", F.format_string("low margin %d < %d", why["value"], why["min"]))
        .when(why["kind"] == "no_candidates", "no candidates")
        .when(why["kind"] == "not_converged", "not converged")
        .when(why["kind"] == "confusable", "confusable token matched a guarded term")
        .when(why["kind"] == "input_too_long", "input refused (too long)")
        .when(why["kind"] == "config_mismatch", "config mismatch")
    )


def similarity(a: Column, b: Column, dim: int) -> Column:
    """Thousandths between packed vectors (arrays of longs): (dim - 2 h) * 1000 / dim, truncated toward zero."""
    h = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return quotient((F.lit(dim) - 2 * h) * 1000, F.lit(dim)).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: F.bitwise_not(x))


def component(a: Column, i: int, dim: int) -> Column:
    """+1 or -1."""
    i %= dim
    return 1 - 2 * F.shiftrightunsigned(F.get(a, F.lit(i // 64)), i % 64).bitwiseAND(F.lit(1)).cast("int")

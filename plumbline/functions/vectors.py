"""Expressions over arrays of scores and probabilities. Every array is bound once, so cost stays linear in its length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-300
CLIP = 1e-12


def bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return array_sum(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def softmax(z: Column) -> Column:
    """exp(z - max) over its sum; null for null or empty arrays."""
    shifted = bind(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v.cast("double") - top.cast("double"))))
    return bind(shifted, lambda e: bind(array_sum(e), lambda total: F.transform(e, lambda v: v / total)))


def log_softmax(z: Column) -> Column:
    return bind(F.array_max(z).cast("double"), lambda top: bind(F.log(array_sum(F.transform(z, lambda v: F.exp(v.cast("double") - top)))), lambda total: F.transform(z, lambda v: v.cast("double") - top - total)))


def normalise(x: Column) -> Column:
    return bind(array_sum(x), lambda total: F.transform(x, lambda v: v / total))


def clipped_log(p: Column) -> Column:
    return F.transform(p, lambda v: F.log(F.least(F.greatest(v, F.lit(CLIP)), F.lit(1.0))))


def temperature(p: Column, t: Column) -> Column:
    """softmax(log p / t); with t = 1 the probabilities as they are."""
    return F.when(t == 1.0, p).otherwise(softmax(F.transform(clipped_log(p), lambda v: v / t)))


def top(p: Column) -> Column:
    """Number of the largest entry, the first of equal ones, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def pick(p: Column, i: Column) -> Column:
    return F.element_at(p, (i + 1).cast("int"))


def rotate_back(p: Column, rotation: Column) -> Column:
    """Slots to options: slot s showed option (s + rotation) mod K."""
    k = F.size(p)
    return F.transform(p, lambda _, i: F.element_at(p, (F.pmod(i - rotation, k) + 1).cast("int")))


def rotate(p: Column, rotation: Column) -> Column:
    """Options to slots."""
    k = F.size(p)
    return F.transform(p, lambda _, i: F.element_at(p, (F.pmod(i + rotation, k) + 1).cast("int")))


def brier(p: Column, label: Column) -> Column:
    return array_sum(F.transform(p, lambda v, i: F.pow(v - F.when(i == label, 1.0).otherwise(0.0), F.lit(2.0))))


def log_loss(p: Column, label: Column) -> Column:
    return -F.log(F.greatest(pick(p, label), F.lit(FLOOR)))


def ranked_probability_score(p: Column, label: Column) -> Column:
    """Squared distance of the cumulated probabilities from the label's step, over all levels but the last."""
    folded = F.aggregate(
        F.transform(p, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
        F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("total")),
        lambda s, x: F.struct((s["cum"] + x["v"]).alias("cum"), (s["total"] + F.when(x["i"] < F.size(p) - 1, F.pow(s["cum"] + x["v"] - F.when(x["i"] >= label, 1.0).otherwise(0.0), F.lit(2.0))).otherwise(0.0)).alias("total")),
    )
    return folded["total"]


def bin10(confidence: Column) -> Column:
    return F.least(F.floor(confidence * 10), F.lit(9)).cast("int")


def expected_level(p: Column) -> Column:
    return array_sum(F.transform(p, lambda v, i: v * (i + 1)))


def wilson(hits: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Wilson interval of a proportion; 0 and 0 where n is 0."""
    share = F.try_divide(hits.cast("double"), n)
    middle = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(middle - half), F.when(n == 0, 0.0).otherwise(middle + half)

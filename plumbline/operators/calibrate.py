"""Maps of probabilities that are fitted elsewhere or by counting: histograms, Platt, disagreement temperatures; losses and gradients of heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V

#: Limits of a head's scale and content-free weight, and the tie within which fewer parameters win.
SCALE, CONTENT_FREE, TIE = (0.05, 20.0), (0.0, 2.0), 0.002


def with_top(p: Column, confidence: Column) -> Column:
    """Probabilities whose top one is a given confidence, the others in proportion, without a change of the top option.

    The confidence is at least what keeps the second option second, and at most 1 - 1e-6.
    """
    top, best = V.top(p), F.array_max(p)
    second = F.element_at(F.sort_array(p, False), 2)
    # With confidence c the second becomes second * (1 - c) / (1 - best): level at c = second / (1 - best + second).
    floor = second / F.greatest(1 - best + second, F.lit(1e-12))
    c = F.least(F.greatest(confidence, floor), F.lit(1 - 1e-6))
    return F.transform(p, lambda x, i: F.when(i == top, c).otherwise(x * (1 - c) / F.greatest(1 - best, F.lit(1e-12))))


def platt(confidence: Column, a: float, b: float) -> Column:
    x = F.least(F.greatest(confidence, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(a * F.log(x / (1 - x)) + b)))


def histogram(scored: DataFrame, bins: int = 10) -> DataFrame:
    """bin and share that is right, with one right and one wrong answer added to each of all bins."""
    counted = scored.groupBy(V.bin10(F.col("conf")).alias("bin")).agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").na.fill(0).select("bin", ((F.col("hits") + 1) / (F.col("n") + 2)).alias("share"))


def head_losses(rows: DataFrame, scale: float, content_free: float, bias: list[float]) -> DataFrame:
    """Each readout's slot probabilities p under softmax(scale * z - content_free * zc + bias), the slot of its label, and its loss."""
    offsets = F.array(*map(F.lit, bias))
    u = F.transform(F.zip_with("z", "zc", lambda a, b: scale * a - content_free * b), lambda v, s: v + F.element_at(offsets, s + 1))
    slot = F.pmod(F.col("label") - F.col("rot"), F.col("k")).cast("int")
    out = rows.withColumn("slot", slot).withColumn("p", V.softmax(u))
    return out.withColumn("loss", -F.log(F.greatest(V.pick(F.col("p"), F.col("slot")), F.lit(1e-300))))


def head_gradient(rows: DataFrame, scale: float, content_free: float, bias: list[float], by: list[str]) -> DataFrame:
    """by, parameter and the mean gradient of the loss: scale, content_free, and bias of each slot. One pass, one shuffle of sums."""
    found = head_losses(rows, scale, content_free, bias)
    error = F.transform("p", lambda v, s: v - F.when(s == F.col("slot"), 1.0).otherwise(0.0))
    named = F.concat(
        F.array(F.struct(F.lit("scale").alias("parameter"), V.dot(F.col("error"), F.col("z")).alias("g")), F.struct(F.lit("content_free").alias("parameter"), (-V.dot(F.col("error"), F.col("zc"))).alias("g"))),
        F.transform("error", lambda e, s: F.struct(F.concat(F.lit("bias"), s.cast("string")).alias("parameter"), e.alias("g"))),
    )
    each = found.withColumn("error", error).select(*by, F.explode(named).alias("x")).select(*by, "x.*")
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return each.groupBy(*by, "parameter").agg(F.sum("g").alias("g")).join(whole, by).select(*by, "parameter", (F.col("g") / F.col("n")).alias("gradient"))


def clamp(column: Column, limits: tuple[float, float]) -> Column:
    return F.least(F.greatest(column, F.lit(limits[0])), F.lit(limits[1]))

"""Predictions: slot probabilities by head, rotations averaged, a temperature on the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V

ITEM = ["item_id", "type", "k", "label", "family", "grp", "n"]


def raw(rows: DataFrame, content_free: bool = False) -> DataFrame:
    """Slot probabilities without a head: softmax of z, or of z less zc."""
    z = F.zip_with("z", "zc", lambda a, b: a - b) if content_free else F.col("z")
    return rows.withColumn("p", V.softmax(z))


def linear_head(rows: DataFrame, scale: float, content_free: float, bias: list[float], weights: list[list[float]] | None = None) -> DataFrame:
    """softmax(scale * (z + weights @ h) - content_free * zc + bias), with a bias and weights for each slot."""
    offsets = F.array(*map(F.lit, bias))
    z = F.col("z")
    if weights is not None:
        matrix = F.array(*[F.array(*map(F.lit, row)) for row in weights])
        z = F.transform(z, lambda v, s: v + V.dot(F.element_at(matrix, s + 1), F.col("h")))
    u = F.transform(F.zip_with(z, "zc", lambda a, b: scale * a - content_free * b), lambda v, s: v + F.element_at(offsets, s + 1))
    return rows.withColumn("p", V.softmax(u))


def rotation_mean(slots: DataFrame) -> DataFrame:
    """One row per item: p by option, the mean over its rotations. One shuffle, on the item, after partial sums."""
    options = slots.select(*ITEM, "rot", F.posexplode(V.rotate_back(F.col("p"), F.col("rot"))).alias("opt", "v"))
    means = options.groupBy(*ITEM, "opt").agg(F.avg("v").alias("v"))
    return means.groupBy(*ITEM).agg(F.transform(F.array_sort(F.collect_list(F.struct("opt", "v"))), lambda x: x["v"]).alias("p"))


def apply_temperature(predictions: DataFrame, by_type: dict[str, float]) -> DataFrame:
    """softmax(log p / T), T by type; a type without one keeps its probabilities."""
    t = F.lit(1.0)
    for kind, value in by_type.items():
        t = F.when(F.col("type") == kind, F.lit(value)).otherwise(t)
    return predictions.withColumn("p", V.temperature(F.col("p"), t))


def scored(predictions: DataFrame) -> DataFrame:
    """The columns that all metrics are sums of: top, conf, hit, nll, brier, rps (score items alone), bin."""
    p, label = F.col("p"), F.col("label")
    out = predictions.withColumn("top", V.top(p)).withColumn("conf", F.array_max(p))
    return out.withColumns({"hit": (F.col("top") == label).cast("int"), "nll": V.log_loss(p, label), "brier": V.brier(p, label), "rps": F.when(F.col("type") == "score", V.ranked_probability_score(p, label)), "bin": V.bin10(F.col("conf"))})


def long(frame: DataFrame, keys: list[str], column: str = "p", at: str = "slot", digits: int = 6) -> DataFrame:
    """An array column as rows, rounded."""
    return frame.select(*keys, F.posexplode(column).alias(at, "v")).select(*keys, at, rounded("v", digits).alias(column))


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)

"""Fitting calibrators: a temperature for each type, by bisection on the slope of the mean loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V

#: Bounds of a temperature.
LOW, HIGH = 0.05, 100.0


def slope(predictions: DataFrame, betas: dict[str, float]) -> dict[str, float]:
    """Derivative of the mean loss by beta = 1 / T for each type, at the type's beta. One aggregate of partial sums."""
    beta = F.lit(1.0)
    for kind, value in betas.items():
        beta = F.when(F.col("type") == kind, F.lit(value)).otherwise(beta)
    logs = V.clipped_log(F.col("p"))
    term = V.bind(logs, lambda u: V.dot(V.softmax(F.transform(u, lambda v: v * beta)), u) - V.pick(u, F.col("label")))
    return {r.type: r.slope for r in predictions.groupBy("type").agg(F.avg(term).alias("slope")).collect()}


def fit_temperatures(predictions: DataFrame, steps: int = 40) -> dict[str, float]:
    """T by type that makes the mean loss least, within bounds, to three decimals.

    The slope grows with beta, so all types are bisected at once: a step is one pass over the predictions, and
    only a number for each type reaches the driver. A bound is the result where the slope has no root.
    """
    predictions = predictions.select("type", "p", "label").persist()
    kinds = [r.type for r in predictions.select("type").distinct().collect()]
    low, high = dict.fromkeys(kinds, 1 / HIGH), dict.fromkeys(kinds, 1 / LOW)
    for _ in range(steps):
        middle = {k: (low[k] + high[k]) / 2 for k in kinds}
        found = slope(predictions, middle)
        for k in kinds:
            (high if found[k] > 0 else low)[k] = middle[k]
        if all(high[k] - low[k] < 1e-7 for k in kinds):
            break
    predictions.unpersist()
    return {k: min(max(round(2 / (low[k] + high[k]), 3), LOW), HIGH) for k in kinds}

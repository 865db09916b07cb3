"""Metrics of scored predictions. All are functions of sums, so Spark adds partial sums before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import wilson
from plumbline.operators.predict import rounded

THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)


def metrics(scored: DataFrame, by: list[str] = (), digits: int = 6) -> DataFrame:
    """n, accuracy, log_loss, brier, ece and rps (null without score items), overall or by groups."""
    bins = scored.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("hit").alias("hit"), F.sum("conf").alias("conf"), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"), F.sum("rps").alias("rps"), F.count("rps").alias("scores"))
    n = F.sum("n")
    return bins.groupBy(*by).agg(n.alias("n"), rounded(F.sum("hit") / n, digits).alias("accuracy"), rounded(F.sum("nll") / n, digits).alias("log_loss"), rounded(F.sum("brier") / n, digits).alias("brier"), rounded(F.sum(F.abs(F.col("conf") - F.col("hit"))) / n, digits).alias("ece"), rounded(F.try_divide(F.sum("rps"), F.sum("scores")), digits).alias("rps"))


def reliability(scored: DataFrame, digits: int = 6) -> DataFrame:
    """Ten bins of the top probability: n, mean confidence, accuracy and its Wilson interval; empty bins are all 0."""
    bins = scored.groupBy("bin").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("conf").alias("conf"))
    every = scored.sparkSession.range(10).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").fillna(0, ["n", "hits"])
    low, high = wilson(F.col("hits"), F.col("n"))
    zero = lambda c: F.coalesce(rounded(c, digits), F.lit(0.0))
    return every.select("bin", "n", zero(F.col("conf")).alias("conf"), zero(F.try_divide("hits", "n")).alias("accuracy"), zero(low).alias("low"), zero(high).alias("high"))


def risk_coverage(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, digits: int = 6) -> DataFrame:
    """Accuracy among predictions above each threshold (strictly), and their share. One pass, no join."""
    def kept(t: float) -> Column:
        return F.struct(F.lit(t).alias("threshold"), F.sum((F.col("conf") > t).cast("int")).alias("kept"), F.sum(F.when(F.col("conf") > t, F.col("hit")).otherwise(0)).alias("hits"), F.count("*").alias("n"))

    one = scored.agg(F.array(*map(kept, thresholds)).alias("rows")).select(F.inline("rows"))
    return one.select("threshold", "kept", rounded(F.try_divide("hits", "kept"), digits).alias("accuracy"), rounded(F.try_divide("kept", "n"), digits).alias("coverage"))


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("type", F.col("label").alias("gold"), F.col("top").alias("predicted")).agg(F.count("*").alias("n"))

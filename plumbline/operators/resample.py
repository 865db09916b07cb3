"""Bootstraps from sufficient statistics: every draw is a weight that a hash of resample and key gives.

A resample gives each key (an item, or a group of items that go together) a Poisson weight of mean 1, which is the
limit of drawing as many keys as there are with replacement. A weight depends on the resample and the key alone:
systems share draws, no position of a key is needed, and partial sums combine before the one shuffle, of a row for
each resample and stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.text import unit

#: Resamples, and the bounds of the uniform hash between Poisson weights.
RESAMPLES = 1000
BOUNDS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def weight(resample: Column, key: Column) -> Column:
    u = unit(F.concat_ws(":", resample.cast("string"), key.cast("string")))
    return F.aggregate(F.array(*map(F.lit, BOUNDS)), F.lit(0), lambda n, b: n + F.when(u >= b, 1).otherwise(0))


def draws(rows: DataFrame, key: str, sums: list[str], by: list[str] | None = None, resamples: int = RESAMPLES) -> DataFrame:
    """resample, the columns of by, and the weighted sums of n and of some columns. rows may be items or groups' sums.

    Rows are first summed up by key, so a resample costs a row for each key and not for each item.
    """
    by = by or []
    stats = rows.groupBy(key, *by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    each = stats.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    each = each.withColumn("w", weight(F.col("resample"), F.col(key))).where("w > 0")
    return each.groupBy("resample", *by).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", *sums)])


def interval(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The 2.5th and 97.5th percentiles, interpolated. There is a value for each resample."""
    low, high = (F.percentile(column, F.lit(q)).alias(name) for q, name in ((0.025, "low"), (0.975, "high")))
    return (values.groupBy(*by) if by else values.groupBy()).agg(low, high)

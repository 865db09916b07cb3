"""Connected components of links, by labels that travel along them, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.tables import Tables


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each node reaches over links between columns a and b.

    A round takes the least label among a node's neighbours and then the label of that label, so a star settles
    in two rounds and a chain in about the logarithm of its length. Links with a null end don't count.
    """
    tables = Tables(links.sparkSession, "components")
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    both = tables.put(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = tables.put(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.col("node").alias("before"), F.least("node", "low").alias("component")), "labels")
    while True:
        current = labels.select("node", "component")
        heard = both.join(current.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("heard"))
        near = current.join(heard, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
        above = current.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels = tables.put(near.join(above, "component", "left").select("node", "before", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        if not labels.where("component <> before").take(1):
            tables.drop("links")
            return labels.select("node", "component")

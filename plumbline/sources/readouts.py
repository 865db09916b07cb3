"""Readouts: one row per item and rotation, from a table of vectors.

An item has a type (choice, bool or score) with k options, a label, and one row of logits z and content-free
logits zc for each rotation; slot s of rotation r shows option (s + r) mod k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROTATIONS = 4


def n_rotations(kind, k, most: int = MOST_ROTATIONS):
    """Score items have one rotation; others one for each option, `most` at most (0: no limit)."""
    many = F.when(kind == "score", F.lit(1)).otherwise(k)
    return F.least(many, F.lit(most)) if most else many


def rotation_of(j, k, n):
    """The rotation that the jth of n readouts shows: they are spread over the k options."""
    return F.floor(j * k / n).cast("int")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, type, k, label, family, grp, n and the vector, as doubles, of each row of embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    third = F.col("vec_id") % 3
    kind = F.when(third == 0, "choice").when(third == 1, "bool").otherwise("score")
    k = F.when(third == 0, 10).when(third == 1, 2).otherwise(5)
    out = vectors.select(F.col("vec_id").alias("item_id"), kind.alias("type"), k.alias("k"), (F.col("label") % k).cast("int").alias("label"), F.concat(F.lit("fam"), F.col("vec_id") % 7).alias("family"), (F.col("vec_id") % 50).alias("grp"), F.col("embedding").cast("array<double>").alias("e"))
    return out.withColumn("n", n_rotations(F.col("type"), F.col("k")))


def readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("rot", rotation_of(F.col("j"), F.col("k"), F.col("n")))
    slots = F.sequence(F.lit(0), F.col("k") - 1)
    z = F.transform(slots, lambda s: 8 * F.element_at("e", (s + F.col("rot")) % F.col("k") + 1) + 2 * F.element_at("e", s + 33))
    zc = F.transform(slots, lambda s: F.element_at("e", s + 49))
    return rows.select("item_id", "type", "k", "label", "family", "grp", "n", "rot", z.alias("z"), zc.alias("zc"), F.col("e").alias("h"))


#: The same rows in SQL.
ITEMS_SQL = """
items AS (SELECT vec_id AS item_id, CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'bool' ELSE 'score' END AS type,
  CASE vec_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 5 END AS k, (label % (CASE vec_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 5 END))::INT AS label,
  'fam' || (vec_id % 7) AS family, vec_id % 50 AS grp, embedding::DOUBLE[] AS e,
  CASE vec_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS n FROM embeddings)"""
READOUTS_SQL = (
    ITEMS_SQL
    + """,
rots AS (SELECT *, floor(j * k / n)::INT AS rot FROM (SELECT *, unnest(range(n)) AS j FROM items)),
slots AS (SELECT item_id, type, k, label, family, grp, n, rot, s, (s + rot) % k AS opt, 8 * e[((s + rot) % k) + 1] + 2 * e[s + 33] AS z, e[s + 49] AS zc, e
  FROM (SELECT *, unnest(range(k)) AS s FROM rots)),
soft AS (SELECT *, exp(z - max(z) OVER w) AS ex, sum(exp(z)) OVER w AS tot FROM slots WINDOW w AS (PARTITION BY item_id, rot)),
probs AS (SELECT *, ex / sum(ex) OVER (PARTITION BY item_id, rot) AS p FROM soft),
mean AS (SELECT item_id, type, k, label, family, grp, n, opt, avg(p) AS p FROM probs GROUP BY ALL)"""
)

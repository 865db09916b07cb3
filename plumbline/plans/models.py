"""Queries that iterate or stream: fits, components, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators.components import components
from plumbline.operators.fit import fit_temperatures
from plumbline.operators.predict import raw, rotation_mean
from plumbline.sources.readouts import ITEMS_SQL, items, readouts
from plumbline.streaming.requests import answer


@query("fit_temperature")
def fit_temperature(spark, d):
    fitted = fit_temperatures(rotation_mean(raw(readouts(spark, d))))
    return spark.createDataFrame(sorted(fitted.items()), "type string, temperature double")


@query("linked_clusters", """
WITH RECURSIVE l AS (SELECT DISTINCT grp AS a, 1000 + item_id % 97 AS b FROM (WITH """ + ITEMS_SQL + """ SELECT * FROM items WHERE type = 'score')),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u)
SELECT node, min(seen) AS component FROM r GROUP BY node
""")
def linked_clusters(spark, d):
    return components(items(spark, d).where("type = 'score'").select(F.col("grp").alias("a"), (1000 + F.col("item_id") % 97).alias("b")), "a", "b")


@query("request_answers", "SELECT 'r' || event_id AS id, CASE WHEN event_id % 10 <> 0 THEN CASE WHEN value >= 50 THEN 'high' ELSE 'low' END END AS top, CASE WHEN event_id % 10 = 0 THEN 'type must be choice, bool or score' END AS error FROM events WHERE event_id % 10 = 0 OR value IS NOT NULL")
def request_answers(spark, d):
    """Requests made of events: a tenth has an unknown type."""
    rows = spark.read.parquet(f"{d}/events.parquet").where("event_id % 10 = 0 OR value IS NOT NULL")
    kind = F.when(F.col("event_id") % 10 == 0, "other").otherwise("choice")
    request = F.to_json(F.struct(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), kind.alias("type"), F.array(F.lit("high"), F.lit("low")).alias("options"), F.array(F.when(F.col("value") >= 50, 1.0).otherwise(0.0), F.lit(0.5)).alias("logits")))
    return answer(rows.select(request.alias("value"))).select("id", "top", "error")

"""A stream of requests, each answered on its own: JSON lines in, an answer or an error out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V

REQUEST = "id string, type string, options array<string>, logits array<double>"
TYPES = ("choice", "bool", "score")


def error(r: Column, corrupt: Column) -> Column:
    """The first thing wrong with a request; null if nothing is."""
    k = F.size(r["options"])
    return (
        F.when(corrupt, "not a JSON request")
        .when(r["id"].isNull(), "id is missing")
        .when(~F.coalesce(r["type"].isin(*TYPES), F.lit(False)), "type must be choice, bool or score")
        .when(r["options"].isNull() | (k < 2) | (k > 26), "between 2 and 26 options are needed")
        .when(F.size(F.array_distinct(r["options"])) < k, "options must differ")
        .when(r["logits"].isNull() | (F.size(r["logits"]) != k), "one logit for each option is needed")
    )


def answer(lines: DataFrame, temperature: float = 1.0) -> DataFrame:
    """A row for each line in column value: id, top, probability, error. Batch and stream alike; a bad line stops nothing."""
    r = F.from_json("value", REQUEST)
    known = lines.select(r.alias("r"), F.col("value")).withColumn("error", error(F.col("r"), F.col("r").isNull() | (F.col("value").isNull()) | ~F.trim("value").startswith("{")))
    p = F.when(F.col("error").isNull(), V.temperature(V.softmax(F.col("r.logits")), F.lit(temperature)))
    return known.withColumn("p", p).select(F.col("r.id").alias("id"), F.element_at("r.options", V.top(F.col("p")) + 1).alias("top"), F.round(F.array_max("p"), 6).alias("probability"), "error")


def serve(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """Answer every line of the text files in a folder that isn't answered yet, into Parquet; exactly once, by the checkpoint."""
    return answer(spark.readStream.text(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

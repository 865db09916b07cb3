"""What the operators of this folder share: scratch folders, blobs, row counts."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.tables import Tables, scratch, small_batches

__all__ = ["Tables", "annotate", "blob", "release", "scratch", "small_batches", "text_bytes", "unblob", "written"]


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and lost executors cost nothing."""
    return Tables(frame.sparkSession, what).put(frame, what)


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unblob(column: pa.Array | pa.ChunkedArray, dtype=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)]


def release() -> None:
    """What this worker holds in reserve goes back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim is not None:
        trim(0)


def annotate(docs: DataFrame, text_col: str, keep: list[str], function, added: str) -> DataFrame:
    """The kept columns as the struct `row`, next to the columns that function makes of the texts.

    function takes a pa.Array of texts and gives a list of arrays, one for each column in added. Keeping the
    input's columns in a struct leaves them free to have any name.
    """
    small_batches(docs.sparkSession)
    held = F.struct(*[docs[c].alias(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    packed = docs.select(held.alias("row"), docs[text_col].cast("string").alias("text"))
    schema = StructType([packed.schema["row"], *StructType.fromDDL(added).fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            release()
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("row"), *function(texts)], names=names)
        release()

    return packed.mapInArrow(run, schema)

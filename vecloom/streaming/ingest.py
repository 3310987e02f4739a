"""Continuous insert: a stream of vectors into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import VectorIndex


def insert_stream(stream: DataFrame, spark_path: str, checkpoint: str, id_col: str = "id", vector: str = "embedding", **trigger) -> StreamingQuery:
    """Insert each micro-batch as a version of the index at spark_path.

    A batch's ids are deleted before they are inserted, so a batch that runs again
    after a failure leaves the same entries. Duplicate ids within a batch keep one.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        rows = batch.where(f"{vector} IS NOT NULL").dropDuplicates([id_col]).persist()
        try:
            if not rows.isEmpty():
                VectorIndex.load(batch.sparkSession, spark_path).delete(rows, id_col).insert(rows, id_col, vector)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

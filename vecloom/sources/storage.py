"""Folders for tables that queries write, and readers of vector data."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import to_vector


def work_dir(spark: SparkSession, name: str = "index") -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(remove, spark, root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone: nothing left to do it with
        pass


def from_array(spark: SparkSession, x: np.ndarray, first_id: int = 0) -> DataFrame:
    """(id, embedding) from rows in the driver's memory."""
    return spark.createDataFrame([(first_id + i, row) for i, row in enumerate(np.asarray(x, np.float32).tolist())], "id long, embedding array<float>")


def read_vectors(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "id", vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """(id, embedding) of any source that Spark reads, validated. CSV and JSON hold vectors as arrays or as text."""
    from ..functions.vectors import parse_vector

    df = spark.read.format(fmt).options(**({"header": True} if fmt == "csv" else {})).load(path)
    kind = dict(df.dtypes)[vector]
    v = parse_vector(vector, dim) if kind == "string" else to_vector(vector, dim)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("embedding"))


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, embedding) of .fvecs files: each row an int32 dimension and that many float32. One task a file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if not content:
                    continue
                d = int(np.frombuffer(content, "<i4", 1)[0])
                rows = np.frombuffer(content, "<f4").reshape(-1, d + 1)[:, 1:]
                for i in range(0, len(rows), 8192):
                    part = np.ascontiguousarray(rows[i:i + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), d).cast(pa.list_(pa.float32()))], ["file", "id", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, id long, embedding array<float>")


def write_vectors(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """As Parquet, without a shuffle unless partitions is given."""
    (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)

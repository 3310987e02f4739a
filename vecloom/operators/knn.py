"""Exact nearest neighbours.

One query: a distance column and a top-k, which Spark runs as TakeOrderedAndProject.
Many queries: up to a checked size they are sent to every task; each Arrow batch
of the base is scored against blocks of them with BLAS and leaves its k best for
each query, and a window over those picks the k best of all. More queries are cut
into blocks, and so is the base; each pair of blocks is a group that does the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import DISTANCES, VectorError, distance

#: Queries and bytes of them that may be sent to every task at once.
BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 64 << 20
NEAR = ["qid", "id", "distance", "k"]


def knn(df: DataFrame, vector: str, query: list[float], k: int | None, metric: str = "l2", id_col: str = "id", where: Column | str | None = None,
        offset: int = 0, ties: bool = False, name: str = "distance") -> DataFrame:
    """Rows nearest to one query, with their distance; order by distance, then id.

    where is applied before the search. k None gives all rows. With ties, rows as
    near as the k-th are kept too. Null vectors have no distance and aren't returned.
    """
    q = F.array(*(F.lit(float(x)).cast("float") for x in query))
    rows = df.where(F.col(vector).isNotNull())
    rows = rows.where(where) if where is not None else rows
    rows = rows.withColumn(name, distance(metric, F.col(vector), q))
    if ties and k is not None:
        least = rows.select(name).orderBy(name).limit(k + offset).agg(F.max(name).alias("_most"))
        rows = rows.crossJoin(F.broadcast(least)).where(F.col(name) <= F.col("_most")).drop("_most")
        return rows.orderBy(name, id_col).offset(offset) if offset else rows.orderBy(name, id_col)
    rows = rows.orderBy(name, id_col)
    if k is not None:
        rows = rows.limit(k + offset)
    return rows.offset(offset) if offset else rows


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a column of vectors without nulls, as float64."""
    a = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    d = dim if dim is not None else (len(a) // n if n else 0)
    sizes = np.diff(column.offsets.to_numpy())
    if n and (sizes != d).any():
        raise VectorError(f"different vector dimensions {d} and {int(sizes[sizes != d][0])}")
    return a.reshape(n, d)


def pairwise(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Order values of all pairs (fast form): squared l2, -ip, or cosine."""
    dot = q @ x.T
    if metric == "ip":
        return -dot
    qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None]
    if metric == "l2":
        return np.maximum(qq + xx - 2 * dot, 0)
    norm = qq * xx
    return np.where(norm == 0, 1.0, 1 - np.clip(dot / np.sqrt(np.where(norm == 0, 1, norm)), -1, 1))


def exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The distance of each row pair."""
    if metric == "l2":
        return np.sqrt(((q - x) ** 2).sum(1))
    dot = (q * x).sum(1)
    if metric == "ip":
        return -dot + 0.0
    norm = (q * q).sum(1) * (x * x).sum(1)
    return np.where(norm == 0, 1.0, 1 - np.clip(dot / np.sqrt(np.where(norm == 0, 1, norm)), -1, 1))


def _query_rows(queries: DataFrame, id_col: str, vector: str, k: Column | None = None) -> DataFrame:
    cols = [F.col(id_col).cast("long").alias("q"), F.col(vector).cast("array<float>").alias("v")] + ([k.cast("long").alias("k")] if k is not None else [])
    return queries.where(F.col(vector).isNotNull()).select(*cols)


def _fetch(rows: DataFrame) -> pa.Table | None:
    """The rows, if they are within the bound."""
    t = rows.limit(BROADCAST_QUERIES + 1).toArrow().combine_chunks()
    return None if t.num_rows > BROADCAST_QUERIES or t.nbytes > BROADCAST_BYTES else t


def collect_queries(queries: DataFrame, id_col: str, vector: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, vectors) of a query table whose size is checked; None if it is beyond the bound."""
    t = _fetch(_query_rows(queries, id_col, vector))
    return None if t is None else (t["q"].to_numpy(), _vectors(t))


def _vectors(t: pa.Table) -> np.ndarray:
    return matrix(pa.concat_arrays(t["v"].chunks) if t.num_rows else pa.array([], pa.list_(pa.float32())))


def blocks_of(rows: DataFrame, vector: str = "v") -> int:
    """How many blocks keep the rows of each within four fifths of the bound."""
    n, elements = rows.agg(F.count("*"), F.sum(F.size(vector))).first()
    return max(1, math.ceil(1.25 * n / BROADCAST_QUERIES), math.ceil(1.25 * (4 * (elements or 0) + 24 * n) / BROADCAST_BYTES))


def _nearest(metric: str, exclude_self: bool, ids_q: np.ndarray, q: np.ndarray, most: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(qid, id, distance, k): of the rows at hand those that may be among the k nearest of a query."""
    if x.shape[1] != q.shape[1]:
        raise VectorError(f"different vector dimensions {q.shape[1]} and {x.shape[1]}")
    for i in range(0, len(q), 512):
        d = pairwise(metric, q[i:i + 512], x)
        if exclude_self:
            d[ids_q[i:i + 512][:, None] == ids[None]] = np.inf
        m = min(int(most[i:i + 512].max()), len(x))
        if m < 1:
            continue
        # the m-th least of each query in these rows, with a margin for ties and rounding
        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
        r, c = np.nonzero((d <= edge[:, None] + 1e-9 * np.maximum(1, np.abs(edge[:, None]))) & np.isfinite(d))
        yield pa.RecordBatch.from_arrays([pa.array(ids_q[i + r]), pa.array(ids[c]), pa.array(exact(metric, q[i + r], x[c])), pa.array(most[i + r])], NEAR)


def _near_by_blocks(rows: DataFrame, asked: DataFrame, metric: str, exclude_self: bool) -> DataFrame:
    """Candidates for any number of queries: rows meet queries in a grid of blocks, a cell of which is what one task holds."""
    b, c = blocks_of(asked), blocks_of(rows)
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("q", "v"), F.lit(b))).withColumn("rb", others(c))
    right = rows.withColumn("rb", F.pmod(F.xxhash64("id", "v"), F.lit(c))).withColumn("qb", others(b))
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.float64()), ("k", pa.int64())])

    def cell(queries: pa.Table, base: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows:
            ids_q, q, most = queries["q"].to_numpy(), _vectors(queries), queries["k"].to_numpy()
            for i in range(0, base.num_rows, 10_000):
                part = base.slice(i, 10_000)
                out += _nearest(metric, exclude_self, ids_q, q, most, part["id"].to_numpy(), _vectors(part))
        return pa.Table.from_batches(out, schema)

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(cell, "qid long, id long, distance double, k long")


def knn_join(base: DataFrame, queries: DataFrame, k: int | None = None, metric: str = "l2", id_col: str = "id", vector: str = "embedding",
             query_id: str = "qid", query_vector: str = "embedding", k_col: str | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, id, distance, rank): the k nearest base rows of every query, ties by id.

    k_col names a column of queries with each query's own k. Null vectors on either
    side are left out. exclude_self leaves out base rows with the query's id. Any
    number of queries is answered; those beyond BROADCAST_QUERIES or BROADCAST_BYTES
    meet the base in blocks, which shuffles the base once for each block of them.
    """
    if metric not in DISTANCES:
        raise VectorError(f"unknown metric {metric}")
    asked = _query_rows(queries, query_id, query_vector, F.col(k_col) if k_col else F.lit(k))
    rows = base.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    t = _fetch(asked)
    if t is None:
        near = _near_by_blocks(rows, asked, metric, exclude_self)
    else:
        b = base.sparkSession.sparkContext.broadcast((t["q"].to_numpy(), _vectors(t), t["k"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(b.value[0]):
                    yield from _nearest(metric, exclude_self, *b.value, batch.column("id").to_numpy(), matrix(batch.column("v")))

        near = rows.mapInArrow(run, "qid long, id long, distance double, k long")
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= k").select("qid", "id", "distance", "rank")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): the share of truth's (qid, id) pairs that were found."""
    hit = truth.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def fuse_ranks(a: DataFrame, b: DataFrame, id_col: str = "id", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank): (id, score), best first by score, then id."""
    x = a.select(id_col, F.col("rank").alias("_a"))
    y = b.select(id_col, F.col("rank").alias("_b"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    return x.join(y, id_col, "full_outer").select(id_col, (part("_a") + part("_b")).alias("score"))

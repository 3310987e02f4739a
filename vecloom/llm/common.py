"""What the corpus operators share: written tables that cut lineage, connected
components, and grouped work inside sorted partitions."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word pattern [^\x20\x09-\x0D]+; bytes.split() uses the same six characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset (local tests), a temporary folder is set.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_remove, spark, root)
    return f"{root.rstrip('/')}/vecloom-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone: nothing left to do it with
        pass


class Scratch:
    """Tables written to the shared folder: each cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        atexit.register(_remove, spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in dfs:
            _remove(self.spark, df._scratch_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of(col: Column | str) -> Column:
    """crc32 of the value as text; null gives null."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary"))


def grouped(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to every group of rows with equal keys, each read from a sorted partition.

    Like applyInArrow, without a round trip per group. Only one group is held at a
    time, so callers bound the size of a group. Keys aren't null.
    """
    n = shuffle_partitions(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = (cols[0][1:] != cols[0][:-1])
            for c in cols[1:]:
                change = change | (c[1:] != c[:-1])
            starts = [0, *((change.nonzero()[0] + 1).tolist()), batch.num_rows]
            for i, j in zip(starts, starts[1:]):
                k = tuple(c[i] for c in cols)
                if key is not None and k != key:
                    yield from fn(key, pa.concat_tables(held))
                    held = []
                key = k
                held.append(t.slice(i, j - i))
        if held:
            yield from fn(key, pa.concat_tables(held))

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reached.

    Large-star and small-star passes (Kiveris et al., 2014) contract the graph
    to stars. Neighbour minima are partial aggregates, so a hub's edges are
    combined before the shuffle; the joins back are plain equi-joins that AQE
    may split. Every pass is a written table. Null ends and loops are ignored;
    no edges give an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = scratch.cut(e)

    def stats(x: DataFrame):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = stats(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(mins, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large.where("u > v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.cut(small.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now = stats(nxt)
        scratch.drop(e, large)
        e = nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Cells:
    """A bit for each cell that holds an id: others are surely in no such cell."""

    def __init__(self, bits: int, rows: list):
        self.map = np.zeros(((1 << bits) // 32768 + 2, 4096), np.uint8)
        for r in rows:
            self.map[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)

    def has(self, cells: np.ndarray) -> np.ndarray:
        # buckets count from 1 at cell 1, positions within a bucket from 0
        bucket, position = np.where(cells > 0, (cells - 1) // 32768 + 1, 0), np.where(cells > 0, (cells - 1) % 32768, 0)
        return (self.map[bucket, position >> 3] >> (position & 7).astype(np.uint8) & 1).astype(bool)


def filter_of(ids: DataFrame, col: str):
    """(broadcast Cells of the ids, the column of a row's cell): what a task need not look at.

    About 64 cells an id, at most 2**28 (32 MB); a join keeps what it lets through in vain out.
    """
    spark = ids.sparkSession
    bits = min(28, max(16, math.ceil(math.log2(max(1, ids.count()))) + 6))
    cell = F.pmod(F.xxhash64(col), F.lit(1 << bits))
    maps = ids.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    return spark.sparkContext.broadcast(Cells(bits, maps.collect())), cell


def meeting(rows: DataFrame, *before: str) -> DataFrame:
    """Of (token, before..., sid), all longs, the distinct rows of tokens that two or more rows have, with lo, the sid of the token's first row in this order.

    Only a token's first row is held while its rows go by, so a token may have any
    number of them. A sid has one row a token but for repeated rows.
    """
    cols = ["token", *before, "sid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list = []  # the open token's first row
        last, out = None, False  # the last row's token and sid, and whether the first row was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(c).to_numpy() for c in cols]
            new = np.ones(len(x[0]), bool)
            new[1:] = (x[0][1:] != x[0][:-1]) | (x[-1][1:] != x[-1][:-1])
            new[0] = last != (x[0][0], x[-1][0])
            last = (x[0][-1], x[-1][-1])
            x = [np.concatenate([np.array(first[k:k + 1], np.int64), c[new]]) for k, c in enumerate(x)]
            if not len(x[0]):
                continue
            start = np.ones(len(x[0]), bool)
            start[1:] = x[0][1:] != x[0][:-1]
            at = np.flatnonzero(start)
            count = np.diff(np.append(at, len(start)))
            keep = np.repeat(count > 1, count)
            lo = np.repeat(x[-1][at], count)
            if out:
                keep[0] = False
            out = bool(count[-1] > 1) or (out and at[-1] == 0)
            first = [c[at[-1]] for c in x]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*x, lo)], [*cols, "lo"])

    rows = rows.select(*cols).repartition(shuffle_partitions(rows.sparkSession), "token").sortWithinPartitions(*cols)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*cols, "lo"]))


def spread_join(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with few, which has a row a key: a key's rows are dealt to some tasks by the column `by`.

    Spark takes few for as large as before it is repeated, so it would broadcast what
    is `salts` times what it broadcasts else, which the driver has to build.
    """
    salt = "_salt"
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)))
    return dealt.join(few.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).hint("merge"), [key, salt], how).drop(salt)

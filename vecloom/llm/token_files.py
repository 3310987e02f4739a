"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A set of shards, each of three files of plain little-endian integers:

    shard-00000.ids      uint16 or uint32 ids of the shard's documents, end to end
    shard-00000.offsets  int64, one more than documents: where each starts in the shard
    shard-00000.docs     int64 doc_id of each document

and a Parquet table ``manifest`` (shard, n_docs, n_tokens, base): base is the
number of ids in all earlier shards, a prefix sum over shards. Shards and the
documents in them ascend by doc_id. Files are written under another name and
renamed, so a task that runs again replaces equal files by equal files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, table
from .tokens import loaded, slices

READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def id_type(vocab_size: int) -> np.dtype:
    """The smallest unsigned type that holds every id."""
    return np.dtype("<u2") if vocab_size <= 1 << 16 else np.dtype("<u4")


def _put(files: fs.FileSystem, path: str, parts: list[bytes]) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    files.move(part, path)


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, write the shards to uri and return the manifest.

    uri is on a file system that all executors reach. Null texts are empty
    texts: they hold the end id alone. Rows with equal doc_id are all written, by a hash of the text.
    A null doc_id is stored as -1, so it comes first; other doc_ids aren't negative.
    No rows give no shard with documents.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # the range bounds are sampled: by a hash of the text, as samples of texts would grow in the driver
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = loaded(tokenizer)
        kind = id_type(max(tok.vocab_size, end_id + 1))
        shard = TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(uri)
        files.create_dir(root, recursive=True)
        at = f"{root}/shard-{shard:05d}"
        lengths, ids_of = [], []
        part = f"{at}.ids.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            for batch in batches:
                for piece in slices(batch, "text"):
                    ids, off = tok.encode(piece.column("text"), end_id)
                    out.write(ids.astype(kind).tobytes())
                    lengths.append(np.diff(off))
                    ids_of.append(piece.column("doc_id").to_numpy())
        lengths = np.concatenate([np.zeros(1, np.int64), *lengths])
        offsets = np.cumsum(lengths).astype("<i8")
        files.move(part, f"{at}.ids")
        _put(files, f"{at}.offsets", [offsets.tobytes()])
        _put(files, f"{at}.docs", [x.astype("<i8").tobytes() for x in ids_of])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])], "bits": [kind.itemsize * 8]},
                                         schema=pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bits", pa.int64())]))

    counts = f"{uri}/counts"
    rows.mapInArrow(write, "shard long, n_docs long, n_tokens long, bits long").write.mode("overwrite").parquet(counts)
    # one row a shard: a prefix sum over shards, not over documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(counts).where("n_docs > 0").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{uri}/manifest")
    return spark.read.parquet(f"{uri}/manifest")


def open_ids(files: fs.FileSystem, path: str) -> pa.Buffer:
    """The file memory-mapped where the file system is a mounted one, else read."""
    if isinstance(files, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with files.open_input_file(path) as f:
        return f.read_buffer()


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    start counts the ids of all documents before it; ids_crc32 is over its ids as
    little-endian unsigned 32-bit integers, whatever the width in the file.
    """
    manifest = spark.read.parquet(f"{uri}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(uri)
        for row in (r for b in batches for r in b.to_pylist()):
            at = f"{root}/shard-{row['shard']:05d}"
            ids = np.frombuffer(open_ids(files, f"{at}.ids"), f"<u{row['bits'] // 8}")
            offsets = np.frombuffer(open_ids(files, f"{at}.offsets"), "<i8")
            docs = np.frombuffer(open_ids(files, f"{at}.docs"), "<i8")
            for i in range(0, len(docs), 5000):
                j = min(i + 5000, len(docs))
                block = ids[offsets[i]:offsets[j]].astype("<u4")
                raw, cut = memoryview(block).cast("B"), ((offsets[i:j + 1] - offsets[i]) * 4).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs[i:j]), pa.array(offsets[i:j] + row["base"]), pa.array(np.diff(offsets[i:j + 1])),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(shuffle_partitions(spark), "shard").mapInArrow(read, READ_SCHEMA)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), uri, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, uri).withColumn("doc_id", F.nullif("doc_id", F.lit(-1)))

"""Best-fit packing by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into pieces, of which only the first is
shorter than a sequence; a whole piece fills a sequence alone. The other pieces
are dealt into cells of bounded size. Each cell is evolved on several islands:
an individual is a packing, a crossover injects whole well-filled bins of one
parent into the other, drops bins that hold an injected piece, and best-fits the
displaced pieces. After each epoch the elite of an island moves to the next
island of its cell, through a shuffle, and joins the population there. Then each cell
keeps its fullest bins, and the pieces of its poor bins are dealt anew with those of
other cells, for as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, grouped, table
from .tokens import loaded, slices

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row a piece; uid tells pieces apart even where doc_ids repeat. Null text: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = loaded(tokenizer)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", 5 << 20):
                ids, off = tok.encode(part.column("text"), end_id)
                n = np.diff(off)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                short = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                raw = memoryview(ids.astype("<u4")).cast("B")
                a = (4 * (off[doc] + start)).tolist()
                b = (4 * (off[doc] + start + length)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid + np.arange(len(doc))), part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                    pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[i:j]) for i, j in zip(a, b)], pa.int64())],
                    ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
                uid += len(doc)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class _Bins:
    """Open bins by free space: a bit for each free amount that some bin has gives the best fit at once."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free = capacity, [], []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def open(self, items: list[int], used: int) -> None:
        f = self.capacity - used
        self.by_free[f].append(len(self.bins))
        self.bins.append(items)
        self.free.append(f)
        self.mask |= 1 << f

    def best_fit(self, item: int, size: int) -> None:
        m = self.mask >> size
        if not m:
            self.open([item], size)
            return
        f = size + ((m & -m).bit_length() - 1)
        b = self.by_free[f].pop()
        if not self.by_free[f]:
            self.mask &= ~(1 << f)
        self.bins[b].append(item)
        self.free[b] = f = f - size
        self.by_free[f].append(b)
        self.mask |= 1 << f


def _pack(order: np.ndarray, size: list[int], capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    bins = _Bins(capacity)
    for items in start:
        bins.open(items, sum(map(size.__getitem__, items)))
    for i in order.tolist():
        bins.best_fit(i, size[i])
    return bins.bins


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> float:
    """Falkenauer's: the mean square of the bins' fill, so that full bins beside poor ones win."""
    return sum((sum(map(size.__getitem__, b)) / capacity) ** 2 for b in bins) / len(bins)


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator, share: float) -> list[list[int]]:
    """A child of b with whole well-filled bins of a."""
    fill = np.array([sum(map(size.__getitem__, x)) for x in a])
    k = max(1, int(share * len(a)))
    injected = [list(a[i]) for i in np.argsort(-fill - rng.random(len(a)), kind="stable")[:k]]
    inside = np.zeros(len(size), bool)
    inside[[i for x in injected for i in x]] = True
    kept, displaced = [], []
    for x in b:
        if inside[x].any():
            displaced += [i for i in x if not inside[i]]
        else:
            kept.append(list(x))
    # the poorest bin is dissolved too, as a mutation
    if len(kept) > 1:
        displaced += kept.pop(int(np.argmin([sum(map(size.__getitem__, x)) for x in kept])))
    d = np.array(displaced, np.int64)
    d = d[np.argsort(-np.array(size)[d], kind="stable")] if len(d) else d
    return _pack(d, size, capacity, injected + kept)


def _assign(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins_of(assign: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(assign.max()) + 1)]
    for i, k in enumerate(assign.tolist()):
        out[k].append(i)
    return [b for b in out if b]


def evolve(sizes: np.ndarray, capacity: int, seed: int, population: list[list[list[int]]], individuals: int, generations: int) -> list[list[list[int]]]:
    """The population after some generations, the best first. An individual is a list of bins."""
    rng = np.random.default_rng(seed)
    size = sizes.tolist()
    down = np.argsort(-sizes, kind="stable")
    pop = list(population)
    if not pop:
        pop.append(_pack(down, size, capacity))
    while len(pop) < individuals:  # best fit decreasing of sizes with some noise
        noise = sizes * (1 + 0.2 * rng.random(len(sizes)))
        pop.append(_pack(np.argsort(-noise, kind="stable"), size, capacity))
    least = -(-int(sizes.sum()) // capacity)
    key = lambda x: (len(x), -fitness(x, size, capacity))
    pop.sort(key=key)
    for _ in range(generations):
        if len(pop[0]) == least:
            break
        a, b = pop[0], pop[1 + int(rng.integers(len(pop) - 1))]
        if rng.random() < 0.5:
            a, b = b, a
        pop = sorted([*pop, crossover(a, b, size, capacity, rng, 0.5)], key=key)[:individuals]
    return pop[:individuals]


def _cells(pieces: DataFrame, cell_size: int, salt: int) -> DataFrame:
    """Deal pieces to cells by hash: as many as needed for cell_size pieces in each, on average."""
    n = max(1, -(-pieces.count() // cell_size))
    return pieces.withColumn("cell", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n)))


def islands(pieces: DataFrame, scratch: Scratch, capacity: int, cell_size: int = 10_000, n_islands: int = 2, epochs: int = 2,
            individuals: int = 3, generations: int = 6, salt: int = 0) -> DataFrame:
    """(uid, length, cell, bin, fill): the best packing found of each cell of pieces (uid, length). An island keeps its population from epoch to epoch, beside the guest."""
    cells = grouped(_cells(pieces, cell_size, salt), ["cell"], _collect, "cell long, uids array<long>, sizes array<int>")
    isles = cells.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(n_islands - 1)))).withColumn("guest", F.lit(False)).withColumn("population", F.array().cast("array<array<int>>")).withColumn("bins", F.lit(0))
    schema = "cell long, uids array<long>, sizes array<int>, island int, guest boolean, population array<array<int>>, bins int"

    def step(epoch: int):
        def run(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = t.sort_by("guest").to_pylist()
            row, island = rows[0], int(key[1])
            sizes = np.array(row["sizes"], np.int64)
            seed = zlib.crc32(f"{salt} {epoch} {row['cell']} {island}".encode())
            first = [_bins_of(np.array(x)) for r in rows for x in r["population"]]
            if not first and island:  # island 0 starts from the plain best fit decreasing, the others from noisy ones
                first = [_pack(np.argsort(-sizes * (1 + 0.2 * np.random.default_rng(seed).random(len(sizes)))), sizes.tolist(), capacity)]
            pop = [_assign(x, len(sizes)).tolist() for x in evolve(sizes, capacity, seed, first, individuals, generations)]
            bins = 1 + max(pop[0])
            if epoch + 1 == epochs:
                out = [row | {"population": pop[:1], "bins": bins}]
            else:  # elites migrate round the ring
                out = [row | {"guest": False, "population": pop, "bins": bins}, row | {"guest": True, "island": (island + 1) % n_islands, "population": pop[:1], "bins": bins}]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

        arrow = pa.schema([("cell", pa.int64()), ("uids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("island", pa.int32()), ("guest", pa.bool_()), ("population", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32())])
        return run

    for epoch in range(epochs):
        isles = grouped(isles, ["cell", "island"], step(epoch), schema)
    isles = isles.withColumn("elite", F.element_at("population", 1))
    best = isles.groupBy("cell").agg(F.min_by(F.struct("uids", "sizes", "elite"), F.struct("bins", "island")).alias("b"))
    flat = best.select("cell", F.explode(F.arrays_zip(F.col("b.uids").alias("uid"), F.col("b.sizes").alias("length"), F.col("b.elite").alias("bin"))).alias("p"))
    flat = flat.select("cell", "p.*")
    return scratch.cut(flat.withColumn("fill", F.sum("length").over(Window.partitionBy("cell", "bin"))))


def _collect(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
    t = t.sort_by("uid")
    yield pa.RecordBatch.from_arrays([pa.array([int(key[0])]), pa.array([t["uid"].to_pylist()], pa.list_(pa.int64())), pa.array([t["length"].to_pylist()], pa.list_(pa.int32()))], ["cell", "uids", "sizes"])


def pack(pieces: DataFrame, scratch: Scratch, capacity: int, good: float = 0.98) -> DataFrame:
    """(uid, sequence_id, offset) for every piece (uid, length).

    In each round bins filled to `good` are kept and the pieces of the others are
    dealt to new cells, until a round packs them into no fewer bins than they were in.
    No pieces give an empty table.
    """
    whole = pieces.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("seq"), F.lit(0).cast("long").alias("offset"))
    full = F.col("fill") >= int(good * capacity)
    got = islands(pieces.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length")), scratch, capacity)
    got = got.withColumn("seq", F.col("cell") * (1 << 20) + F.col("bin"))
    done = []
    while True:
        done.append(got.where(full))
        poor = got.where(~full)
        new = islands(poor.select("uid", "length"), scratch, capacity, salt=len(done))
        fewer = new.select("cell", "bin").distinct().count() < poor.select("seq").distinct().count()
        if not fewer:
            done.append(poor)
            break
        got = new.withColumn("seq", F.lit(len(done) << 43) + F.col("cell") * (1 << 20) + F.col("bin"))
    mixed = done[0]
    for d in done[1:]:
        mixed = mixed.union(d)
    before = Window.partitionBy("seq").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    mixed = mixed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    out = whole.union(mixed.select("uid", "seq", "offset"))
    return out.select("uid", F.col("seq").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is its end id. Repeated rows are packed as often as they come; a
    null doc_id stays null. Other columns are ignored. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.cut(cut_pieces(docs, tokenizer, end_id, capacity))
    placed = pack(pieces, scratch, capacity)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)

"""A clustering index with one-bit codes, kept as versions of Parquet tables.

    <path>/centroids/v=N   the tree of a version
    <path>/postings/s=N    a segment: part, cluster_id, id, replica, f_add, f_rescale,
                           f_error, norm2, bits, seq; partitioned by part, sorted by cluster
    <path>/tombstones/s=N  deleted ids (id, seq): they hide entries of an earlier seq
    <path>/meta/v=N        one JSON row, written last: it makes a version visible

Nothing written is changed, so readers of a version are never disturbed; there is
one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rabitq
from ..functions.vectors import VectorError
from ..plans import sizing
from ..sources.storage import work_dir
from . import knn as exact_knn
from .kmeans import Router, build_tree, soar_choice, unit

POSTING = "cluster_id int, id long, replica boolean, f_add float, f_rescale float, f_error float, norm2 float, bits binary"
MAX_PARTS = 64
ROUTE_CANDIDATES = 32
#: Rows that clusters are fitted on: at least, for each list, and at most. The bound is what the driver holds.
SAMPLE_LEAST, SAMPLE_PER_LIST, SAMPLE_MOST = 10_000, 256, 200_000
#: Rows that a task routes or scores at a time, and queries that it scores them for: what it holds, whatever the input.
TASK_ROWS, TASK_QUERIES = 1024, 512
#: Pairs of query and row that a task holds before it keeps the best of them.
HELD_ROWS = 1_000_000
#: Parts that one pass of rebalance cuts a list into by k-means, and the share of a list that a part keeps if k-means doesn't tell its rows apart.
SPLIT_PARTS, SPLIT_KEPT = 32, 0.9
#: Rows of the sample that a build searches exactly to find how many lists hold this share of their ten neighbours.
TUNING_QUERIES, TUNING_SHARE = 200, 0.97


@dataclass
class Options:
    """Build options; 0 and auto mean that the build decides."""

    metric: str = "l2"
    nlist: int = 0
    fan_out: int = sizing.DEFAULT_FAN_OUT
    target_pages: int = sizing.DEFAULT_TARGET_PAGES
    kmeans_nredo: int = 1
    soar_lambda: float = 1.0
    boundary_epsilon: float = 0.35
    centroid_compression: str = "auto"
    fastscan: str = "auto"
    centroid_fastscan: str = "auto"
    posting_reference_format: str = "float16"
    distance_mode: str = "asymmetric"
    seed: int = rabitq.DEFAULT_SEED
    leaf_refine: bool = False

    def check(self) -> None:
        ranges = {"nlist": (0, sizing.MAX_NLIST), "fan_out": (2, 255), "target_pages": (1, 64), "kmeans_nredo": (1, 20), "soar_lambda": (0, 100), "boundary_epsilon": (0, 100)}
        for name, (lo, hi) in ranges.items():
            if not lo <= getattr(self, name) <= hi:
                raise VectorError(f"{name} is between {lo} and {hi}")
        for name, values in {"metric": ("l2", "ip", "cosine"), "centroid_compression": ("auto", "on", "off"), "fastscan": ("auto", "on", "off"), "centroid_fastscan": ("auto", "on", "off"),
                             "posting_reference_format": ("float16", "float32"), "distance_mode": ("asymmetric", "symmetric")}.items():
            if getattr(self, name) not in values:
                raise VectorError(f"{name} is one of {', '.join(values)}")
        if self.metric == "ip" and "on" in (self.centroid_compression, self.centroid_fastscan):
            raise VectorError("centroids can't be compressed for inner product")
        if self.centroid_fastscan == "on" and self.centroid_compression == "off":
            raise VectorError("centroid_fastscan needs centroid_compression")


@dataclass
class Meta:
    dim: int
    options: dict
    nlist: int
    fan_out: int
    nlevels: int
    rows: int
    version: int = 1
    seq: int = 1
    segments: list[str] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    centroids: str = ""
    explicit: list[str] = field(default_factory=list)
    maintained: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)


def reference(c: np.ndarray, fmt: str) -> np.ndarray:
    """The list's encode reference, rounded as it is stored."""
    if fmt == "float16":
        if np.abs(c).max(initial=0) > 65504:
            raise VectorError("a centroid is out of range for float16 references")
        return c.astype(np.float16).astype(np.float64)
    return c.astype(np.float64)


def _vectors(x: np.ndarray) -> pa.Array:
    """Rows as a column of vectors."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)), pa.array(x.astype(np.float32).ravel()))


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, meta: Meta):
        self.spark, self.path, self.meta = spark, path, meta
        self.options = Options(**meta.options)
        self._nodes: list[dict] | None = None

    # ---- tables ----

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
        """The newest version, or a given one."""
        rows = spark.read.text(f"{path}/meta").select("value", "v").where(F.lit(True) if version is None else F.col("v") == version)
        row = rows.orderBy(F.desc("v")).first()
        if row is None:
            raise VectorError(f"no index version at {path}")
        return cls(spark, path, Meta(**json.loads(row["value"])))

    def _commit(self, meta: Meta) -> VectorIndex:
        self.spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta/v={meta.version}")
        return VectorIndex(self.spark, self.path, meta)

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(self.meta.centroids)

    def nodes(self) -> list[dict]:
        """The tree, bounded by the number of lists."""
        if self._nodes is None:
            self._nodes = [r.asDict() for r in self.centroids().orderBy("node_id").collect()]
        return self._nodes

    def postings(self, live: bool = True) -> DataFrame:
        """Entries of the version's lists; live leaves out deleted ones, else they are marked."""
        read = self.spark.read.schema(f"{POSTING}, seq long, part int").parquet  # a segment without rows has no schema of its own
        df = read(self.meta.segments[0]).withColumn("segment", F.lit("base"))
        for s in self.meta.segments[1:]:
            df = df.unionByName(read(s).withColumn("segment", F.lit("delta")))
        leaves = self.centroids().where("is_leaf").select("cluster_id")
        df = df.join(F.broadcast(leaves), "cluster_id", "left_semi") if "split" in self.meta.stats else df
        if not self.meta.tombstones:
            return df if live else df.withColumn("deleted", F.lit(False))
        dead = self.spark.read.parquet(*self.meta.tombstones).groupBy("id").agg(F.max("seq").alias("dead_seq"))
        df = df.join(dead, "id", "left").withColumn("deleted", F.coalesce(F.col("seq") < F.col("dead_seq"), F.lit(False))).drop("dead_seq")
        return df.where("NOT deleted").drop("deleted") if live else df

    # ---- build ----

    @classmethod
    def build(cls, df: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", sample_most: int = SAMPLE_MOST, **options) -> VectorIndex:
        """Index every row of df with a vector; the clusters are fitted on a sample by hash of id, at most sample_most rows.

        Null vectors get no entry. Cosine indexes rows of length 1; zero vectors are
        stored out of reach. No rows give one list that returns nothing.
        """
        spark, opt = df.sparkSession, Options(**options)
        opt.check()
        rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        shape = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
        n, dim = shape["n"], shape["hi"] or 1
        if shape["lo"] != shape["hi"]:
            raise VectorError(f"different vector dimensions {shape['lo']} and {shape['hi']}")
        nlist = min(opt.nlist or sizing.auto_nlist(n, dim, opt.target_pages), max(n, 1))
        fan_out = sizing.auto_fan_out(nlist, opt.fan_out)
        want = min(sample_most, max(SAMPLE_LEAST, SAMPLE_PER_LIST * nlist))
        usable = rows.where(F.exists("v", lambda x: x != 0)) if opt.metric == "cosine" else rows
        sample = usable.orderBy(F.xxhash64("id", F.lit(opt.seed)), "id").limit(want).select("id", "v").toArrow().combine_chunks()
        x = exact_knn.matrix(sample["v"].chunk(0)) if sample.num_rows else np.eye(1, dim)
        nodes = build_tree(x, nlist, max(2, fan_out), opt.metric, opt.seed, opt.kmeans_nredo)
        leaves = sum(t["is_leaf"] for t in nodes)
        meta = Meta(dim, asdict(opt), leaves, fan_out, 1 + max(t["level"] for t in nodes), n, explicit=sorted(options), stats={"sampled": len(x)})
        meta.centroids, meta.segments = f"{path}/centroids/v=1", [f"{path}/postings/s=1"]
        index = cls(spark, path, meta)
        index._nodes = nodes
        index._write_centroids(nodes, meta.centroids)
        if opt.leaf_refine:
            index._refine(rows, meta)
        index._write_postings(index.encode(index.assign(rows)), meta.segments[0], 1)
        meta.stats["nprobe"], meta.stats["nprobe_of"] = index._tune(rows, sample.slice(0, TUNING_QUERIES)), leaves
        return index._commit(meta)

    def _tune(self, rows: DataFrame, queries: pa.Table) -> int:
        """Lists to read so that TUNING_SHARE of the queries' ten nearest rows, found exactly, are in them."""
        if not queries.num_rows or self.meta.nlist == 1:
            return 1
        asked = self.spark.createDataFrame(list(zip(queries["id"].to_pylist(), queries["v"].to_pylist())), "qid long, embedding array<float>")
        truth = exact_knn.knn_join(rows, asked, 10, self.options.metric, "id", "v", exclude_self=True).select("qid", "id")
        held = self.postings().select("id", "cluster_id").join(F.broadcast(truth), "id").collect()  # 10 rows a query and their replicas
        router, metric = Router(self.nodes(), self.options.metric), self.options.metric
        column = {int(router.cluster[i]): j for j, i in enumerate(router.leaves.tolist())}
        x = exact_knn.matrix(queries["v"].combine_chunks())
        x = dict(zip(queries["id"].to_pylist(), unit(x) if metric == "cosine" else x))
        by_query: dict[int, list] = {}
        for r in held:
            by_query.setdefault(r["qid"], []).append((r["id"], column[r["cluster_id"]]))
        need: dict[tuple, int] = {}
        for qid, found in by_query.items():
            d = exact_knn.pairwise(metric, x[qid][None], router.centroid[router.leaves])[0]
            place = np.argsort(np.argsort(d, kind="stable"), kind="stable") + 1
            for id_, j in found:
                need[qid, id_] = min(int(place[j]), need.get((qid, id_), len(d)))
        least = sorted(need.values())
        return least[max(0, int(np.ceil(TUNING_SHARE * len(least))) - 1)] if least else 1

    def auto_nprobe(self) -> int:
        """The rule's number of lists, or what the build found to be needed, in proportion to the lists there are now."""
        tuned = -(-self.meta.stats.get("nprobe", 1) * self.meta.nlist // max(1, self.meta.stats.get("nprobe_of", self.meta.nlist)))
        return min(self.meta.nlist, sizing.MAX_NPROBE, max(sizing.auto_nprobe(self.meta.nlist), tuned))

    def _write_centroids(self, nodes: list[dict], where: str) -> None:
        schema = "node_id int, parent_id int, level int, is_leaf boolean, cluster_id int, centroid array<float>"
        self.spark.createDataFrame([tuple(t[k] for k in ("node_id", "parent_id", "level", "is_leaf", "cluster_id", "centroid")) for t in nodes], schema).coalesce(1).write.mode("overwrite").parquet(where)

    def _refine(self, rows: DataFrame, meta: Meta) -> None:
        """Replace leaves' centroids by means over the whole table."""
        from ..functions.vectors import mean_vector

        means = {r["cluster_id"]: r["m"] for r in self.assign(rows, replicas=False).groupBy("cluster_id").agg(mean_vector("v", meta.dim).alias("m")).collect()}
        for t in self.nodes():
            if t["is_leaf"] and t["cluster_id"] in means:
                m = np.array([means[t["cluster_id"]]], np.float64)
                t["centroid"] = (unit(m) if self.options.metric == "cosine" else m)[0].astype(np.float32).tolist()
        self._write_centroids(self._nodes, meta.centroids)

    def _shared_router(self):
        return self.spark.sparkContext.broadcast(Router(self.nodes(), self.options.metric))

    def assign(self, rows: DataFrame, replicas: bool = True, candidates: int = ROUTE_CANDIDATES) -> DataFrame:
        """(id, v, cluster_id, replica) for rows (id, v): the nearest list, and at most one more.

        A second list is given where boundary_epsilon lets it; soar_lambda above 0
        chooses which. Cosine rows come back with length 1; zero rows keep one list.
        """
        router, opt = self._shared_router(), self.options
        most = candidates if replicas else 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = router.value
            for batch in (b.slice(i, TASK_ROWS) for b in batches for i in range(0, b.num_rows, TASK_ROWS)):
                x = exact_knn.matrix(batch.column("v"))
                if x.shape[1] != r.centroid.shape[1]:
                    raise VectorError(f"different vector dimensions {r.centroid.shape[1]} and {x.shape[1]}")
                x = unit(x) if opt.metric == "cosine" else x
                cluster, at = r.route(x, max(most, 2 if replicas else 1), max(ROUTE_CANDIDATES, most))
                pick_row, pick_cluster, pick_replica = [np.arange(len(x))], [cluster[:, 0]], [np.zeros(len(x), bool)]
                if replicas and opt.boundary_epsilon > 0 and cluster.shape[1] > 1:
                    d = exact_knn.exact if opt.metric != "l2" else (lambda m, a, b: ((a - b) ** 2).sum(1))
                    d1, d2 = d(opt.metric, x, r.centroid[at[:, 0]]), d(opt.metric, x, r.centroid[at[:, 1]])
                    near = np.flatnonzero((d1 != 0) & (d2 - d1 <= opt.boundary_epsilon * np.abs(d1)) & x.any(1) & (cluster[:, 1] >= 0))
                    second = cluster[near, 1]
                    if opt.soar_lambda > 0 and len(near):
                        others = np.where((at[near, 1:] >= 0)[:, :, None], r.centroid[at[near, 1:]], np.nan)
                        second = cluster[near, 1 + soar_choice(x[near], r.centroid[at[near, 0]], others, opt.soar_lambda)]
                    pick_row.append(near)
                    pick_cluster.append(second)
                    pick_replica.append(np.ones(len(near), bool))
                i = np.concatenate(pick_row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i)), _vectors(x[i]), pa.array(np.concatenate(pick_cluster).astype(np.int32)), pa.array(np.concatenate(pick_replica))], ["id", "v", "cluster_id", "replica"])

        return rows.mapInArrow(run, "id long, v array<float>, cluster_id int, replica boolean")

    def encode(self, assigned: DataFrame) -> DataFrame:
        """Postings of assigned rows: codes of the residual to the list's rounded reference."""
        refs = {t["cluster_id"]: np.array(t["centroid"]) for t in self.nodes() if t["is_leaf"]}
        shared = self.spark.sparkContext.broadcast({k: reference(v, self.options.posting_reference_format) for k, v in refs.items()})
        rotation, cosine = rabitq.Rotation(self.meta.dim, self.options.seed), self.options.metric == "cosine"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, TASK_ROWS) for b in batches for i in range(0, b.num_rows, TASK_ROWS)):
                x = exact_knn.matrix(batch.column("v"))
                c = batch.column("cluster_id").to_numpy()
                bits, f_add, f_rescale, f_error = rabitq.encode_residuals(rotation(x - np.stack([shared.value[k] for k in c.tolist()])))
                if cosine:  # zero rows are stored, but never found
                    zero = ~x.any(1)
                    f_add, f_error = np.where(zero, np.inf, f_add), np.where(zero, 0, f_error)
                f4 = lambda a: pa.array(a.astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column("cluster_id"), batch.column("id"), batch.column("replica"), f4(f_add), f4(f_rescale), f4(f_error), f4((x * x).sum(1)), pa.array([b.tobytes() for b in bits], pa.binary())],
                                                 ["cluster_id", "id", "replica", "f_add", "f_rescale", "f_error", "norm2", "bits"])

        return assigned.mapInArrow(run, POSTING)

    def parts(self) -> int:
        return min(max(self.meta.nlist, 1), MAX_PARTS)

    def _write_postings(self, entries: DataFrame, where: str, seq: int) -> None:
        """One file of a part at most, whole lists next to each other; a large list is spread by id."""
        rows = entries.withColumn("part", F.pmod("cluster_id", F.lit(MAX_PARTS))).withColumn("seq", F.lit(seq).cast("long"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "part", F.pmod(F.xxhash64("id"), F.lit(max(1, n // MAX_PARTS))))
        rows.sortWithinPartitions("part", "cluster_id", "id").write.mode("overwrite").partitionBy("part").parquet(where)

    # ---- search ----

    def search(self, queries: DataFrame, k: int, source: DataFrame | None = None, nprobe: int = 0, rerank: bool = True, rerank_pool: int = 0, beam_scale: float = 0.5,
               where: str | None = None, post_filter: bool = False, selectivity: float = 1.0, symmetric: bool | None = None, query_id: str = "qid", query_vector: str = "embedding",
               id_col: str = "id", vector: str = "embedding", offset: int = 0, stats: list | None = None) -> DataFrame:
        """(qid, id, distance, rank): about the k nearest rows of every query.

        Lists nearest to a query are read. A task holds entries beside their rows of
        source (needed for rerank and where), rules entries out by the bound of their
        estimate, ranks the best of each TASK_ROWS of the rest by their exact distance, and
        leaves the k best of each query, so that queries times k times tasks is what is
        shuffled. rerank_pool is how many of them are ranked exactly. where filters before
        the search; with post_filter it filters what a search for more neighbours found, and
        queries that it leaves without k are searched again with the filter before. Inner
        product ranks estimates of the product and rules none out, as the bound is one
        of l2. stats, a list, gets counters of the search. Queries beyond the bound of
        what is sent to tasks are searched in parts, each with its own counters.
        """
        opt, meta = self.options, self.meta
        if k < 1:
            raise VectorError("k is at least 1")
        if source is None and (rerank or where is not None):
            raise VectorError("rerank and where need the source rows")
        nprobe = min(meta.nlist, nprobe or self.auto_nprobe())
        ask = k + offset
        find = sizing.inflate_for_filter(ask, selectivity) if post_filter else ask
        again = partial(self.search, k=k, source=source, nprobe=nprobe, rerank=rerank, rerank_pool=rerank_pool, beam_scale=beam_scale, where=where, selectivity=selectivity,
                        symmetric=symmetric, query_id=query_id, query_vector=query_vector, id_col=id_col, vector=vector, offset=offset)
        collected = exact_knn.collect_queries(queries, query_id, query_vector)
        if collected is None:
            asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector).distinct()
            n = exact_knn.blocks_of(asked, query_vector)
            part = F.pmod(F.xxhash64(query_id, query_vector), F.lit(n))
            return reduce(DataFrame.union, (again(asked.where(part == i), post_filter=post_filter, stats=stats) for i in range(n)))
        qids, qs = collected
        if len(qids) and qs.shape[1] != meta.dim:
            raise VectorError(f"different vector dimensions {meta.dim} and {qs.shape[1]}")
        qs = unit(qs) if opt.metric == "cosine" else qs
        router = Router(self.nodes(), opt.metric)
        probed = self._probed(router, qs, nprobe, beam_scale)
        entries = self.postings()
        lists = probed.any(1)
        if not lists.all():
            lists = sorted(router.cluster[router.leaves[lists]].tolist())
            entries = entries.where(F.col("part").isin(sorted({c % MAX_PARTS for c in lists}))).where(F.col("cluster_id").isin(lists))
        rows = None
        if source is not None:
            rows = source.where(where) if where is not None and not post_filter else source
            rows = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
            if not rerank and where is not None and not post_filter:
                entries = entries.join(rows.select("id"), "id", "left_semi")
        size = sizing.rerank_pool(find, max(nprobe, 1), rerank_pool) if rerank else None
        pool = np.full(len(qids), np.iinfo(np.int64).max if size is None else size, np.int64)
        if size is not None and rerank_pool == 0:  # an eighth of all entries that are read for the query, if that is more
            held = entries.join(rows.select("id"), "id", "left_semi") if where is not None and not post_filter else entries
            count = {r["cluster_id"]: r["count"] for r in held.groupBy("cluster_id").count().collect()}  # a row a list
            count = np.array([count.get(int(c), 0) for c in router.cluster[router.leaves]], np.int64)
            for i in range(0, len(qids), TASK_QUERIES):
                some = np.unpackbits(probed[:, i // 8:(i + TASK_QUERIES) // 8], axis=1, count=min(TASK_QUERIES, len(qids) - i))
                pool[i:i + TASK_QUERIES] = np.maximum(size, count @ some // 8)
        if rerank:
            entries = entries.join(rows, "id")
        score = self._scorer(qids, qs, probed, router, opt.distance_mode == "symmetric" if symmetric is None else symmetric, find, pool, rerank)
        if stats is not None:
            stats.append({"k": find, "lists": int(probed.any(1).sum()), "probes": int(np.bitwise_count(probed).sum()), "centroids": len(router.centroid), "counted": entries.mapInArrow(partial(score, True), "entries long, candidates long")})
        # an entry's replicas count once
        found = entries.mapInArrow(partial(score, False), "qid long, id long, distance double").repartition("qid").groupBy("qid", "id").agg(F.min("distance").alias("distance"))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
        if where is not None and post_filter:
            found = found.withColumn("rank", rank).where(F.col("rank") <= find).drop("rank")
            found = found.join(source.where(where).select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
            found = self._kept(found.withColumn("rank", rank).where(F.col("rank") <= ask))
            full = found.groupBy("qid").count().where(F.col("count") >= ask).select("qid").toArrow()["qid"].to_numpy()  # at most a row a query
            short = np.flatnonzero(~np.isin(qids, full))
            if len(short):
                asked = self.spark.createDataFrame([(int(qids[i]), v) for i, v in zip(short.tolist(), qs[short].tolist())], f"`{query_id}` long, `{query_vector}` array<double>")
                return found.where(F.col("rank") > offset).join(F.broadcast(asked.select(F.col(query_id).alias("qid"))), "qid", "left_anti").select("qid", "id", "distance", "rank").union(again(asked))
        else:
            found = found.withColumn("rank", rank)
        return found.where((F.col("rank") > offset) & (F.col("rank") <= ask)).select("qid", "id", "distance", "rank")

    def _kept(self, df: DataFrame) -> DataFrame:
        where = work_dir(self.spark, "found")
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def _probed(self, router: Router, qs: np.ndarray, nprobe: int, beam_scale: float) -> np.ndarray:
        """A bit for each leaf (rows, in the router's order) and query (eight a byte): whether the query reads the list."""
        leaf = np.full(len(router.centroid), -1)
        leaf[router.leaves] = np.arange(len(router.leaves))
        out = np.zeros((len(router.leaves), -(-len(qs) // 8)), np.uint8)
        for i in range(0, len(qs), TASK_QUERIES):
            some = qs[i:i + TASK_QUERIES]
            if nprobe >= len(router.leaves):
                bits = np.ones((len(some), len(router.leaves)), bool)
            else:
                _, at = router.route(some, nprobe, sizing.beam_width(nprobe, self.meta.nlist, self.meta.fan_out, beam_scale))
                bits = np.zeros((len(some), len(router.leaves)), bool)
                r, c = np.nonzero(at >= 0)
                bits[r, leaf[at[r, c]]] = True
            out[:, i // 8:i // 8 + -(-len(some) // 8)] = np.packbits(bits, axis=0).T
        return out

    def _scorer(self, qids: np.ndarray, qs: np.ndarray, probed: np.ndarray, router: Router, symmetric: bool, find: int, pool: np.ndarray, rerank: bool):
        """A function of (count, batches of entries): the best rows of each query among a task's, or how many entries were kept and ranked.

        A rotation is linear, so that the products of codes with all queries' residuals
        are those with the queries less those with the lists' references.
        """
        metric, dim = self.options.metric, self.meta.dim
        rotation, ip = rabitq.Rotation(dim, self.options.seed), metric == "ip"
        refs = np.stack([reference(router.centroid[i].astype(np.float32), self.options.posting_reference_format) for i in router.leaves.tolist()])
        leaf_of = np.full(int(router.cluster.max(initial=0)) + 1, -1)
        leaf_of[router.cluster[router.leaves]] = np.arange(len(router.leaves))
        qs = qs if len(qs) else np.zeros((0, dim))
        shared = self.spark.sparkContext.broadcast((qids, qs, probed, refs, leaf_of, pool))
        margin = lambda x: x + 1e-9 * np.maximum(1, np.abs(x))

        def run(count: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, qs, probed, refs, leaf_of, pool = shared.value
            rq, rref = rotation(qs), rotation(refs)
            edge, worst = np.full(len(qs), np.inf), np.full(len(qs), np.inf)
            held: list[tuple[np.ndarray, ...]] = []
            totals = [0, 0]

            def estimates(i: int, j: int, leaf, signs, f_add, f_rescale):
                d2 = np.take(exact_knn.pairwise("l2", qs[i:j], refs), leaf, axis=1)
                if symmetric:
                    far = np.empty((j - i, len(leaf)))
                    for c in np.unique(leaf).tolist():
                        at = np.flatnonzero(leaf == c)
                        r = rq[i:j] - rref[c]
                        far[:, at] = np.abs(r).mean(1)[:, None] * (np.where(r > 0, 1.0, -1.0) @ signs[at].T)
                else:
                    far = rq[i:j] @ signs.T - (signs * rref[leaf]).sum(1)
                return f_add + d2 - (2 / np.sqrt(dim)) * f_rescale * far, d2

            def block(part: pa.RecordBatch) -> None:
                f_add, f_rescale, f_error, norm2 = (part.column(c).to_numpy().astype(np.float64) for c in ("f_add", "f_rescale", "f_error", "norm2"))
                leaf, ids = leaf_of[part.column("cluster_id").to_numpy()], part.column("id").to_numpy()
                first = ~part.column("replica").to_numpy(zero_copy_only=False)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
                signs = 2.0 * rabitq.unpack(bits, dim) - 1
                x = exact_knn.matrix(part.column("v")) if rerank else None
                if rerank and x.shape[1] != dim:
                    raise VectorError(f"different vector dimensions {dim} and {x.shape[1]}")
                for i in range(0, len(qs), TASK_QUERIES):
                    j = min(len(qs), i + TASK_QUERIES)
                    here = np.take(np.unpackbits(probed[:, i // 8:-(-j // 8)], axis=1, count=j - i).astype(bool).T, leaf, axis=1)
                    est, d2 = estimates(i, j, leaf, signs, f_add, f_rescale)
                    if ip:  # |q - v|^2 = |q|^2 + |v|^2 - 2 qv
                        est = -((qs[i:j] * qs[i:j]).sum(1)[:, None] + norm2 - est) / 2
                    else:
                        err = f_error * np.sqrt(d2) * (rabitq.SYMMETRIC_FACTOR if symmetric else 1)
                        # the k-th least upper bound rules out what lies above it; a row counts once
                        upper = np.where(here & first, est + err, np.inf)
                        lower = np.flatnonzero((upper < edge[i:j, None]).sum(1) >= find)
                        if len(lower):
                            edge[i + lower] = np.partition(upper[lower], find - 1, axis=1)[:, find - 1]
                        here &= est - err <= edge[i:j, None]
                    totals[0] += int(here.sum()) if count else 0
                    over = np.flatnonzero(pool[i:j] < len(ids))
                    if len(over):
                        some = np.where(here[over], est[over], np.inf)
                        here[over] &= some <= np.take_along_axis(np.sort(some, axis=1), pool[i + over, None] - 1, 1)
                    if count:
                        totals[1] += int(here.sum())
                        continue
                    d = exact_knn.pairwise(metric, qs[i:j], x) if rerank else est
                    here &= d <= margin(worst[i:j])[:, None]
                    # a row has two entries at most
                    many = np.flatnonzero(here.sum(1) > 2 * find)
                    if len(many):
                        most = np.partition(np.where(here[many], d[many], np.inf), 2 * find - 1, axis=1)[:, 2 * find - 1]
                        here[many] &= d[many] <= margin(most)[:, None]
                    r, c = np.nonzero(here)
                    held.append((i + r, ids[c], exact_knn.exact(metric, qs[i + r], x[c]) if rerank else est[r, c]))

            def best() -> tuple[np.ndarray, ...]:
                """The best of what is held, and from now on what is worse than a query's last is left out."""
                q, id_, d = (np.concatenate(c) for c in zip(*held))
                o = np.lexsort((d, id_, q))
                o = o[np.append(True, (q[o][1:] != q[o][:-1]) | (id_[o][1:] != id_[o][:-1]))] if len(o) else o
                o = o[np.lexsort((id_[o], d[o], q[o]))]
                at = np.arange(len(o)) - np.searchsorted(q[o], q[o])
                last = o[at == find - 1]
                worst[q[last]] = np.minimum(worst[q[last]], d[last] ** 2 if rerank and metric == "l2" else d[last])
                o = o[at < find]
                return q[o], id_[o], d[o]

            def out(q: np.ndarray, id_: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
                if not rerank and not ip:  # estimates are of squared l2
                    d = np.sqrt(np.maximum(d, 0)) if metric == "l2" else np.maximum(d, 0) / 2
                for i in range(0, len(q), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(qids[q[i:i + 100_000]]), pa.array(id_[i:i + 100_000]), pa.array(d[i:i + 100_000])], ["qid", "id", "distance"])

            for batch in batches:
                batch = batch.filter(pa.array(np.isfinite(batch.column("f_add").to_numpy())))
                for i in range(0, batch.num_rows if len(qs) else 0, TASK_ROWS):
                    block(batch.slice(i, TASK_ROWS))
                    if sum(len(h[0]) for h in held) > HELD_ROWS or len(held) and i + TASK_ROWS >= batch.num_rows:
                        held[:] = [best()]
                        if len(held[0][0]) > HELD_ROWS // 2:
                            yield from out(*held.pop())
            if count:
                yield pa.RecordBatch.from_pydict({"entries": pa.array([totals[0]]), "candidates": pa.array([totals[1]])})
            elif held:
                yield from out(*held.pop())

        return run

    # ---- maintenance: each call returns the new version ----

    def _next(self, **changes) -> Meta:
        m = self.meta
        return replace(m, version=m.version + 1, seq=m.seq + 1, segments=list(m.segments), tombstones=list(m.tombstones), maintained=list(m.maintained), stats=dict(m.stats), **changes)

    def insert(self, rows: DataFrame, id_col: str = "id", vector: str = "embedding") -> VectorIndex:
        """Append rows to their nearest list, without replicas. Null vectors get no entry."""
        meta = self._next()
        new = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        where = f"{self.path}/postings/s={meta.version}"
        self._write_postings(self.encode(self.assign(new, replicas=False)), where, meta.seq)
        meta.segments.append(where)
        return self._commit(meta)

    def delete(self, ids: DataFrame, id_col: str = "id") -> VectorIndex:
        """Hide the entries of ids at once; compact takes them out."""
        meta = self._next()
        where = f"{self.path}/tombstones/s={meta.version}"
        ids.select(F.col(id_col).cast("long").alias("id"), F.lit(meta.seq).cast("long").alias("seq")).where("id IS NOT NULL").distinct().write.mode("overwrite").parquet(where)
        meta.tombstones.append(where)
        return self._commit(meta)

    def update(self, rows: DataFrame, before: DataFrame | None = None, id_col: str = "id", vector: str = "embedding") -> VectorIndex:
        """Replace the vectors of rows; with the rows as they were before, those that didn't change are skipped."""
        if before is not None:
            old = before.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
            rows = rows.join(old, F.col(id_col) == F.col("_id"), "left").where(~F.col(vector).eqNullSafe(F.col("_v"))).drop("_id", "_v")
        return self.delete(rows, id_col).insert(rows, id_col, vector)

    def compact(self) -> VectorIndex:
        """Merge all segments into one, without deleted entries and entries of lists that are gone."""
        meta = self._next()
        where = f"{self.path}/postings/s={meta.version}"
        cols = [c.split()[0] for c in POSTING.split(", ")]
        self._write_postings(self.postings().select(*cols), where, meta.seq)
        meta.segments, meta.tombstones = [where], []
        return self._commit(meta)

    def list_sizes(self) -> DataFrame:
        """(cluster_id, live, dead) of every list."""
        n = self.postings(live=False).groupBy("cluster_id").agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if(F.col("deleted")).alias("dead"))
        return self.centroids().where("is_leaf").select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("dead", F.lit(0)).alias("dead"))

    def rebalance(self, source: DataFrame, target: int | None = None, id_col: str = "id", vector: str = "embedding") -> VectorIndex:
        """Split lists, pass by pass, until none has more than 2 * target live entries; each pass is a version.

        A pass cuts a list into round(live / target) parts by k-means, SPLIT_PARTS at most; the
        next ones go on with what is still too large. Where a part keeps nearly all of its list,
        as copies of one vector do, the next pass deals it by hash of id to lists of its own
        centroid. Entries of one id stay together, and lists without rows in source stay as they are.
        Without target it is what the build would aim at for the rows there are now.
        """
        index, dealt, whole = self, set(), set()
        sizes = {r["cluster_id"]: r["live"] for r in self.list_sizes().collect()}
        rows = sum(sizes.values())
        target = target or max(1, round(rows / sizing.auto_nlist(rows, self.meta.dim, self.options.target_pages)))
        while True:
            wide = {c: max(2, round(n / target)) for c, n in sizes.items() if n > 2 * target and c not in whole}
            wide = {c: k if c in dealt else min(SPLIT_PARTS, k) for c, k in wide.items()}
            if not wide:
                return index
            # from now on the number of lists follows the rows, so a rebuild sizes anew
            before = VectorIndex(self.spark, self.path, replace(index.meta, explicit=[x for x in index.meta.explicit if x != "nlist"]))
            list_of = {t["node_id"]: t["cluster_id"] for t in before.nodes() if t["is_leaf"]}
            index = before._split(source, wide, max(1, target // 2), id_col, vector, dealt)
            now = {r["cluster_id"]: r["live"] for r in index.list_sizes().collect()}
            parent = {t["cluster_id"]: list_of.get(t["node_id"], list_of.get(t["parent_id"])) for t in index.nodes() if t["is_leaf"]}
            kept = {c for c, old in parent.items() if old in wide and now[c] > SPLIT_KEPT * sizes[old]}
            whole |= {c for c in kept if parent[c] in dealt}
            dealt, sizes = kept - whole, now

    def split(self, cluster_id: int, source: DataFrame, id_col: str = "id", vector: str = "embedding") -> VectorIndex:
        """Split one list in two, whatever its size."""
        if cluster_id not in {t["cluster_id"] for t in self.nodes() if t["is_leaf"]}:
            raise VectorError(f"no list {cluster_id}")
        return self._split(source, {cluster_id: 2}, 1, id_col, vector)

    def _split(self, source: DataFrame, wide: dict[int, int], least: int, id_col: str, vector: str, dealt: Collection[int] = ()) -> VectorIndex:
        """Each list of wide in so many parts: by k-means, or by hash of id if it is in dealt."""
        spark, meta, opt = self.spark, self._next(), self.options
        live = self.postings().where(F.col("part").isin(sorted({c % MAX_PARTS for c in wide}))).where(F.col("cluster_id").isin(sorted(wide))).select("id", "cluster_id", "replica").distinct()
        src = source.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        rows = live.join(src, "id")
        # a bounded sample of each list, by hash of id, is clustered in the list's own task
        n = live.groupBy("cluster_id").agg(F.count("*").alias("n"))
        share = (F.xxhash64("id", F.lit(opt.seed)).cast("double") + 2.0**63) / 2.0**64
        sample = rows.where(~F.col("cluster_id").isin(sorted(dealt))).join(F.broadcast(n), "cluster_id").where(share <= F.lit(256.0 * SPLIT_PARTS) / F.col("n"))
        metric, seed = opt.metric, opt.seed

        def cluster(pdf):
            import pandas as pd

            from .kmeans import _nearest, kmeans

            c = int(pdf["cluster_id"].iloc[0])
            x = np.array(pdf.sort_values("id")["v"].tolist(), np.float64)
            cents = kmeans(x, wide[c], metric, seed + c)
            near, _ = _nearest(unit(x) if metric == "cosine" else x, cents, metric)
            held = np.bincount(near, minlength=len(cents)) * float(pdf["n"].iloc[0]) / len(x)
            cents = cents[held >= least] if (held >= least).sum() >= 2 else cents
            return pd.DataFrame({"old": [c] * len(cents), "centroid": cents.astype(np.float32).tolist()})

        made = sample.select("id", "cluster_id", "v", "n").groupBy("cluster_id").applyInPandas(cluster, "old int, centroid array<float>")
        new: dict[int, list] = {}
        for r in made.collect():
            new.setdefault(r["old"], []).append(r["centroid"])
        nodes = [dict(t) for t in self.nodes()]
        if dealt:
            there = {r["cluster_id"] for r in rows.where(F.col("cluster_id").isin(sorted(dealt))).select("cluster_id").distinct().collect()}
            new |= {t["cluster_id"]: [t["centroid"]] * wide[t["cluster_id"]] for t in nodes if t["is_leaf"] and t["cluster_id"] in there}
        next_cluster = 1 + max((t["cluster_id"] for t in nodes if t["cluster_id"] is not None), default=-1)
        children: dict[int, list[tuple[int, np.ndarray]]] = {}
        for t in list(nodes):
            if t["is_leaf"] and len(new.get(t["cluster_id"], [])) > 1:
                old, t["is_leaf"] = t["cluster_id"], False
                t["cluster_id"] = None
                for c in sorted(new[old]):
                    nodes.append({"node_id": len(nodes), "parent_id": t["node_id"], "level": t["level"] + 1, "is_leaf": True, "cluster_id": next_cluster, "centroid": c})
                    children.setdefault(old, []).append((next_cluster, np.array(c, np.float64)))
                    next_cluster += 1
        if not children:
            return self
        meta.centroids = f"{self.path}/centroids/v={meta.version}"
        meta.nlist, meta.nlevels = sum(t["is_leaf"] for t in nodes), 1 + max(t["level"] for t in nodes)
        meta.stats["split"], meta.maintained = sorted(children), sorted({*meta.maintained, "nlist"})
        self._write_centroids(nodes, meta.centroids)
        b, by_hash = spark.sparkContext.broadcast(children), frozenset(dealt)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, TASK_ROWS) for b in batches for i in range(0, b.num_rows, TASK_ROWS)):
                x, c, deal = exact_knn.matrix(batch.column("v")), batch.column("cluster_id").to_numpy().copy(), batch.column("deal").to_numpy()
                x = unit(x) if metric == "cosine" else x
                for old in np.unique(c).tolist():
                    if old in b.value:
                        at, (names, cents) = np.flatnonzero(c == old), zip(*b.value[old])
                        c[at] = np.array(names)[deal[at] % len(names) if old in by_hash else exact_knn.pairwise(metric, x[at], np.array(cents)).argmin(1)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), _vectors(x), pa.array(c.astype(np.int32)), batch.column("replica")], ["id", "v", "cluster_id", "replica"])

        moved = rows.where(F.col("cluster_id").isin(sorted(children))).select("id", "v", "cluster_id", "replica", F.xxhash64(F.lit(meta.version), "id").alias("deal")).mapInArrow(move, "id long, v array<float>, cluster_id int, replica boolean")
        index = VectorIndex(spark, self.path, meta)
        index._nodes = nodes
        where = f"{self.path}/postings/s={meta.version}"
        index._write_postings(index.encode(moved), where, meta.seq)
        meta.segments.append(where)
        return index._commit(meta)

    def rebuild(self, source: DataFrame, path: str, **kw) -> VectorIndex:
        """A new index of the rows there are now, with the options that were given."""
        return VectorIndex.build(source, path, **{k: self.meta.options[k] for k in self.meta.explicit}, **kw)

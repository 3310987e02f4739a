"""What an index holds, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import sizing
from .index import VectorIndex


def centroid_nodes(index: VectorIndex) -> DataFrame:
    """(node_id, parent_id, level, is_leaf, cluster_id, child_count) of the tree."""
    c = index.centroids()
    kids = c.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("child_count"))
    return c.join(kids, "node_id", "left").select("node_id", "parent_id", "level", "is_leaf", "cluster_id", F.coalesce("child_count", F.lit(0)).alias("child_count"))


def posting_pages(index: VectorIndex) -> DataFrame:
    """(cluster_id, chain_pos, entry_count, dead_count, tombstoned, max_entries) if lists were kept on pages, entries by segment and id."""
    per = (sizing.PAGE_BYTES - sizing.PAGE_HEADER_BYTES - sizing.PAGE_TRAILER_BYTES) // sizing.entry_bytes(index.meta.dim)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy("seq", "id", "replica")) - 1
    p = index.postings(live=False).withColumn("chain_pos", F.floor(n / per).cast("int"))
    return p.groupBy("cluster_id", "chain_pos").agg(F.count("*").alias("entry_count"), F.count_if("deleted").alias("dead_count"), F.bool_and("deleted").alias("tombstoned")).withColumn("max_entries", F.lit(per))


def ids_clusters(index: VectorIndex, ids: list[int]) -> DataFrame:
    """(id, cluster_id, replica) of some ids."""
    return index.postings().where(F.col("id").isin(ids)).select("id", "cluster_id", "replica")


def index_settings(index: VectorIndex, nprobe: int = 0) -> DataFrame:
    """(name, setting, source): what is in effect, and where it comes from."""
    m, o = index.meta, index.options
    src = lambda n, auto=False: "maintained" if n in m.maintained else "option" if n in m.explicit else "auto" if auto else "default"
    rows = [
        ("dim", m.dim, "column"), ("metric", o.metric, "opclass"), ("nlist", m.nlist, src("nlist", True)), ("fan_out", m.fan_out, src("fan_out", True)), ("nlevels", m.nlevels, "derived"),
        ("target_pages", o.target_pages, src("target_pages")), ("target_entries", sizing.target_entries(m.dim, o.target_pages), "derived"),
        ("centroid_nodes", len(index.nodes()), "derived"), ("segments", len(m.segments), "derived"), ("rows", m.rows, "derived"), ("version", m.version, "derived"),
        ("centroid_format", "float32", src("centroid_compression", True)), ("fastscan", o.fastscan, src("fastscan", True)), ("posting_reference_format", o.posting_reference_format, src("posting_reference_format")),
        ("soar_lambda", o.soar_lambda, src("soar_lambda")), ("boundary_epsilon", o.boundary_epsilon, src("boundary_epsilon")), ("kmeans_nredo", o.kmeans_nredo, src("kmeans_nredo")),
        ("distance_mode", o.distance_mode, src("distance_mode")), ("nprobe", nprobe or index.auto_nprobe(), "session" if nprobe else "auto"),
    ]
    return index.spark.createDataFrame([(n, str(v), s) for n, v, s in rows], "name string, setting string, source string")


def search_stats(index: VectorIndex, stats: dict) -> DataFrame:
    """(name, value): counters of one search, from what search put into its stats list."""
    counted = stats["counted"].agg(F.sum("entries").alias("entries"), F.sum("candidates").alias("candidates")).first()
    rows = [("top_k", stats["k"]), ("lists_scanned", stats["lists"]), ("list_probes", stats["probes"]), ("centroids_scored", stats["centroids"]), ("entries_kept", counted["entries"] or 0), ("rerank_candidates", counted["candidates"] or 0)]
    return index.spark.createDataFrame([(n, int(v)) for n, v in rows], "name string, value long")

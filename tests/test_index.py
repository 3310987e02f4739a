"""Exact search, the clustering index and its maintenance against NumPy, on tables with ties, zeros, nulls and no rows."""

import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.functions.vectors import VectorError
from vecloom.operators import inspect as look
from vecloom.operators import kmeans as KM
from vecloom.operators import knn as K
from vecloom.operators.index import VectorIndex
from vecloom.plans import planner, sizing
from vecloom.sources import storage

V32 = "id long, embedding array<float>, grp int"


def sine(n, dim=32):
    return [[math.sin(0.1 * i + 0.7 * j) for j in range(dim)] for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i + 1, v, (i + 1) % 10) for i, v in enumerate(sine(500))]
    return spark.createDataFrame(rows + [(900, None, 0), (901, [0.0] * 32, 1)], V32).cache()


@pytest.fixture(scope="module")
def queries(base):
    return base.where("id % 100 = 0 AND id <= 500").select(F.col("id").alias("qid"), "embedding")


def truth(base, queries, k, metric, where=lambda i: True):
    b = [(r.id, np.array(r.embedding, np.float32).astype(float)) for r in base.collect() if r.embedding is not None and where(r.id)]
    out = {}
    for q in queries.collect():
        v = np.array(q.embedding, np.float32).astype(float)
        far = [(float(K.exact(metric, v[None], x[None])[0]), i) for i, x in b]
        out[q.qid] = [round(d, 5) for d, _ in sorted(far)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(round(r.distance, 5))
    return out


def close(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[q], b[q], atol=2e-5) for q in a)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_exact_join(base, queries, metric):
    assert close(got(K.knn_join(base, queries, 7, metric)), truth(base, queries, 7, metric))


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_more_queries_than_are_sent_to_tasks(spark, base, queries, metric, monkeypatch):
    n = queries.count()
    monkeypatch.setattr(K, "BROADCAST_QUERIES", n - 1)
    assert close(got(K.knn_join(base, queries, 7, metric)), truth(base, queries, 7, metric))
    some = K.knn_join(base, queries.withColumn("most", F.col("qid") % 3), metric=metric, k_col="most")
    assert {r.qid: r.c for r in some.groupBy("qid").agg(F.count("*").alias("c")).collect()} == {r.qid: r.qid % 3 for r in queries.collect() if r.qid % 3}
    assert K.knn_join(base.where("false"), queries, 7, metric).count() == 0


def test_index_search_in_parts(spark, base, queries, monkeypatch):
    index = VectorIndex.build(base, storage.work_dir(spark), nlist=12)
    whole = got(index.search(queries, 5, base, nprobe=12, rerank_pool=-1))
    monkeypatch.setattr(K, "BROADCAST_QUERIES", queries.count() - 1)
    assert close(got(index.search(queries.union(queries), 5, base, nprobe=12, rerank_pool=-1)), whole)


def test_exact_one_query(spark, base):
    line = spark.createDataFrame([(g, [float(g), 0.0, 0.0]) for g in range(50)] + [(99, None)], "id long, embedding array<float>")
    assert [r.id for r in K.knn(line, "embedding", [0.0, 0.0, 0.0], 10).collect()] == list(range(10))
    assert [r.id for r in K.knn(line, "embedding", [0.0, 0.0, 0.0], 3, offset=2, where="id % 2 = 0").collect()] == [4, 6, 8]
    tied = spark.createDataFrame([(i, [float(i // 3)]) for i in range(9)], "id long, embedding array<float>")
    assert sorted(r.id for r in K.knn(tied, "embedding", [0.0], 4, ties=True).collect()) == [0, 1, 2, 3, 4, 5]
    assert K.knn(line.where("false"), "embedding", [0.0, 0.0, 0.0], 3).count() == 0
    assert K.knn_join(line, line.where("false").select(F.col("id").alias("qid"), "embedding"), 3).count() == 0
    with pytest.raises(VectorError):
        K.knn_join(line, line.select(F.col("id").alias("qid"), "embedding"), 3, "hamming")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_with_every_list_read(spark, base, queries, metric):
    index = VectorIndex.build(base, storage.work_dir(spark), metric=metric, nlist=12)
    found = index.search(queries, 5, base, nprobe=12, rerank_pool=-1)
    want = truth(base, queries, 5, metric, lambda i: metric == "l2" or i != 901)
    assert sum(np.allclose(a, b, atol=2e-5) for a, b in zip(got(found).values(), want.values())) >= len(want) - 1
    assert K.recall(found, K.knn_join(base, queries, 5, metric)).first()[0] >= 0.9
    some = index.search(queries, 5, base, nprobe=12, rerank_pool=-1, where="grp = 3")
    assert close(got(some), truth(base, queries, 5, metric, lambda i: i % 10 == 3 and i <= 500))
    with pytest.raises(VectorError):
        index.search(queries.withColumn("embedding", F.slice("embedding", 1, 3)), 5, base)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_rows_are_routed_together_as_one_by_one(metric, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    nodes = KM.build_tree(x, 40, 7, metric)
    leaf = next(t for t in nodes if t["is_leaf"])  # an unbalanced tree, as a split leaves it
    leaf["is_leaf"], leaf["cluster_id"] = False, None
    nodes += [{"node_id": len(nodes) + i, "parent_id": leaf["node_id"], "level": leaf["level"] + 1, "is_leaf": True, "cluster_id": 900 + i, "centroid": c} for i, c in enumerate(rng.normal(size=(3, 8)).tolist())]
    router = KM.Router(nodes, metric)
    for n, beam in ((1, 32), (2, 3), (5, 2), (30, 4)):
        monkeypatch.setattr(KM, "DENSE_NODES", 0)
        alone = router.route(x[:200], n, beam)[0]
        monkeypatch.setattr(KM, "DENSE_NODES", 10_000)
        monkeypatch.setattr(KM, "ROUTE_CELLS", 7 * len(nodes))  # seven rows at a time
        assert (router.route(x[:200], n, beam)[0] == alone).all()


def test_what_a_task_holds_is_bounded(spark, base):
    """Rows go through a task TASK_ROWS at a time, whatever the size of Arrow's batches."""
    from vecloom.operators.index import TASK_ROWS

    index = VectorIndex.build(base, storage.work_dir(spark), nlist=40)
    x = np.random.default_rng(2).normal(size=(6 * TASK_ROWS, 32)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x.tolist(), pa.list_(pa.float32()))], ["id", "v"])
    taken: list = []

    class Rows:
        def mapInArrow(self, run, schema):
            tracemalloc.start()
            taken.extend(b.num_rows for b in run(iter([batch])))
            taken.append(tracemalloc.get_traced_memory()[1] / 1e6)
            tracemalloc.stop()

    index.assign(Rows())
    most = taken.pop()
    assert len(x) <= sum(taken) <= 2 * len(x) and most < 60  # centroids of all candidates of a whole batch were 50 MB, and more for their differences


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_a_task_leaves_k_rows_a_query(spark, base, queries, metric):
    index = VectorIndex.build(base.where("id <= 500"), storage.work_dir(spark), nlist=12, metric=metric)
    found = index.search(queries, 5, base.coalesce(1), nprobe=12, rerank_pool=-1)
    assert close(got(found), truth(base, queries, 5, metric, lambda i: i <= 500))
    found = found._jdf.queryExecution().executedPlan()
    found.executeCollectPublic()
    shuffled = [int(m) for m in re.findall(r"MapInArrow.*?rows=(\d+)", _rows_of(found))]
    assert shuffled and max(shuffled) <= queries.count() * 5 * 4


def _rows_of(plan) -> str:
    """A line a node of an executed plan: its name and the rows it gave."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return _rows_of(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return _rows_of(plan.plan())
    rows = plan.metrics().get("pythonNumRowsReceived")
    below = plan.children()
    return f"{plan.nodeName()} rows={rows.get().value() if rows.isDefined() else -1}\n" + "".join(_rows_of(below.apply(i)) for i in range(below.size()))


def test_post_filter_fills_up_queries_that_it_leaves_short(spark):
    """None of the nearest rows pass: the filter goes before a second search."""
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [399.0, 1.0]), (3, None)], "qid long, embedding array<float>")
    index = VectorIndex.build(rows, storage.work_dir(spark), nlist=4)
    found = index.search(q, 3, rows, nprobe=4, rerank_pool=-1, where="id >= 300", post_filter=True, selectivity=0.5)
    assert sorted((r.qid, r["rank"], r.id) for r in found.collect()) == [(1, 1, 300), (1, 2, 301), (1, 3, 302), (2, 1, 399), (2, 2, 398), (2, 3, 397)]
    late = index.search(q, 2, rows, nprobe=4, rerank_pool=-1, where="id >= 300", post_filter=True, selectivity=0.5, offset=1)
    assert sorted((r.qid, r["rank"], r.id) for r in late.collect()) == [(1, 2, 301), (1, 3, 302), (2, 2, 398), (2, 3, 397)]


def test_maintenance(spark, base, queries):
    e = base.where("id <= 500")
    index = VectorIndex.build(e.where("id <= 300"), storage.work_dir(spark), nlist=4)
    full = dict(nprobe=sizing.MAX_NPROBE, rerank_pool=-1)
    more = index.insert(e.where("id > 300"))
    assert more.postings().select("id").distinct().count() == 500 and index.postings().select("id").distinct().count() == 300
    q = e.where("id = 400").select(F.col("id").alias("qid"), "embedding")
    assert more.search(q, 1, e, **full).first().id == 400
    gone = more.delete(e.where("id % 2 = 0").select("id"))
    assert gone.search(q, 1, e, **full).first().id % 2 == 1 and gone.list_sizes().agg(F.sum("dead")).first()[0] >= 250
    slim = gone.compact()
    assert slim.list_sizes().agg(F.sum("dead")).first()[0] == 0 and slim.postings().select("id").distinct().count() == 250
    back = slim.insert(e.where("id = 400"))
    assert back.search(q, 1, e, **full).first().id == 400
    parted = back.rebalance(e, 20)
    assert parted.meta.nlist > back.meta.nlist and parted.postings().select("id").distinct().count() == 251
    assert parted.search(q, 1, e, **full).first().id == 400
    assert VectorIndex.load(spark, parted.path).meta.version == parted.meta.version and VectorIndex.load(spark, parted.path, 1).meta.version == 1
    names = {r.name: r.setting for r in look.index_settings(parted).collect()}
    assert names["dim"] == "32" and int(names["nlist"]) == parted.meta.nlist
    assert look.posting_pages(parted).agg(F.sum("entry_count")).first()[0] == parted.postings(live=False).count()
    assert "nlist" in back.meta.explicit and "nlist" not in parted.meta.explicit
    again = parted.rebuild(e, storage.work_dir(spark))
    assert again.meta.rows == 500 and again.meta.nlist == sizing.auto_nlist(500, 32)


def test_rebalance_leaves_no_list_over_twice_the_target(spark):
    """More parts than a pass makes, copies that k-means can't part, and a repeated id that nothing can."""
    rng = np.random.default_rng(4)
    x = [*rng.normal(size=(1500, 4)).tolist(), *[[1.0, 2.0, 3.0, 4.0]] * 400]
    rows = spark.createDataFrame(list(enumerate(x)), "id long, embedding array<float>")
    index = VectorIndex.build(rows, storage.work_dir(spark), nlist=1).rebalance(rows, 10)
    assert index.list_sizes().agg(F.max("live")).first()[0] <= 20 and index.meta.nlist > 95
    assert index.postings().count() == index.postings().select("id").distinct().count() == 1900
    found = index.search(rows.where("id % 100 = 7").withColumnRenamed("id", "qid"), 1, rows, nprobe=sizing.MAX_NPROBE, rerank_pool=-1)
    assert {r.qid: r.id for r in found.collect()} == {i: i if i < 1500 else 1500 for i in range(7, 1900, 100)}
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 50 + [(2, [5.0, 6.0])], "id long, embedding array<float>")
    index = VectorIndex.build(same, storage.work_dir(spark), nlist=1).rebalance(same, 10)
    assert index.postings().groupBy("id").count().orderBy("id").collect() == [(1, 50), (2, 1)]


def test_no_rows_and_only_nulls(spark):
    for rows in ([], [(1, None, 0)]):
        df = spark.createDataFrame(rows, V32)
        index = VectorIndex.build(df, storage.work_dir(spark))
        q = spark.createDataFrame([(1, [0.5])], "qid long, embedding array<float>")
        assert index.meta.nlist == 1 and index.search(q, 3, df).count() == 0


def test_options():
    for bad in ({"nlist": -1}, {"fan_out": 1}, {"metric": "l1"}, {"metric": "ip", "centroid_compression": "on"}, {"soar_lambda": 101}):
        with pytest.raises(VectorError):
            from vecloom.operators.index import Options

            Options(**bad).check()


def test_sizing_and_plans():
    assert sizing.inflate_for_filter(20, 0.1) == 335 and sizing.entry_bytes(768) == 116
    assert [sizing.auto_nprobe(n) for n in (5, 100, 10_000, 100_000_000)] == [5, 10, 50, 2048]
    assert sizing.rerank_pool(10, 10) == 42 and sizing.rerank_pool(10, 10, 3) == 10 and sizing.rerank_pool(10, 10, -1) is None
    assert planner.choose_plan(10_000_000, 64, 10).plan == "ann" and planner.choose_plan(500, 64, 10).plan == "exact" and planner.choose_plan(10**7, 64, 10, ordered=False).plan == "exact"


def test_sources(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    with open(tmp_path / "a.fvecs", "wb") as f:
        for row in x:
            f.write(np.int32(3).tobytes() + row.tobytes())
    assert [r.embedding for r in storage.read_fvecs(spark, f"{tmp_path}/a.fvecs").orderBy("id").collect()] == x.tolist()
    df = storage.from_array(spark, x)
    storage.write_vectors(df, f"{tmp_path}/p")
    assert storage.read_vectors(spark, f"{tmp_path}/p", dim=3).count() == 4
    df.select("id", F.format_string("[%s]", F.array_join(F.col("embedding").cast("array<string>"), ",")).alias("embedding")).write.option("header", True).csv(f"{tmp_path}/c")
    assert sorted(r.embedding for r in storage.read_vectors(spark, f"{tmp_path}/c", "csv").collect()) == x.tolist()

"""Registered queries over the test tables, and their DuckDB SQL.

Distances are rounded to six places on both sides. Index queries build an index
of the whole table below spark.checkpoint.dir, once for a session, table and set
of options.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rabitq
from ..functions import vectors as V
from ..operators import inspect as look
from ..operators import knn as K
from ..operators.index import MAX_PARTS, VectorIndex
from ..operators.kmeans import Router
from ..sources.storage import work_dir
from . import planner, sizing

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def emb(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return emb(spark, d).where("vec_id = 0").select("embedding").first()[0]


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# DuckDB pieces
Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
E_ = "embedding::DOUBLE[]"
COS = "CASE WHEN list_inner_product({a}, {a}) * list_inner_product({b}, {b}) = 0 THEN 1.0 ELSE 1 - greatest(-1.0, least(1.0, list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})))) END"
DIST = {"l2": "list_distance({a}, {b})", "ip": "list_negative_inner_product({a}, {b}) + 0.0", "cosine": COS}


def sql_distance(metric: str, a: str, b: str) -> str:
    return DIST[metric].format(a=a, b=b)


# ---- scalar functions (2.2) ----


def _scalar(name: str, fn, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = F.array(*(F.lit(float(x)).cast("float") for x in first_vector(spark, d)))
        return emb(spark, d).select("vec_id", (r6(fn("embedding", q)) + F.lit(0.0)).alias("value"))

    QUERIES[name], SQL[name] = run, f"SELECT vec_id, round({sql.format(a=E_, b=Q0)}, 6) + 0.0 AS value FROM embeddings"


_scalar("l2_distance_all", V.l2_distance, DIST["l2"])
_scalar("l2_squared_all", V.l2_squared_distance, "power(list_distance({a}, {b}), 2)")
_scalar("inner_product_all", V.inner_product, "list_inner_product({a}, {b})")
_scalar("neg_inner_product_all", V.negative_inner_product, DIST["ip"])
_scalar("cosine_all", V.cosine_distance, COS)


@query(f"SELECT vec_id, round(sqrt(list_inner_product({E_}, {E_})), 6) AS norm, len(embedding)::INTEGER AS dims FROM embeddings")
def norm_and_dims(spark, d):
    return emb(spark, d).select("vec_id", r6(V.l2_norm("embedding")).alias("norm"), V.vector_dims("embedding").alias("dims"))


@query(f"SELECT vec_id, round({COS.format(a='list_transform(embedding, lambda x: x::DOUBLE * 0)', b=Q0)}, 6) AS value FROM embeddings")
def cosine_of_zero(spark, d):
    q = F.array(*(F.lit(float(x)).cast("float") for x in first_vector(spark, d)))
    return emb(spark, d).select("vec_id", r6(V.cosine_distance(V.scale("embedding", 0.0), q)).alias("value"))


@query("SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS value FROM embeddings")
def sql_functions(spark, d):
    V.register(spark)
    emb(spark, d).createOrReplaceTempView("_vecloom_embeddings")
    return spark.sql("SELECT vec_id, label, round(l2_distance(embedding, (SELECT first(embedding) FROM _vecloom_embeddings WHERE vec_id = 1)), 6) AS value FROM _vecloom_embeddings")


# ---- types, casts, text (2.1) ----


@query("SELECT vec_id, embedding FROM embeddings")
def vec_text_roundtrip(spark, d):
    text = F.concat(F.lit(" [ "), F.concat_ws(" , ", F.transform("embedding", lambda x: x.cast("string"))), F.lit("]\t"))
    return emb(spark, d).select("vec_id", V.parse_vector(text, 64).alias("embedding"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:4], lambda x: (round(x::DOUBLE * 4) * 2)::BIGINT::VARCHAR), ',') || ']' AS text FROM embeddings")
def vec_to_text(spark, d):
    v = F.transform(F.slice("embedding", 1, 4), lambda x: (F.round(x.cast("double") * 4) * 2).cast("float"))
    v = F.transform(v, lambda x: x + F.lit(0.0).cast("float"))
    return emb(spark, d).select("vec_id", V.format_vector(v).alias("text"))


@query("SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE::FLOAT) AS embedding FROM embeddings")
def array_casts(spark, d):
    return emb(spark, d).select("vec_id", V.to_vector(F.col("embedding").cast("array<double>"), 64).alias("embedding"))


@query()
def vec16_cast(spark, d):
    return emb(spark, d).select("vec_id", V.to_half("embedding", 64).alias("half"))


@query("SELECT vec_id, true AS near FROM embeddings")
def vec16_distances(spark, d):
    """Half rounding moves the distance to the original by less than 2**-10 of its length."""
    h = V.to_half("embedding")
    return emb(spark, d).select("vec_id", (V.l2_distance("embedding", h) <= V.l2_norm("embedding") * 2.0**-10).alias("near"))


# ---- comparison (2.2) ----


@query("SELECT vec_id, rank() OVER (ORDER BY embedding) AS place FROM embeddings")
def vec_order_by(spark, d):
    return emb(spark, d).select("vec_id", F.rank().over(Window.orderBy("embedding")).cast("long").alias("place"))


@query("SELECT count(*) AS vectors, sum(n)::BIGINT AS n_rows FROM (SELECT embedding, count(*) AS n FROM embeddings GROUP BY embedding)")
def vec_group_by(spark, d):
    return emb(spark, d).groupBy("embedding").agg(F.count("*").alias("n")).agg(F.count("*").alias("vectors"), F.sum("n").alias("n_rows"))


@query(f"SELECT vec_id, embedding < q AS lt, embedding <= q AS le, embedding = q AS eq, embedding <> q AS ne, embedding >= q AS ge, embedding > q AS gt, (CASE WHEN embedding < q THEN -1 WHEN embedding > q THEN 1 ELSE 0 END)::INTEGER AS cmp FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)")
def vec_compare_ops(spark, d):
    v, q = F.col("embedding"), F.array(*(F.lit(float(x)).cast("float") for x in first_vector(spark, d)))
    return emb(spark, d).select("vec_id", (v < q).alias("lt"), (v <= q).alias("le"), (v == q).alias("eq"), (v != q).alias("ne"), (v >= q).alias("ge"), (v > q).alias("gt"), V.compare(v, q).alias("cmp"))


# ---- exact k-NN (2.3) ----


def _exact(metric: str) -> None:
    def run(spark, d):
        out = K.knn(emb(spark, d), "embedding", first_vector(spark, d), 10, metric, "vec_id")
        return out.select("vec_id", "label", r6("distance").alias("distance"))

    name = f"knn_exact_{metric}"
    QUERIES[name] = run
    SQL[name] = f"SELECT vec_id, label, round(x, 6) AS distance FROM (SELECT vec_id, label, {sql_distance(metric, E_, Q0)} AS x FROM embeddings) ORDER BY x, vec_id LIMIT 10"


for _m in ("l2", "ip", "cosine"):
    _exact(_m)

SCALED = "list_transform(embedding, lambda x: (x * (1 + vec_id % 7)::FLOAT)::DOUBLE)"


def scaled(df: DataFrame) -> DataFrame:
    """Vectors of different lengths, so that the metrics disagree."""
    by = (F.lit(1) + F.col("vec_id") % 7).cast("float")
    return df.withColumn("embedding", F.transform("embedding", lambda x: (x * by).cast("float")))


@query(f"SELECT vec_id, round(x, 6) AS distance FROM (SELECT vec_id, list_negative_inner_product({SCALED}, {Q0}) AS x FROM embeddings) ORDER BY x, vec_id LIMIT 10")
def knn_scaled_ip(spark, d):
    return K.knn(scaled(emb(spark, d)), "embedding", first_vector(spark, d), 10, "ip", "vec_id").select("vec_id", r6("distance").alias("distance"))


def batch_queries(spark, d, step: int = 100) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return emb(spark, d).where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("qid"), "embedding")


def sql_join(metric: str = "l2", k: str = "10", where: str = "true", extra: str = "", vec: str = E_) -> str:
    dist = sql_distance(metric, "q.v", "b.v")
    return f"""WITH b AS (SELECT vec_id AS id, label, {vec} AS v FROM embeddings), q AS (SELECT id AS qid, label AS qlabel, v FROM b WHERE id % 100 = 0),
      s AS (SELECT qid, id, label, {dist} AS x, row_number() OVER (PARTITION BY qid ORDER BY {dist}, id) AS rank FROM q, b WHERE {where} {extra})
      SELECT qid, id, round(x, 6) AS distance, rank::INTEGER AS rank FROM s WHERE rank <= {k}"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", (r6("distance") + F.lit(0.0)).alias("distance"), "rank")


def joined(spark, d, metric="l2", base=None, **kw) -> DataFrame:
    return rounded(K.knn_join(base if base is not None else emb(spark, d), batch_queries(spark, d), kw.pop("k", 10), metric, "vec_id", **kw))


@query(sql_join())
def knn_batch(spark, d):
    return joined(spark, d)


@query(sql_join("ip", vec=E_))
def knn_batch_ip(spark, d):
    return joined(spark, d, "ip")


@query(sql_join("cosine"))
def knn_batch_cosine(spark, d):
    return joined(spark, d, "cosine")


@query(sql_join(where="id <> qid"))
def knn_batch_without_self(spark, d):
    return joined(spark, d, exclude_self=True)


@query(sql_join(k="1 + (qid // 100) % 5"))
def knn_per_row_k(spark, d):
    q = batch_queries(spark, d).withColumn("k", F.lit(1) + F.floor(F.col("qid") / 100) % 5)
    return rounded(K.knn_join(emb(spark, d), q, None, "l2", "vec_id", k_col="k"))


@query(f"SELECT vec_id, round(x, 6) AS distance FROM (SELECT vec_id, list_distance({E_}, {Q0}) AS x FROM embeddings) ORDER BY x, vec_id LIMIT 5 OFFSET 5")
def knn_offset(spark, d):
    return K.knn(emb(spark, d), "embedding", first_vector(spark, d), 5, "l2", "vec_id", offset=5).select("vec_id", r6("distance").alias("distance"))


@query(f"SELECT vec_id, round(x, 6) AS distance FROM (SELECT vec_id, x, rank() OVER (ORDER BY x) AS r FROM (SELECT vec_id, round(list_distance({E_}, {Q0}) * 10) AS x FROM embeddings)) WHERE r <= 5")
def knn_with_ties(spark, d):
    """Ties made by coarse coordinates: rows as near as the fifth are kept."""
    df = emb(spark, d)
    far = df.select("vec_id", F.round(V.l2_distance("embedding", F.array(*(F.lit(float(x)).cast("float") for x in first_vector(spark, d)))) * 10).alias("x"))
    line = far.select("vec_id", F.array(F.col("x").cast("float")).alias("v"))
    return K.knn(line, "v", [0.0], 5, "l2", "vec_id", ties=True).select("vec_id", r6("distance").alias("distance"))


@query(f"SELECT vec_id, round(list_distance({E_}, {Q0}), 6) AS distance FROM embeddings")
def knn_no_limit(spark, d):
    return K.knn(emb(spark, d), "embedding", first_vector(spark, d), None, "l2", "vec_id").select("vec_id", r6("distance").alias("distance"))


@query(f"SELECT vec_id, round(x, 6) AS distance FROM (SELECT vec_id, list_distance({E_}, {Q0}) AS x FROM embeddings WHERE label = 3) ORDER BY x, vec_id LIMIT 10")
def knn_filter_label(spark, d):
    return K.knn(emb(spark, d), "embedding", first_vector(spark, d), 10, "l2", "vec_id", where="label = 3").select("vec_id", r6("distance").alias("distance"))


@query(f"SELECT vec_id, lang, round(x, 6) AS distance FROM (SELECT vec_id, lang, list_distance({E_}, {Q0}) AS x FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'en') ORDER BY x, vec_id LIMIT 10")
def knn_prefilter_join(spark, d):
    docs = tab(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "lang")
    return K.knn(emb(spark, d).join(docs, "vec_id"), "embedding", first_vector(spark, d), 10, "l2", "vec_id").select("vec_id", "lang", r6("distance").alias("distance"))


@query(f"SELECT vec_id, round(x, 6) AS distance FROM (SELECT vec_id, list_distance({E_}, {Q0}) AS x FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id AND l.toxic = 1)) ORDER BY x, vec_id LIMIT 10")
def knn_anti_join(spark, d):
    bad = tab(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return K.knn(emb(spark, d).join(bad, "vec_id", "left_anti"), "embedding", first_vector(spark, d), 10, "l2", "vec_id").select("vec_id", r6("distance").alias("distance"))


@query(f"""WITH n AS ({sql_join(where='id <> qid')}), c AS (SELECT qid, label, count(*) AS votes, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, label) AS r FROM n JOIN embeddings ON id = vec_id GROUP BY qid, label)
  SELECT qid, label, votes FROM c WHERE r = 1""")
def knn_label_vote(spark, d):
    n = joined(spark, d, exclude_self=True).join(emb(spark, d).select(F.col("vec_id").alias("id"), "label"), "id")
    votes = n.groupBy("qid", "label").agg(F.count("*").alias("votes"))
    return votes.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("votes"), "label"))).where("r = 1").drop("r")


@query("""SELECT label, i::INTEGER AS i, round(avg(x), 6) AS mean, round(sum(x), 6) AS total FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i""")
def cluster_centroids(spark, d):
    m = emb(spark, d).groupBy("label").agg(V.mean_vector("embedding", 64).alias("m"), V.sum_vector("embedding", 64).alias("s"))
    both = m.select("label", F.posexplode(F.arrays_zip("m", "s")).alias("i", "p"))
    return both.select("label", (F.col("i") + 1).alias("i"), r6("p.m").alias("mean"), r6("p.s").alias("total"))


@query("""SELECT label, count(*) AS n, count(DISTINCT embedding) AS vectors, bool_and(len(embedding) = 64) AS all_64, bool_or(vec_id = 0) AS has_first, min(vec_id) AS least, count(*) FILTER (WHERE vec_id % 2 = 0) AS even, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY label""")
def label_aggregates(spark, d):
    g = emb(spark, d).groupBy("label").agg(
        F.count("*").alias("n"), F.count_distinct("embedding").alias("vectors"), F.bool_and(F.size("embedding") == 64).alias("all_64"), F.bool_or(F.col("vec_id") == 0).alias("has_first"),
        F.min("vec_id").alias("least"), F.count_if(F.col("vec_id") % 2 == 0).alias("even"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return g.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY x, vec_id) AS r FROM (SELECT vec_id, list_distance({E_}, {Q0}) AS x FROM embeddings) ORDER BY x, vec_id LIMIT 50),
  t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50)
  SELECT id, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + t.r), 0), 9) AS score FROM v FULL OUTER JOIN t USING (id)""")
def hybrid_rrf(spark, d):
    near = K.knn(emb(spark, d), "embedding", first_vector(spark, d), 50, "l2", "vec_id")
    a = near.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"))
    top = tab(spark, d, "documents").where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    b = top.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return K.fuse_ranks(a, b).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH a AS ({sql_join(k='10')}), b AS ({sql_join('cosine')}) SELECT a.qid, count(*) AS both FROM a JOIN b USING (qid, id) GROUP BY a.qid""")
def knn_result_join(spark, d):
    """Results of two searches, joined: unit vectors have the same neighbours by either metric."""
    return joined(spark, d).join(joined(spark, d, "cosine").select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("both"))


# ---- sizing and planning (2.3, 2.5, 2.8) ----

_GRID = [(rows, dim) for rows in (1, 500, 2000, 100_000, 10_000_000) for dim in (3, 64, 768)]


@query("""WITH g AS (SELECT unnest([1, 500, 2000, 100000, 10000000]) AS n), h AS (SELECT unnest([3, 64, 768]) AS dim),
  t AS (SELECT n::BIGINT AS n, dim::BIGINT AS dim, greatest(3 * (8128 // (ceil((20 + ceil(dim / 8.0)) / 4.0) * 4)::BIGINT), 256)::BIGINT AS target FROM g, h),
  l AS (SELECT *, greatest(floor(n / target::DOUBLE + 0.5), floor(sqrt(n)), 1)::BIGINT AS nlist FROM t),
  p AS (SELECT *, least(nlist, greatest(10, least(2048, ceil(0.5 * sqrt(nlist)))))::BIGINT AS nprobe FROM l)
  SELECT n, dim, target, nlist, (CASE WHEN nlist <= 32 THEN nlist WHEN ceil(sqrt(nlist)) > 256 THEN ceil(cbrt(nlist)) ELSE ceil(sqrt(nlist)) END)::BIGINT AS fan_out, nprobe,
    greatest(10, floor(3.0 * 10 * pow(nprobe, 0.15) + 0.5))::BIGINT AS pool, ceil((1 + 3 / sqrt(10)) * 10 / 0.1)::BIGINT AS inflated FROM p""")
def sizing_table(spark, d):
    rows = []
    for n, dim in _GRID:
        nlist = sizing.auto_nlist(n, dim)
        nprobe = sizing.auto_nprobe(nlist)
        rows.append((n, dim, sizing.target_entries(dim), nlist, sizing.auto_fan_out(nlist), nprobe, sizing.rerank_pool(10, nprobe), sizing.inflate_for_filter(10, 0.1)))
    return spark.createDataFrame(rows, "n long, dim long, target long, nlist long, fan_out long, nprobe long, pool long, inflated long")


@query("SELECT * FROM (VALUES (50, 0, 0, 500, 50), (5, 0, 0, 500, 10), (-1, 0, 0, 500, 500), (50, 0, 20, 500, 20), (20, 30, 0, 500, 50)) t(k_limit, k_offset, query_limit, n, top_k)")
def top_k_sizing(spark, d):
    cases = [(50, 0, 0), (5, 0, 0), (-1, 0, 0), (50, 0, 20), (20, 30, 0)]
    return spark.createDataFrame([(a, b, c, 500, sizing.top_k(None if a < 0 else a, 500, b, c)) for a, b, c in cases], "k_limit int, k_offset int, query_limit int, n int, top_k int")


@query("SELECT * FROM (VALUES (500::BIGINT, 10::BIGINT, 'exact'), (2000, 10, 'exact'), (100000, 10, 'ann'), (10000000, 10, 'ann'), (10000000, -1, 'exact')) t(n, k, plan)")
def plan_choice(spark, d):
    cases = [(500, 10), (2000, 10), (100_000, 10), (10_000_000, 10), (10_000_000, None)]
    return spark.createDataFrame([(n, -1 if k is None else k, planner.choose_plan(n, 64, k).plan) for n, k in cases], "n long, k long, plan string")


# ---- quantization (2.4) ----


@query(f"SELECT vec_id, 64 AS dims, round(power(list_distance({E_}, {Q0}), 2), 3) AS f_add FROM embeddings")
def rabitq_f_add(spark, d):
    """Rotation keeps lengths: f_add, a 4-byte float, is the squared distance to the reference."""
    code = rabitq.encode("embedding", first_vector(spark, d), rabitq.Rotation(64))
    e = emb(spark, d).select("vec_id", code.alias("c"))
    return e.select("vec_id", F.col("c.dim").alias("dims"), F.round(F.col("c.f_add").cast("double"), 3).alias("f_add"))


@query("SELECT count(*) AS n, true AS most_within FROM embeddings")
def rabitq_bounds_ok(spark, d):
    """The bound is 1.9 standard deviations, which 94.3 in 100 of normal errors meet: 92 in 100 rows do at least."""
    q = np.array(first_vector(spark, d))
    rotation = rabitq.Rotation(64)
    ref = [0.0] * 64

    def check(pdf):
        for p in pdf:
            import pandas as pd

            x = np.array(p["embedding"].tolist(), np.float64)
            bits, add, rescale, err = rabitq.encode_residuals(rotation(x - np.array(ref)))
            est = rabitq.estimate(rotation(q), bits, add, rescale)
            true = ((x - q) ** 2).sum(1)
            yield pd.DataFrame({"ok": np.abs(est - true) <= err * np.linalg.norm(q) + 1e-5 * np.abs(est)})

    ok = emb(spark, d).select("embedding").mapInPandas(check, "ok boolean")
    return ok.agg(F.count("*").alias("n"), (F.avg(F.col("ok").cast("double")) >= 0.92).alias("most_within"))


@query(f"SELECT vec_id, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: ((p[1] > 0) <> (p[2] > 0))::INTEGER))::BIGINT AS bits FROM embeddings")
def sign_hamming(spark, d):
    """Hamming distance of sign codes, bits packed as codes pack them and counted in the JVM."""
    @F.pandas_udf("struct<bits:binary>")
    def signs(v):
        import pandas as pd

        return pd.DataFrame({"bits": [np.packbits(np.asarray(x) > 0, bitorder="little").tobytes() for x in v]})

    q = np.packbits(np.array(first_vector(spark, d)) > 0, bitorder="little").tobytes()
    return emb(spark, d).select("vec_id", signs("embedding").alias("a"), F.struct(F.lit(q).alias("bits")).alias("b")).select("vec_id", rabitq.hamming_distance("a", "b").alias("bits"))


@query("SELECT vec_id, 0 AS cmp FROM embeddings")
def rabitq_compare(spark, d):
    """Codes are equal whatever their factors."""
    rot = rabitq.Rotation(64)
    a = rabitq.encode("embedding", [0.0] * 64, rot)
    b = rabitq.encode(V.scale("embedding", 2.0), [0.0] * 64, rot)
    e = emb(spark, d).select("vec_id", a.alias("a"), b.alias("b"))
    return e.select("vec_id", rabitq.compare_codes("a", "b").alias("cmp"))


# ---- clustering (2.5), given fixed centroids ----

_CENTRES = "c AS (SELECT vec_id AS cluster_id, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 16), v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
_RANKED = f"WITH {_CENTRES}, r AS (SELECT vec_id, v, cluster_id, c, power(list_distance(v, c), 2) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), cluster_id) AS n FROM v, c)"


def fixed_index(spark, d, **options) -> VectorIndex:
    """An index object whose lists are the first 16 vectors; nothing is written."""
    from ..operators.index import Meta, Options

    nodes = [{"node_id": i, "parent_id": -1, "level": 0, "is_leaf": True, "cluster_id": i, "centroid": r["embedding"]} for i, r in enumerate(emb(spark, d).where("vec_id < 16").orderBy("vec_id").collect())]
    index = VectorIndex(spark, "", Meta(64, Options(**options).__dict__, 16, 16, 1, 0))
    index._nodes = nodes
    return index


def assigned(spark, d, replicas: bool, **options) -> DataFrame:
    rows = emb(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return fixed_index(spark, d, **options).assign(rows, replicas).select(F.col("id").alias("vec_id"), F.col("cluster_id").cast("long").alias("cluster_id"), "replica")


@query(_RANKED + " SELECT vec_id, cluster_id, false AS replica FROM r WHERE n = 1")
def assign_primary(spark, d):
    return assigned(spark, d, False)


@query(_RANKED + " SELECT vec_id, cluster_id, false AS replica FROM r WHERE n = 1 UNION ALL SELECT b.vec_id, b.cluster_id, true FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2 WHERE a.x <> 0 AND b.x - a.x <= 0.35 * abs(a.x)")
def boundary_replicas(spark, d):
    return assigned(spark, d, True, soar_lambda=0.0)


@query(_RANKED + """, g AS (SELECT a.vec_id, a.v, a.c AS p, a.x AS px FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2 WHERE a.x <> 0 AND b.x - a.x <= 0.35 * abs(a.x)),
  s AS (SELECT r.vec_id, r.cluster_id, row_number() OVER (PARTITION BY r.vec_id ORDER BY r.x + power((list_inner_product(g.v, g.v) - list_inner_product(g.v, r.c) - list_inner_product(g.p, g.v) + list_inner_product(g.p, r.c)), 2) / g.px) AS n FROM g JOIN r ON g.vec_id = r.vec_id AND r.n > 1)
  SELECT vec_id, cluster_id, false AS replica FROM r WHERE n = 1 UNION ALL SELECT vec_id, cluster_id, true FROM s WHERE n = 1""")
def soar_replicas(spark, d):
    return assigned(spark, d, True)


# ---- index: search (2.3) ----

_INDEXES: dict = {}


def index_of(spark, d, base=None, **options) -> VectorIndex:
    key = (spark.sparkContext.applicationId, d, base.__name__ if base else "", tuple(sorted(options.items())))
    if key not in _INDEXES:
        df = emb(spark, d)
        _INDEXES[key] = VectorIndex.build(base(df) if base else df, work_dir(spark), "vec_id", **options)
    return _INDEXES[key]


def ann(spark, d, index: VectorIndex, k: int = 10, source=None, **kw) -> DataFrame:
    return index.search(batch_queries(spark, d), k, source if source is not None else emb(spark, d), id_col="vec_id", **kw)


def _full_probe(metric: str) -> None:
    def run(spark, d):
        return rounded(ann(spark, d, index_of(spark, d, metric=metric), nprobe=sizing.MAX_NPROBE, rerank_pool=-1))

    QUERIES[f"ann_full_probe_{metric}"], SQL[f"ann_full_probe_{metric}"] = run, sql_join(metric)


for _m in ("ip", "cosine"):
    _full_probe(_m)


@query("SELECT 10 * count(*) AS found, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ann_full_probe_l2(spark, d):
    """With every list read and no pool, only the bound of the codes can lose a neighbour: 99 in 100 are found."""
    got = ann(spark, d, index_of(spark, d), nprobe=sizing.MAX_NPROBE, rerank_pool=-1)
    truth = K.knn_join(emb(spark, d), batch_queries(spark, d), 10, "l2", "vec_id")
    return got.agg(F.count("*").alias("found")).crossJoin(K.recall(got, truth).select((F.col("recall") >= 0.99).alias("enough")))


def _recall(name: str, floor: float, **kw) -> None:
    def run(spark, d):
        got = ann(spark, d, index_of(spark, d), **kw)
        truth = K.knn_join(emb(spark, d), batch_queries(spark, d), 10, "l2", "vec_id")
        return K.recall(got, truth).select((F.col("recall") >= floor).alias("enough"))

    QUERIES[name], SQL[name] = run, "SELECT true AS enough"


_recall("ann_recall_auto", 0.9)
_recall("ann_recall_symmetric", 0.8, symmetric=True)


@query("SELECT vec_id AS qid, 10::BIGINT AS found FROM embeddings WHERE vec_id % 100 = 0")
def ann_rerank_off_rows(spark, d):
    return ann(spark, d, index_of(spark, d), rerank=False).groupBy("qid").agg(F.count("*").alias("found"))


@query("SELECT vec_id AS qid, 10::BIGINT AS found FROM embeddings WHERE vec_id % 100 = 0")
def ann_pool_floor(spark, d):
    """A pool below k is raised to k."""
    return ann(spark, d, index_of(spark, d), rerank_pool=2).groupBy("qid").agg(F.count("*").alias("found"))


@query(sql_join("cosine", extra="AND b.label < 5"))
def ann_filtered(spark, d):
    """The filter comes before the search, so with every list read the result is exact."""
    return rounded(ann(spark, d, index_of(spark, d, metric="cosine"), nprobe=sizing.MAX_NPROBE, rerank_pool=-1, where="label < 5"))


@query("SELECT vec_id AS qid, 10::BIGINT AS found FROM embeddings WHERE vec_id % 100 = 0")
def ann_post_filter(spark, d):
    """The filter comes after a search for more neighbours."""
    got = ann(spark, d, index_of(spark, d), nprobe=sizing.MAX_NPROBE, where="label < 5", post_filter=True, selectivity=0.5)
    return got.groupBy("qid").agg(F.count("*").alias("found"))


@query(sql_join("cosine", extra="AND b.label = 3"))
def ann_partial_index(spark, d):
    """An index of some rows answers exactly for them."""
    def label_3(df):
        return df.where("label = 3")

    return rounded(ann(spark, d, index_of(spark, d, label_3, metric="cosine"), nprobe=sizing.MAX_NPROBE, rerank_pool=-1))


# ---- index: maintenance (2.6) and inspection (2.7) ----


def half(df: DataFrame) -> DataFrame:
    return df.where("vec_id % 2 = 0")


@query("SELECT vec_id AS id, true AS found FROM embeddings WHERE vec_id % 100 = 1")
def insert_found(spark, d):
    """Rows inserted later are found by themselves."""
    e = emb(spark, d)
    index = index_of(spark, d, half).insert(e.where("vec_id % 2 = 1"), "vec_id")
    q = e.where("vec_id % 100 = 1").select(F.col("vec_id").alias("qid"), "embedding")
    got = index.search(q, 1, e, nprobe=sizing.MAX_NPROBE, rerank_pool=-1, id_col="vec_id")
    return got.select("id", (F.col("id") == F.col("qid")).alias("found"))


@query(sql_join("cosine", extra="AND b.id % 3 <> 0"))
def delete_gone(spark, d):
    index = index_of(spark, d, metric="cosine").delete(emb(spark, d).where("vec_id % 3 = 0"), "vec_id")
    return rounded(ann(spark, d, index, nprobe=sizing.MAX_NPROBE, rerank_pool=-1))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0")
def vacuum_compact(spark, d):
    index = index_of(spark, d).delete(emb(spark, d).where("vec_id % 3 = 0"), "vec_id").compact()
    return index.postings(live=False).select("id").distinct()


MOVED = "CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE embedding::DOUBLE[] END"


@query(sql_join("cosine", vec=MOVED).replace("q AS (SELECT id AS qid, label AS qlabel, v FROM b WHERE id % 100 = 0)", "q AS (SELECT vec_id AS qid, label AS qlabel, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0)"))
def update_moves(spark, d):
    e = emb(spark, d)
    now = e.withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, V.scale("embedding", -1.0)).otherwise(F.col("embedding")))
    index = index_of(spark, d, metric="cosine").update(now, e, "vec_id")
    return rounded(ann(spark, d, index, source=now, nprobe=sizing.MAX_NPROBE, rerank_pool=-1))


@query("SELECT vec_id AS id FROM embeddings")
def rebalance_preserves_ids(spark, d):
    e = emb(spark, d)
    return index_of(spark, d, nlist=4).rebalance(e, 40, "vec_id").postings().select("id").distinct()


@query("SELECT true AS all_small, count(*) AS n FROM embeddings")
def rebalance_sizes(spark, d):
    """Lists are split until none is over twice the target."""
    e = emb(spark, d)
    index = index_of(spark, d, nlist=4).rebalance(e, 100, "vec_id")
    n = index.postings().where("NOT replica").select("id").distinct().count()
    return index.list_sizes().agg((F.max("live") <= 200).alias("all_small")).withColumn("n", F.lit(n).cast("long"))


@query("SELECT 5::BIGINT AS lists, count(*) AS n FROM embeddings")
def split_list(spark, d):
    index = index_of(spark, d, nlist=4).split(0, emb(spark, d), "vec_id")
    return index.list_sizes().agg(F.count("*").alias("lists")).crossJoin(index.postings().agg(F.count_distinct("id").alias("n")))


@query("SELECT 1::BIGINT AS lists, 0::BIGINT AS found")
def empty_index(spark, d):
    index = index_of(spark, d, nothing)
    got = index.search(batch_queries(spark, d).select("qid", F.slice("embedding", 1, 1).alias("embedding")), 10, emb(spark, d), id_col="vec_id")
    return spark.createDataFrame([(len(index.nodes()), got.count())], "lists long, found long")


def nothing(df: DataFrame) -> DataFrame:
    return df.where("false")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 <> 0")
def zero_vectors_unreachable(spark, d):
    """Under cosine zero rows are stored, but never found."""
    index = index_of(spark, d, with_zeros, metric="cosine")
    e = with_zeros(emb(spark, d))
    return index.search(batch_queries(spark, d).limit(1), 1_000_000, e, nprobe=sizing.MAX_NPROBE, rerank_pool=-1, id_col="vec_id").select("id")


def with_zeros(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.when(F.col("vec_id") % 20 == 0, V.scale("embedding", 0.0)).otherwise(F.col("embedding")))


@query("SELECT * FROM (VALUES ('dim', '64', 'column'), ('distance_mode', 'asymmetric', 'default'), ('metric', 'cosine', 'opclass'), ('nlist', '8', 'option'), ('soar_lambda', '1.0', 'default'), ('target_pages', '3', 'default')) t(name, setting, source)")
def index_settings(spark, d):
    s = look.index_settings(index_of(spark, d, metric="cosine", nlist=8))
    return s.where(F.col("name").isin("dim", "distance_mode", "metric", "nlist", "soar_lambda", "target_pages"))


@query("SELECT count(*) AS n, 0::BIGINT AS dead, false AS tombstoned FROM embeddings")
def posting_stats(spark, d):
    p = look.posting_pages(index_of(spark, d, boundary_epsilon=0.0))
    return p.agg(F.sum("entry_count").alias("n"), F.sum("dead_count").alias("dead"), F.bool_or("tombstoned").alias("tombstoned"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id < 5")
def ids_clusters(spark, d):
    return look.ids_clusters(index_of(spark, d), [0, 1, 2, 3, 4]).where("NOT replica").select("id")


@query("SELECT 8::BIGINT AS leaves, true AS connected")
def centroid_nodes(spark, d):
    n = look.centroid_nodes(index_of(spark, d, metric="cosine", nlist=8))
    return n.agg(F.count_if("is_leaf").alias("leaves"), F.bool_and((F.col("level") == 0) | (F.col("parent_id") >= 0)).alias("connected"))


@query("SELECT * FROM (VALUES ('top_k', true), ('lists_scanned', true), ('list_probes', true), ('centroids_scored', true), ('entries_kept', true), ('rerank_candidates', true)) t(name, positive)")
def search_counters(spark, d):
    stats: list = []
    ann(spark, d, index_of(spark, d), stats=stats)
    return look.search_stats(index_of(spark, d), stats[0]).select("name", (F.col("value") > 0).alias("positive"))


# ---- streaming (2.12) ----


@query("SELECT vec_id AS id FROM embeddings")
def stream_insert(spark, d):
    """Rows that come as a stream of files are indexed batch by batch."""
    from ..streaming.ingest import insert_stream

    root = work_dir(spark, "stream")
    e = emb(spark, d)
    index = VectorIndex.build(half(e), f"{root}/index", "vec_id", nlist=8)
    e.where("vec_id % 2 = 1").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
    insert_stream(stream, index.path, f"{root}/checkpoint", "vec_id").awaitTermination()
    return VectorIndex.load(spark, index.path).postings().select("id").distinct()

"""A training corpus from documents, in five stages: rules, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import Scratch, table
from vecloom.llm.mixing import cycled_weights, weighted_mix, word_count
from vecloom.llm.ngram_join import first_rows, row_key
from vecloom.llm.packing import pack_documents
from vecloom.llm.rules import fit_rules, judge
from vecloom.llm.secrets import scan_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or meet a learned one go."""
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules, COLUMNS).where("kept").select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id (null last) stays, once if its row is repeated."""
    rows = docs.select(*COLUMNS, row_key().alias("key"), F.xxhash64(F.lit(1), "doc_id", "text").alias("more"))
    return rows.join(first_rows(docs), "key", "left_semi").dropDuplicates(["key", "more"]).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also those in encoded layers, are replaced by a mark; n_chars follows."""
    out = scan_texts(docs, [c for c in COLUMNS if c not in ("text", "n_chars")]).withColumnRenamed("redacted", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; equal rows count once and share what is taken."""
    parts = ("doc_id", "text", "lang", "source")
    keys = [F.xxhash64(*parts).alias("key"), F.xxhash64(F.lit(1), *parts).alias("more")]
    small = Scratch(spark).cut(docs.select(*keys, "doc_id", "source", word_count().alias("size")))
    mixed = weighted_mix(small, cycled_weights(small, (1, 2, 3))).where("taken > 0")
    copies = mixed.groupBy("key", "more").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    rows = docs.select(*COLUMNS, *keys).dropDuplicates(["key", "more"]).join(copies, ["key", "more"])
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: four of the stages run learned rules, decoders, tokenizers or a search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

"""Classifiers by compression: texts are compressed with zstandard dictionaries of raw labelled text.

A text is cut into chunks, each compressed on its own, so that a long text does
not become its own dictionary; sizes are summed over all chunks of the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of, table
from .tokens import slices

#: Bytes in a dictionary and from each text in it, labelled rows of a class that fill it at most, bytes in a chunk.
DICTIONARY_BYTES = 512 << 10
PIECE_BYTES = 1024
SAMPLE_ROWS = 600
CHUNK_BYTES = 512
LEVEL = 6


def sizes(texts: list[str | None], dictionaries: list[bytes], level: int = LEVEL) -> np.ndarray:
    """Compressed bytes of each whole text with each dictionary, and its raw bytes in the last column."""
    import zstandard

    kind = zstandard.DICT_TYPE_RAWCONTENT
    params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    packers = []
    for d in dictionaries:
        z = zstandard.ZstdCompressionDict(d, dict_type=kind)
        packers.append(zstandard.ZstdCompressor(dict_data=z, compression_params=params).compress)
    out = np.zeros((len(texts), len(packers) + 1), np.int64)
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        chunks = [raw[a:a + CHUNK_BYTES] for a in range(0, len(raw), CHUNK_BYTES)]
        for k, pack in enumerate(packers):
            out[i, k] = sum(len(pack(c)) for c in chunks)
        out[i, -1] = len(raw)
    return out


def dictionary(texts: list[str], most: int = DICTIONARY_BYTES) -> bytes:
    """Raw content: a piece of each text in turn, from a place that its checksum says, until it is full."""
    parts, n = [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        start = zlib.crc32(b) % max(1, len(b) - PIECE_BYTES + 1)
        parts.append(b[start:start + PIECE_BYTES])
        n += len(parts[-1]) + 1
        if n > most:
            break
    return b"\n".join(parts)


def sample_by_class(rows: DataFrame, cls: str, n: int) -> DataFrame:
    """About n rows (doc_id, cls) of each class, those with the least hashes: no sort, and no class in one task."""
    share = rows.groupBy(cls).agg(F.count("*").alias("_n"))
    h = (F.xxhash64("doc_id", F.lit(1)).cast("double") + 2.0**63) / 2.0**64
    return rows.join(F.broadcast(share), cls).where(h <= F.lit(float(n)) / F.col("_n")).drop("_n")


def fetch(docs: DataFrame, picked: DataFrame) -> list:
    """Rows of picked (a bounded sample of doc_ids) with their texts, in an order that reruns keep."""
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["text"]))


# ---- quality (two classes) ----


class QualityModel:
    """Dictionaries of bad and good text, and a logistic curve over the normalised difference of sizes."""

    def __init__(self, bad: bytes, good: bytes, slope: float, offset: float, prior: float):
        self.bad, self.good, self.slope, self.offset, self.prior = bad, good, slope, offset, prior

    def score(self, texts: list[str | None]) -> np.ndarray:
        s = sizes(texts, [self.bad, self.good])
        z = self.offset + self.slope * difference(s)
        return np.where(s[:, -1] == 0, self.prior, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def difference(s: np.ndarray) -> np.ndarray:
    """(bad - good) / raw bytes: how many bytes of output a byte of text saves with the good dictionary."""
    return (s[:, 0] - s[:, 1]) / np.maximum(s[:, 2], 1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Newton's method for offset and slope, with a slight penalty on the slope of the scaled difference."""
    scale = x.std() or 1.0
    a = np.stack([np.ones_like(x), x / scale], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + np.array([0, 0.01 * w[1]])
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-9, 0.01])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on about 2 * rows labelled documents of each label, by hash of doc_id.

    Half of them fill the dictionaries, half calibrate, each weighed so that the
    labels keep their share. Without rows of both labels every score is the prior.
    """
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").drop("z")
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    got = fetch(docs, sample_by_class(lab, "y", 2 * rows))
    by = {y: [r["text"] for r in got if r["y"] == y] for y in (0, 1)}
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    if not by[0] or not by[1]:
        return QualityModel(b"\n" * 16, b"\n" * 16, 0.0, float(np.log(prior / (1 - prior))), prior)
    bad, good = (dictionary(by[y][::2]) for y in (0, 1))
    model = QualityModel(bad, good, 0.0, 0.0, prior)
    held = {y: by[y][1::2] or by[y] for y in (0, 1)}
    x = {y: difference(sizes(held[y], [bad, good])) for y in (0, 1)}
    # resample by share: each label's rows repeat until their shares are those of the labels
    n1 = max(1, round(len(x[0]) * counts[1] / max(1, counts[0])))
    ones = np.resize(x[1], max(n1, len(x[1])))
    zeros = np.resize(x[0], max(1, round(len(ones) * counts[0] / counts[1])))
    model.offset, model.slope = _logistic(np.concatenate([zeros, ones]), np.concatenate([np.zeros(len(zeros)), np.ones(len(ones))]))
    return model


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """keep and score (0 to 1) of each whole text; a null or empty text gets the share of label 1."""
    b = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, "_text")):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(b.value.score(batch.column("_text").to_pylist()), pa.float64())], [*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(F.pmod(crc32_of("doc_id"), F.lit(5)) != 0))
    out = score_quality(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# ---- language (many classes) ----


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A raw-content dictionary of lower-cased text for each lang, from about `rows` documents of it, by hash of doc_id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    texts: dict[str, list[str]] = {}
    for r in fetch(docs, sample_by_class(known, "lang", rows).dropDuplicates(["doc_id", "lang"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: dictionary([t.lower() for t in texts[k]]) for k in sorted(texts)}


def predict_languages(docs: DataFrame, model: dict[str, bytes], keep: list[str], margin: float = 0.02) -> DataFrame:
    """keep, lang_pred, score and accepted of each whole text.

    lang_pred is the language of the dictionary that compresses the text best, ties
    by name; score is its share under a softmax of the savings; accepted is false
    where the best saves less than `margin` of the text more than the second. A
    null text, one without letters, or no model at all gives `und`, 0 and false.
    """
    b = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string, score double, accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(b.value)
        for batch in (p for b in batches for p in slices(b, "_text")):
            texts = batch.column("_text").to_pylist()
            s = sizes([t and t.lower() for t in texts], list(b.value.values()))
            letters = np.array([bool(t) and any(c.isalpha() for c in t) for t in texts], bool) & bool(names)
            share = s[:, :-1] / np.maximum(s[:, -1:], 1) if names else np.zeros((len(texts), 1))
            best = share.argmin(1)
            part = np.exp(-(share - share.min(1, keepdims=True)) * 50)
            second = np.partition(share, 1, axis=1)[:, 1] if len(names) > 1 else share[:, 0] + 1
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in keep),
                pa.array([names[k] if ok else "und" for k, ok in zip(best, letters)], pa.string()),
                pa.array(np.where(letters, 1 / part.sum(1), 0.0), pa.float64()),
                pa.array(letters & (second - share.min(1) >= margin))], [*keep, "lang_pred", "score", "accepted"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(crc32_of("doc_id"), F.lit(4)) == 2
    model = fit_languages(docs.where(~held))
    out = predict_languages(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")

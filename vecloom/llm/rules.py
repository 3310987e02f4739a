"""Quality rules: text statistics, and decision lists learned from labelled ones.

Sequential covering: while labelled rows of the sought class are left, a rule is
grown, threshold by threshold, by FOIL gain on two thirds of the rows, pruned
back to front on the other third, and kept while its precision there holds; the
rows it covers are taken out. The ordered rules become one Spark conditional
expression over the statistics.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars_all long, n_upper long, n_distinct long, n_bangs long"
#: Scale-free features of a text, as SQL over the statistics; a text without words has 0 for each.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS; null is the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    numbers = _Numbers()
    w = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    repeated = 0
    if len(w) >= 3:
        k = len(numbers)
        if k < 2_000_000:  # three numbers in one integer
            code = (w[:-2] * k + w[1:-1]) * k + w[2:]
        else:
            code = np.unique(np.stack([w[:-2], w[1:-1], w[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        hit = np.zeros(len(code), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        covered = np.zeros(len(w), bool)
        covered[:-2] |= hit
        covered[1:-1] |= hit
        covered[2:] |= hit
        repeated = int(covered.sum())
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    bare = raw.translate(None, _SPACE)
    word_chars = len(bare) if raw.isascii() else len(text) - (len(raw) - len(bare))
    return (len(words), word_chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated,
            len(text or ""), len(raw) - len(raw.translate(None, _UPPER)), len(numbers), raw.count(b"!"))


def with_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep, and the statistics of each whole text."""
    fields = docs.select(*keep).schema
    names = [x.split()[0] for x in STATS.split(", ")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, "_text")):
            stats = np.array([text_stats(x) for x in batch.column("_text").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(stats[:, i]) for i in range(len(names)))], [*keep, *names])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


Rule = list[tuple[str, str, float]]


def _covers(x: dict[str, np.ndarray], rule: Rule) -> np.ndarray:
    n = len(next(iter(x.values())))
    out = np.ones(n, bool)
    for f, op, t in rule:
        out &= x[f] <= t if op == "<=" else x[f] > t
    return out


def _precision(y: np.ndarray) -> float:
    return (y.sum() + 1) / (len(y) + 2)  # Laplace


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> Rule:
    rule: Rule = []
    inside = np.ones(len(y), bool)
    while len(rule) < most and not y[inside].all():
        best = (1e-9, None)
        p0, n0 = y[inside].sum(), inside.sum()
        for f, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, 65)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            order = np.sort(v[inside])
            pos = np.sort(v[inside & y])
            n = np.searchsorted(order, cuts, "right")
            p = np.searchsorted(pos, cuts, "right")
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / nn) - np.log2(p0 / n0)), 0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, op, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        f, op, t = best[1]
        inside &= x[f] <= t if op == "<=" else x[f] > t
    return rule


def learn_decision_list(x: dict[str, np.ndarray], y: np.ndarray, key: np.ndarray, least_precision: float = 0.8, most_rules: int = 12, most_tests: int = 4) -> list[Rule]:
    """Ordered rules that cover rows where y is true. key deals rows to growing and pruning, two to one."""
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    pruning = key % 3 == 2
    while len(rules) < most_rules:
        g, p = left & ~pruning, left & pruning
        if not y[g].any() or not p.any():
            break
        rule = _grow({f: v[g] for f, v in x.items()}, y[g], most_tests)
        on = {f: v[p] for f, v in x.items()}
        value = lambda r: _precision(y[p][_covers(on, r)]) if r else 0.0
        while len(rule) > 1 and value(rule[:-1]) >= value(rule):
            rule = rule[:-1]
        if not rule or value(rule) < least_precision:
            break
        rules.append(rule)
        left &= ~_covers(x, rule)
    return rules


def as_expression(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1; 0 if none."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        test = F.lit(True)
        for f, op, t in rules[k - 1]:
            v = F.expr(FEATURES[f])
            test = test & (v <= F.lit(t) if op == "<=" else v > F.lit(t))
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, label: str = "quality") -> list[Rule]:
    """Learn which statistics mean label 0, from at most most_rows labelled documents of each label, by hash of doc_id.

    A document with labels that differ, or a null one, isn't used. Without rows of both labels there are no rules.
    """
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").drop("z")
    order = F.xxhash64("doc_id")
    some = lab.where("y = 0").orderBy(order, "doc_id").limit(most_rows).union(lab.where("y = 1").orderBy(order, "doc_id").limit(most_rows))
    picked = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "y")
    rows = with_stats(picked, ["doc_id", "y"]).selectExpr("doc_id", "y", *(f"CAST({e} AS DOUBLE) AS {f}" for f, e in FEATURES.items())).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES]).drop_duplicates("doc_id")
    if rows["y"].nunique() < 2:
        return []
    return learn_decision_list({f: rows[f].to_numpy() for f in FEATURES}, rows["y"].to_numpy() == 0, np.array([zlib.crc32(str(d).encode()) for d in rows["doc_id"]]))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """Statistics, base_failed, rule (first met, 0 if none) and kept of each document.

    A null or empty text has no words and fails the base. Repeated rows stay; other columns are left out.
    """
    out = with_stats(docs, keep).withColumn("base_failed", base_failed()).withColumn("rule", as_expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")

import random

import pytest

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp

from .helpers import components, docs, prose
from .test_rules_mixing import junk
from .test_tokens_packing import check_packing


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    texts = [junk(rng, i) if i % 5 == 0 else prose(rng, 90) for i in range(100)]
    texts += [texts[1], texts[1] + " more", "too short", None, prose(rng, 60) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + prose(rng, 60)]
    d = docs(spark, texts)
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")

    good = cp.quality_rules(spark, d, str(tmp_path))
    assert good.columns == d.columns
    ids = {r.doc_id for r in good.collect()}
    assert ids >= {i for i in range(100) if i % 5} | {100, 101, 104} and not ids & {102, 103}

    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = cp.ngram_join(spark, good, str(tmp_path))
    assert {r.doc_id for r in one.collect()} == {c for _, c in components(rows).values()}

    clean = cp.secret_scan(spark, one, str(tmp_path))
    by = {r.doc_id: r for r in clean.collect()}
    assert "0123456789abcdef" not in by[104].text and by[104].n_chars == len(by[104].text) and by[1].text == texts[1]

    mixed = cp.source_mixing(spark, clean, str(tmp_path))
    assert mixed.columns == d.columns and 0 < mixed.count() and {r.doc_id for r in mixed.collect()} <= set(by)

    packed = cp.best_fit_packing(spark, clean, str(tmp_path)).collect()
    check_packing(packed, [(i, r.text) for i, r in by.items()], 1024)
    assert len(cp.STAGES) == 5


def test_repeated_rows(spark):
    d = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    assert cp.ngram_join(spark, d, "").count() == 1
    assert cp.source_mixing(spark, d, "").select("doc_id").distinct().count() >= 1


def test_null_and_repeated_ids_stay(spark):
    rng = random.Random(7)
    a, b, c, e = (prose(rng, 40) for _ in range(4))
    d = docs(spark, [(None, a), (None, a), (None, a + " more"), (None, b), (3, b), (5, c), (5, e), (None, c + " more"), (5, e)])
    got = [(r.doc_id, r.text) for r in cp.ngram_join(spark, d, "").collect()]
    assert len(got) == 4 and set(got) in ({(None, a), (3, b), (5, c), (5, e)}, {(None, a + " more"), (3, b), (5, c), (5, e)})

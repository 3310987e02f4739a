"""The corpus operators' registered queries, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .compression import op3_quality_classifier, op7_language_id
from .media import op10_image_copies
from .mixing import op8_source_mixing
from .ngram_join import op6_ngram_join
from .packing import op9_best_fit_packing
from .rules import op5_quality_rules
from .secrets import op1_secret_scan
from .token_files import op4_token_files
from .url_rules import SQL as URL_SQL
from .url_rules import op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_url_filter": op2_url_filter,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_image_copies": op10_image_copies,
}

SQL: dict[str, str] = {"op2_url_filter": URL_SQL}

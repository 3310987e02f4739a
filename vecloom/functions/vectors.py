"""Vector types and scalar functions over ARRAY<FLOAT> columns.

A vector is ARRAY<FLOAT>, one to 16,000 finite elements. All functions are null
for a null operand, raise for operands of different dimensions, and compute in
double. They are higher-order functions on the JVM side; bulk search uses NumPy
kernels instead (operators.knn, operators.index).

Half-precision vectors are ARRAY<FLOAT> whose elements are rounded to IEEE half.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

MAX_DIM = 16_000
HALF_MAX = 65504.0


class VectorError(ValueError):
    """A value that isn't a vector, or vectors that don't fit together."""


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    """value where the dimensions are equal, null where an operand is null, else an error."""
    differ = F.raise_error(F.format_string("different vector dimensions %d and %d", F.size(a), F.size(b))).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), differ).otherwise(value)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def l2_squared_distance(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return _checked(a, b, _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """The <-> operator."""
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return _checked(a, b, _dot(a, b))


def negative_inner_product(a: Column | str, b: Column | str) -> Column:
    """The <#> operator; never -0.0."""
    return -inner_product(a, b) + F.lit(0.0)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """The <=> operator: 1 - similarity, the similarity held within [-1, 1]; 1 if a vector is zero."""
    a, b = _c(a), _c(b)
    norms = _dot(a, a) * _dot(b, b)
    similar = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / F.sqrt(F.nullif(norms, F.lit(0.0)))))
    return _checked(a, b, F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - similar))


DISTANCES = {"l2": l2_distance, "ip": negative_inner_product, "cosine": cosine_distance}


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    """The distance that orders neighbours for a metric: l2, ip or cosine."""
    if metric not in DISTANCES:
        raise VectorError(f"unknown metric {metric}; one of {', '.join(DISTANCES)}")
    return DISTANCES[metric](a, b)


def l2_norm(v: Column | str) -> Column:
    v = _c(v)
    return F.sqrt(_dot(v, v))


def vector_dims(v: Column | str) -> Column:
    v = _c(v)
    return F.when(v.isNotNull(), F.size(v))


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1: element by element, then the shorter first. The operators < <= = <> >= > of arrays agree."""
    a, b = _c(a), _c(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


# ---- arithmetic and aggregates ----


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(v: Column | str, by: float) -> Column:
    return F.transform(_c(v), lambda x: (x * F.lit(by)).cast("float"))


def normalize(v: Column | str) -> Column:
    """To length 1; a zero vector stays as it is."""
    v = _c(v)
    n = l2_norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x / n).cast("float")))


# ---- validation, casts, text ----


def to_vector(v: Column | str, dim: int | None = None) -> Column:
    """Cast an array of numbers to a vector: not empty, no null, finite as float, of dimension dim if given."""
    v = _c(v)
    if dim is not None and not 1 <= dim <= MAX_DIM:
        raise VectorError(f"dimensions for a vector are 1 to {MAX_DIM}")
    f = v.cast("array<float>")
    bad = lambda text: F.raise_error(F.lit(text)).cast("array<float>")
    out = F.when(v.isNull(), F.lit(None).cast("array<float>"))
    out = out.when(F.size(v) < 1, bad("vector must have at least 1 dimension")).when(F.size(v) > MAX_DIM, bad(f"vector cannot have more than {MAX_DIM} dimensions"))
    out = out.when(F.exists(v, lambda x: x.isNull()), bad("vector elements must not be null"))
    out = out.when(F.exists(f, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), bad("vector elements must be finite"))
    if dim is not None:
        out = out.when(F.size(v) != dim, F.raise_error(F.format_string(f"expected {dim} dimensions, not %d", F.size(v))).cast("array<float>"))
    return out.otherwise(f)


_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_TEXT = rf"^[ \t]*\[[ \t]*{_NUMBER}[ \t]*(,[ \t]*{_NUMBER}[ \t]*)*\][ \t]*$"


def parse_vector(text: Column | str, dim: int | None = None) -> Column:
    """A vector from '[1, 2.5, 3]'; anything else raises, null stays null."""
    t = _c(text)
    numbers = F.split(F.regexp_replace(t, r"[\[\] \t]", ""), ",")
    array = F.transform(numbers, lambda x: x.cast("double"))
    wrong = F.raise_error(F.format_string('invalid input for a vector: "%s"', t)).cast("array<double>")
    return to_vector(F.when(t.isNull(), F.lit(None).cast("array<double>")).when(t.rlike(_TEXT), array).otherwise(wrong), dim)


def _short(x: float) -> str:
    return f"{x:.6g}"


@pandas_udf(T.StringType())
def _format(v: pd.Series) -> pd.Series:
    return v.map(lambda a: None if a is None else "[" + ",".join(map(_short, a.tolist())) + "]")


def format_vector(v: Column | str) -> Column:
    """'[1,2.5,3]', six significant digits."""
    return _format(_c(v))


@pandas_udf(T.ArrayType(T.FloatType()))
def _half(v: pd.Series) -> pd.Series:
    import numpy as np

    def one(a):
        if a is None:
            return None
        with np.errstate(over="ignore"):
            h = np.asarray(a, np.float32).astype(np.float16)
        if not np.isfinite(h).all():
            raise VectorError("a value is out of range for a half-precision vector")
        return h.astype(np.float32)

    return v.map(one)


def to_half(v: Column | str, dim: int | None = None) -> Column:
    """Round a vector to half precision; an element beyond 65504 raises."""
    return _half(to_vector(v, dim))


def from_ml_vector(v: Column | str) -> Column:
    """A vector from a pyspark.ml vector column."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(_c(v), "float32")


# ---- SQL ----

_SQL_FUNCTIONS = {
    "l2_squared_distance": l2_squared_distance,
    "l2_distance": l2_distance,
    "inner_product": inner_product,
    "negative_inner_product": negative_inner_product,
    "cosine_distance": cosine_distance,
}


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions, which Catalyst inlines: distances, l2_norm, vector_dims. Returns their names."""
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, z) -> s + z)"
    ab, aa, bb = dot.format("a", "b"), dot.format("a", "a"), dot.format("b", "b")
    l2 = "aggregate(zip_with(a, b, (x, y) -> power(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)), 0.0D, (s, z) -> s + z)"
    check = "CASE WHEN size(a) <> size(b) THEN CAST(raise_error('different vector dimensions') AS DOUBLE) ELSE {} END"
    cosine = f"CASE WHEN {aa} * {bb} = 0 THEN 1D ELSE 1D - greatest(-1D, least(1D, {ab} / sqrt(nullif({aa} * {bb}, 0D)))) END"
    bodies = {"l2_squared_distance": l2, "l2_distance": f"sqrt({l2})", "inner_product": ab, "negative_inner_product": f"-{ab} + 0D", "cosine_distance": cosine}
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE {check.format(body)} END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_norm(a ARRAY<FLOAT>) RETURNS DOUBLE RETURN sqrt({aa})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_dims(a ARRAY<FLOAT>) RETURNS INT RETURN CASE WHEN a IS NOT NULL THEN size(a) END")
    return [*bodies, "l2_norm", "vector_dims"]


def mean_vector(v: Column | str, dim: int) -> Column:
    """Aggregate: the mean of vectors of one dimension, element by element; nulls are left out."""
    v = _c(v)
    return F.array(*(F.avg(v[i].cast("double")) for i in range(dim)))


def sum_vector(v: Column | str, dim: int) -> Column:
    """Aggregate: the sum of vectors of one dimension, element by element; nulls are left out."""
    v = _c(v)
    return F.array(*(F.sum(v[i].cast("double")) for i in range(dim)))


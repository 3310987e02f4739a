"""Vector functions and codes: known values, errors, nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import rabitq as R
from vecloom.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def vec(*xs):
    """A vector, or null without elements."""
    return F.array(*(F.lit(float(x)).cast("float") for x in xs)) if xs else F.lit(None).cast("array<float>")


@pytest.mark.parametrize("fn, a, b, want", [
    (V.l2_distance, (1, 2, 3), (4, 5, 6), 27**0.5), (V.l2_distance, (0, 0), (3, 4), 5), (V.l2_squared_distance, (0, 0), (3, 4), 25),
    (V.inner_product, (1, 2, 3), (4, 5, 6), 32), (V.negative_inner_product, (1, 2, 3), (4, 5, 6), -32),
    (V.cosine_distance, (1, 2), (1, 2), 0), (V.cosine_distance, (1, 0), (0, 1), 1), (V.cosine_distance, (1, 1), (3, 3), 0),
    (V.cosine_distance, (1, 0), (-2, 0), 2), (V.cosine_distance, (0, 0), (1, 2), 1)])
def test_distances(spark, fn, a, b, want):
    assert one(spark, fn(vec(*a), vec(*b))) == pytest.approx(want, abs=1e-9)


def test_distances_of_nulls_and_of_different_dimensions(spark):
    for fn in (V.l2_distance, V.l2_squared_distance, V.inner_product, V.negative_inner_product, V.cosine_distance):
        assert one(spark, fn(vec(), vec(1, 2))) is None and one(spark, fn(vec(1, 2), vec())) is None
        with pytest.raises(Exception, match="different vector dimensions"):
            one(spark, fn(vec(1, 2), vec(1, 2, 3)))
    assert str(one(spark, V.negative_inner_product(vec(1, 0), vec(0, 1)))) == "0.0"
    with pytest.raises(V.VectorError):
        V.distance("l3", vec(1), vec(1))


def test_norm_dims_compare(spark):
    assert one(spark, V.l2_norm(vec(3, 4))) == 5 and one(spark, V.vector_dims(vec(1, 2, 3))) == 3 and one(spark, V.vector_dims(vec())) is None
    assert [one(spark, V.compare(vec(*a), vec(*b))) for a, b in (((1, 2), (1, 3)), ((1, 2), (1, 2)), ((2,), (1, 9)), ((1, 2), (1, 2, 0)), ((0.0,), (-0.0,)))] == [-1, 0, 1, -1, 0]


@pytest.mark.parametrize("text", ["[]", "[1,NaN,3]", "[1,Inf,3]", "[1,2,", "1,2,3", "[1 2]", "[1,2]abc", "[1,,2]", "[1e39]"])
def test_parse_errors(spark, text):
    with pytest.raises(Exception):
        one(spark, V.parse_vector(F.lit(text)))


def test_parse_and_print(spark):
    for text in ("  [1,2,3]  ", "[ 1 , 2 , 3 ]", "[1.0,+2,3e0]"):
        assert one(spark, V.format_vector(V.parse_vector(F.lit(text), 3))) == "[1,2,3]"
    assert one(spark, V.parse_vector(F.lit(None).cast("string"))) is None
    assert one(spark, V.format_vector(vec(1.23456789, 1e20))) == "[1.23457,1e+20]"
    with pytest.raises(Exception, match="expected 3 dimensions"):
        one(spark, V.parse_vector(F.lit("[1,2]"), 3))
    with pytest.raises(Exception, match="finite"):
        one(spark, V.to_vector(F.array(F.lit(1e39))))
    with pytest.raises(Exception, match="null"):
        one(spark, V.to_vector(F.array(F.lit(1.0), F.lit(None).cast("double"))))


def test_half(spark):
    assert one(spark, V.to_half(vec(1, 2.0004, 0.1))) == [1.0, 2.0, float(np.float16(0.1))]
    with pytest.raises(Exception, match="range"):
        one(spark, V.to_half(vec(65536)))


def test_arithmetic_and_means(spark):
    assert one(spark, V.add(vec(1, 2), vec(3, 4))) == [4, 6] and one(spark, V.subtract(vec(1, 2), vec(3, 4))) == [-2, -2]
    assert one(spark, V.normalize(vec(3, 4))) == pytest.approx([0.6, 0.8]) and one(spark, V.normalize(vec(0, 0))) == [0, 0]
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],), (None,)], "v array<float>")
    assert df.agg(V.mean_vector("v", 2), V.sum_vector("v", 2)).first()[0:2] == ([2, 4], [4, 8])


def test_sql_functions(spark):
    V.register(spark)
    assert spark.sql("SELECT l2_distance(array(0f, 0f), array(3f, 4f)), cosine_distance(array(1f), array(-1f)), l2_norm(array(3f, 4f)), vector_dims(array(1f))").first()[0:4] == (5, 2, 5, 1)


def test_code_text():
    assert R.format_code(R.parse_code("{10101010:1.2345679:9.8765431}")) == "{10101010:1.2345679:9.876543}"
    for bad in ("{}", "{102:1:2}", "{101:1}", "{101:x:2}", "{101:inf:2}"):
        with pytest.raises(V.VectorError):
            R.parse_code(bad)


def test_code_columns(spark):
    codes = [R.parse_code(x) for x in ("{10101010:1.5:2.3}", "{10101010:9.9:9.9}", "{11111111:1:1}")]
    df = spark.createDataFrame([(codes[0], codes[1]), (codes[0], codes[2]), (None, codes[0])], f"a {R.CODE}, b {R.CODE}")
    assert [tuple(r) for r in df.select(R.compare_codes("a", "b"), R.hamming_distance("a", "b")).collect()] == [(0, 0), (-1, 4), (None, None)]


def test_encode_keeps_lengths_and_estimates(spark):
    rng = np.random.default_rng(0)
    x, q, ref = rng.normal(size=(300, 32)), rng.normal(size=32), rng.normal(size=32)
    rot = R.Rotation(32)
    assert np.allclose(rot.matrix @ rot.matrix.T, np.eye(32)) and repr(rot) == "{32:42}"
    bits, add, rescale, err = R.encode_residuals(rot(x - ref))
    assert np.allclose(add, ((x - ref) ** 2).sum(1))
    true, p = ((x - q) ** 2).sum(1), rot(q - ref)
    assert (np.abs(R.estimate(p, bits, add, rescale) - true) <= err * np.linalg.norm(p)).mean() > 0.9
    assert np.corrcoef(R.estimate_symmetric(p, bits, add, rescale), true)[0, 1] > 0.6
    df = spark.createDataFrame([(list(map(float, range(1, 9))),), (None,)], "v array<float>")
    got = [r[0] for r in df.select(R.encode("v", [0.0] * 8, R.Rotation(8))).collect()]
    assert got[0]["dim"] == 8 and got[0]["f_add"] == pytest.approx(204) and got[1] is None
    with pytest.raises(V.VectorError):
        R.encode("v", [0.0], R.Rotation(8))

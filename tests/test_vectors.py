import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.errors import RecordVersionError, SpaceMismatchError, VectorFormatError
from lodestone.functions import vectors as V
from lodestone.operators import combine as C
from lodestone.operators import reduce as R
from lodestone.options import CombineOptions
from lodestone.schema import Boundary, Mass, VectorFormat

SEVEN = np.array([0.32, -0.18, 0.55, 0.05, -0.72, 0.14, 0.09], dtype=np.float32)
SEVEN /= np.linalg.norm(SEVEN)
FORMATS = [VectorFormat.FLOAT32, VectorFormat.FLOAT16, VectorFormat.INT8, VectorFormat.INT4]


def test_codes_are_stable():
    assert [int(f) for f in (VectorFormat.INT4, VectorFormat.INT8, VectorFormat.FLOAT16, VectorFormat.FLOAT32)] == [1, 2, 3, 4]
    assert int(Boundary.WHOLE_DOCUMENT) == 1 and int(Boundary.TOKENS) == 8


@pytest.mark.parametrize("format", FORMATS)
def test_round_trips_keep_direction(format):
    v = V.encode(SEVEN, format)
    assert V.similarity(v, V.encode(SEVEN, VectorFormat.FLOAT32)) > (0.98 if format == VectorFormat.INT4 else 0.999)
    assert len(v.data) == {VectorFormat.INT4: 4, VectorFormat.INT8: 7, VectorFormat.FLOAT16: 14, VectorFormat.FLOAT32: 28}[format]
    assert V.from_envelope(V.to_envelope(v)) == v and V.from_struct(V.vector_struct(v)) == v
    assert V.convert(v, format) is v and V.convert(v, VectorFormat.FLOAT32).dimensions == 7
    assert len(V.to_envelope(v)) == 20 + (8 if v.scheme else 0) + len(v.data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, width=32), min_size=1, max_size=40).filter(any), st.sampled_from(FORMATS))
def test_envelopes_of_any_vector(xs, format):
    v = V.encode(np.array(xs, dtype=np.float32), format)
    assert V.from_envelope(V.to_envelope(v)) == v


def test_malformed_vectors():
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(VectorFormatError):
            V.encode(np.array(bad), VectorFormat.FLOAT32)
    with pytest.raises(VectorFormatError):
        V.encode(np.zeros(3), VectorFormat.INT8)
    raw = V.to_envelope(V.encode(SEVEN, VectorFormat.INT8))
    with pytest.raises(RecordVersionError):
        V.from_envelope(raw[:4] + b"\x02\x00" + raw[6:])
    for broken in (raw[:-1], raw + b"x", b"nope" + raw[4:], raw[:10]):
        with pytest.raises(VectorFormatError):
            V.from_envelope(broken)
    with pytest.raises(VectorFormatError):
        V.similarity(V.encode(SEVEN, VectorFormat.INT8), V.encode(SEVEN[:3], VectorFormat.INT8))


def test_columns_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(9).astype(np.float32)]) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    q = rows[0][1]
    out = df.select("i", V.cosine_to(F.col("v"), q).alias("c"), V.cosine(F.col("v"), F.lit(q).cast("array<float>")).alias("d"), V.wide_cosine_to(np.array(q))("v").alias("w"), V.normalize(F.col("v")).alias("n"), V.quantize(F.col("v"), 8).alias("q8"), V.quantize(F.col("v"), 4).alias("q4"), V.encode_udf(VectorFormat.INT4)("v").alias("e"), V.half_udf("v").alias("h")).collect()
    a = V.encode(np.array(q), VectorFormat.FLOAT32)
    for r in out:
        x = np.array(rows[r.i][1], dtype=np.float32)
        want = V.similarity(a, V.encode(x, VectorFormat.FLOAT32))
        assert r.c == pytest.approx(want, abs=1e-12) and r.d == pytest.approx(want, abs=1e-12) and r.w == pytest.approx(want, abs=1e-6)
        assert np.linalg.norm(r.n) == pytest.approx(1, abs=1e-6)
        for format, got in ((VectorFormat.INT8, r.q8), (VectorFormat.INT4, r.q4)):
            e = V.encode(x, format)
            assert got["values"] == V.integers(e).tolist() and got.scale == pytest.approx(e.scale) and got.inverse_integer_norm == pytest.approx(e.inverse_norm)
        assert V.from_envelope(bytes(r.e)) == V.encode(x, VectorFormat.INT4)
        assert r.h == V.decode(V.encode(x, VectorFormat.FLOAT16)).tolist()
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(V.cosine_to(F.col("v"), [1.0, 0.0])).first()[0] == 0
    with pytest.raises(Exception, match="dimensions"):
        df.select(V.cosine_to(F.col("v"), [1.0])).collect()


@pytest.mark.parametrize(("d", "m"), [(16, 5), (32, 7), (2048, 256), (4095, 2048)])
def test_reduction_is_a_fixed_rotation_cut_short(d, m):
    x = np.random.default_rng(d).standard_normal((4, d))
    y = R.reduce_rows(x, m)
    assert y.shape == (4, m) and np.allclose(np.linalg.norm(y, axis=1), 1, atol=1e-3) and (y == R.reduce_rows(x, m)).all()
    if d <= 32:
        signs, chosen, size = R.profile(d, m)
        h = np.array([[(-1) ** bin(i & j).count("1") for j in range(size)] for i in range(size)])
        work = np.zeros((4, size))
        work[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True) * signs
        plain = (work @ h)[:, chosen]
        assert np.allclose(y, plain / np.linalg.norm(plain, axis=1, keepdims=True), atol=1e-5)


def test_reduction_in_a_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "s"), (2, [1.0, 0.0], "s"), (3, None, "s")], "i int, v array<float>, fp string")
    rows = {r.i: r for r in R.reduce_dimensions(df.where("i <> 3"), "v", "fp", 2).collect()}
    assert rows[1].fp == R.child_fingerprint("s", 3, 2) and rows[2].fp == "s" and rows[2].v == [1.0, 0.0]
    assert R.to_limited_space(df.where("i = 1"), "v", "fp", 3).first().fp == "s"
    with pytest.raises(Exception, match="expanded"):
        R.reduce_dimensions(df.where("i = 2"), "v", "fp", 3).collect()


def test_combination_of_chunks():
    e = np.eye(3)
    opposed = C.combine(np.array([[1.0, 0], [-1.0, 0]]), np.ones(2))
    assert opposed.medoid and opposed.coherence <= 1e-3 and opposed.vector.tolist() == [1.0, 0.0]
    many = C.combine(np.array([[1.0, 0]] * 8 + [[0, 1.0]] * 2), np.ones(10))
    x, y = many.vector
    assert y / x > 0.25 and x > y
    minority = C.combine(np.stack([e[0]] * 8 + [e[1], e[2]]), np.ones(10)).vector
    linear = np.stack([e[0]] * 8 + [e[1], e[2]]).sum(axis=0)
    linear /= np.linalg.norm(linear)
    assert minority[1] > 2 * linear[1] and minority[0] > 0.85 and math.isclose(np.linalg.norm(minority), 1, abs_tol=1e-3)
    assert C.range_mass(np.array([0, 50]), np.array([100, 100])).tolist() == [75.0, 75.0]
    assert C.source_mass(np.array([150, 150]), np.array([0, 50]), np.array([100, 100]), np.array([9, 9]))[1] == Mass.RANGE_COVERAGE
    assert C.source_mass(np.array([120, 120]), np.array([0, 50]), np.array([100, 100]), np.array([9, 9]))[1] == Mass.TOKEN_COUNT


def test_combination_in_a_table(spark):
    cols = "item string, vector array<float>, fingerprint string, tokens int, document_tokens int, start int, length int"
    rows = [("a", [1.0, 0.0, 0.0], "s", 100, 150, 0, 100), ("a", [0.8, 0.6, 0.0], "s", 100, 150, 50, 100), ("b", [0.0, 2.0, 0.0], "s", 5, 5, 0, 5)]
    out = {r.item: r for r in C.combine_items(spark.createDataFrame(rows, cols)).collect()}
    assert out["a"].source_tokens == 150 and out["a"].mass_method == 1 and out["a"].source_count == 2 and out["b"].vector == [0.0, 2.0, 0.0]
    small = {r.item: r for r in C.combine_items(spark.createDataFrame(rows, cols), CombineOptions(dimensions=2)).collect()}
    assert len(small["a"].vector) == 2 and small["a"].fingerprint == R.child_fingerprint("s", 3, 2)
    with pytest.raises(Exception, match="different spaces"):
        C.combine_items(spark.createDataFrame([rows[0], ("a", [1.0, 0.0, 0.0], "t", 1, 1, 0, 1)], cols)).collect()
    assert issubclass(SpaceMismatchError, ValueError)

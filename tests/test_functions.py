import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelora.functions import arrays as A
from allelora.functions.tdist import betainc, two_sided
from allelora.functions.text import atof, g6


def one(spark, column, **values):
    kinds = {"gt": "array<int>", "ph": "array<int>", "hds": "array<float>", "x": "double", "t": "string", "b": "array<int>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[k]}" for k in values))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("x", [0.0, 0.5, 45.009998, 100.0, 123456.7, 1234567.0, 1e-5, 0.0001234567, -2.5, 1e300, 999999.5])
def test_g6_is_c_format(spark, x):
    assert one(spark, g6(F.col("x")), x=x) == "%.6g" % x


def test_g6_special(spark):
    assert one(spark, g6(F.col("x")), x=float("nan")) == "nan"
    assert one(spark, g6(F.col("x")), x=float("-inf")) == "-inf"
    assert one(spark, g6(F.col("x")), x=None) is None


@pytest.mark.parametrize("t,r", [("12.5abc", 12.5), ("abc", 0.0), ("", 0.0), (" -3e2x", -300.0), (".5", 0.5), ("0.333,0.667", 0.333), ("inf", math.inf), ("nan", None), (None, None)])
def test_atof(spark, t, r):
    assert one(spark, atof(F.col("t")), t=t) == r


def test_sparse_round_trip_and_kernels(spark):
    rng = random.Random(7)
    for ploidy in range(2, 5):
        v = [rng.choice([0, 0, 0, 0, 1, 2, -1]) for _ in range(20 * ploidy)]
        for _ in range(10):
            v[rng.randrange(20) * ploidy + rng.randrange(1, ploidy)] = A.EOV
        sums = [sum(0 if x == A.EOV else x for x in v[i * ploidy : (i + 1) * ploidy]) for i in range(20)]
        s = A.to_sparse(F.col("gt"))
        assert one(spark, A.to_dense(s), gt=v) == v
        assert one(spark, A.stride_reduce(F.col("gt"), ploidy), gt=v) == sums
        assert one(spark, A.to_dense(A.sparse_stride_reduce(s, ploidy), "bigint"), gt=v) == sums
        keep = [1, 5, 6, 19]
        expected = [x for k in keep for x in v[k * ploidy : (k + 1) * ploidy]]
        assert one(spark, A.subset(F.col("gt"), keep, ploidy), gt=v) == expected
        assert one(spark, A.to_dense(A.sparse_subset(s, keep, ploidy, 20)), gt=v) == expected
        offsets = one(spark, s["offsets"], gt=v)
        assert one(spark, A.delta_decode(A.delta_encode(s["offsets"])), gt=v) == offsets


def test_empty_and_null_vectors(spark):
    for f in (lambda c: A.to_dense(A.to_sparse(c)), lambda c: A.stride_reduce(c, 2), lambda c: A.subset(c, [0], 2), lambda c: A.to_dense(A.sparse_stride_reduce(A.to_sparse(c), 2), "bigint")):
        assert one(spark, f(F.col("gt")), gt=[]) == []
        assert one(spark, f(F.col("gt")), gt=None) is None


def test_dots(spark):
    assert one(spark, A.sparse_dot(A.to_sparse(F.col("gt")), A.to_sparse(F.col("b"))), gt=[0, 2, 0, 3, 1], b=[5, 4, 0, 0, 7]) == 15.0
    assert one(spark, A.dot(F.col("gt"), F.col("b")), gt=[0, 2, 3], b=[5, 4, 1]) == 11.0


def test_genotype_texts_and_codes(spark):
    assert one(spark, A.gt_alleles(F.col("t")), t="./1") == [-1, 1]
    assert one(spark, A.gt_alleles(F.col("t")), t="2") == [2, A.EOV]
    assert one(spark, A.gt_phases(F.col("t"), ), t="0|1") == [1]
    codes = A.bcf_encode(F.col("gt"), F.col("ph"))
    assert one(spark, codes, gt=[0, 1, -1, A.EOV], ph=[1, 0]) == [2, 5, 0, A.EOV]
    assert one(spark, A.bcf_decode(codes), gt=[0, 1, -1, A.EOV], ph=[1, 0]) == [0, 1, -1, A.EOV]


def test_dosage_conversions(spark):
    hds = [0.25, 0.5, 1.0, 0.0]
    assert one(spark, A.hds_to_ds(F.col("hds")), hds=hds) == [0.75, 1.0]
    gp = one(spark, A.hds_to_gp(F.col("hds")), hds=hds)
    assert np.allclose(gp, [0.375, 0.5, 0.125, 0, 1, 0])
    assert np.allclose(one(spark, A.hds_to_gp(F.col("hds"), 4), hds=hds), np.convolve(np.convolve([0.75, 0.25], [0.5, 0.5]), np.convolve([0, 1], [1, 0])))
    assert one(spark, A.hds_to_gt(F.col("hds")), hds=hds) == [0, 1, 1, 0]


def test_t_distribution():
    t = np.array([0.0, 1.0, 2.228138852, -12.706204736, np.nan])
    assert np.allclose(two_sided(t, np.array([5.0, 1.0, 10.0, 1.0, 3.0])), [1, 0.5, 0.05, 0.05, 1], atol=1e-9)
    assert np.allclose(betainc(np.array([2.0]), np.array([3.0]), np.array([0.4])), [0.5248])
